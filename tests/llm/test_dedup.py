import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credence.llm import dedup

from .helpers import clashing, no_docs, odd_docs, odd_rows


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text)."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        group = groups[text or ""]
        keep = max((d for d in group if d is not None), default=None)
        out.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return Counter(out)


def many(spark):
    """Groups of one to hundreds, a third of all rows in one of them."""
    rows = [(k, f"text {k}" if k % 3 else "the hot text", "en", "a", 1) for k in range(900)]
    rows += [(1000 + k, f"text {k % 40}", "de", "b", 1) for k in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


def crowded(text):
    return F.pmod(F.crc32(text), F.lit(7))


@pytest.mark.parametrize("key", [dedup.text_key, crowded])
@pytest.mark.parametrize("capacity", [3, 50_000])
def test_matches_brute_force(spark, key, capacity):
    for docs in (many(spark), clashing(odd_docs(spark), "key", "digest", "bucket", "rows", "keep_id")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert Counter(map(tuple, dedup.exact_groups(docs, key, capacity).collect())) == brute(rows)


def test_no_rows(spark):
    assert dedup.exact_groups(no_docs(spark)).collect() == []
    assert dedup.without_copies(no_docs(spark)).collect() == []


def test_many_repeated_keys_are_not_broadcast(spark, monkeypatch):
    docs = many(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(dedup, "FEW_KEYS", 0)
    assert Counter(map(tuple, dedup.exact_groups(docs).collect())) == brute(rows)


@pytest.mark.parametrize("values,capacity", [
    (list(range(-500, 500)), 16), ([1 << 63 - k for k in range(1, 40)], 2), ([5, 6, 7], 1), ([], 4), ([9], 4),
    ([hash((k, k)) for k in range(700)], 20)])
def test_directory_splits_until_every_bucket_fits(spark, values, capacity):
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    table, bits = dedup.directory(keys, capacity)
    rows = {r.address: r for r in table.collect()}
    address = {v: (v >> (64 - bits) if bits else 0) for v in values}
    assert set(rows) == set(address.values())
    held = Counter(rows[address[v]].bucket for v in values)
    prefix = lambda v, depth: v >> (64 - depth) if depth else 0
    for v in values:
        row = rows[address[v]]
        assert row.held == held[row.bucket] <= capacity
        together = [w for w in values if prefix(w, row.depth) == prefix(v, row.depth)]
        assert len(together) == row.held
        # One bit less and the bucket would be overfull: it was split for that.
        assert row.depth == 0 or sum(prefix(w, row.depth - 1) == prefix(v, row.depth - 1) for w in values) > capacity


def test_index_lays_chains_in_ranges_of_keys(spark):
    docs = many(spark)
    found = dedup.entries(docs, crowded)
    index = dedup.build_index(docs, found, crowded, 2)
    rows = index.collect()
    texts = {r.text for r in docs.collect()}
    assert {bytes(r.digest) for r in rows} == {hashlib.sha256(t.encode()).digest() for t in texts} and len(rows) == len(texts)
    for key in {r.key for r in rows}:
        chain = sorted(r.chain for r in rows if r.key == key)
        assert chain == list(range(1, len(chain) + 1)) and {r.chained for r in rows if r.key == key} == {len(chain)}
    of_key = {r.key: r.bucket for r in rows}
    assert sorted(of_key, key=lambda k: (of_key[k], k)) == sorted(of_key)


def test_keeps_one_row_of_each_text(spark):
    docs = clashing(odd_docs(spark), "key", "row", "told", "id")
    got = dedup.without_copies(docs)
    assert got.columns == docs.columns
    rows = [(r[0], r[1]) for r in odd_rows()]
    wanted = {(d, t or "") for (d, t), (_, keep, _, kept, _) in zip(rows, [next(iter(brute(rows[:k] + rows[k + 1:] + [rows[k]]) & Counter(
        [x for x in brute(rows) if x[0] == rows[k][0] and x[4] == hashlib.sha256((rows[k][1] or "").encode()).hexdigest()]))) for k in range(len(rows))], strict=True) if kept}
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter(wanted)


def test_no_python_on_the_main_path(spark):
    plan = dedup.exact_groups(many(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
