import random
from collections import defaultdict

import numpy as np

from credence.llm import mixing

from .helpers import clashing, no_docs, odd_docs, words


def highest_quotients(targets, seats):
    quota = [0] * len(targets)
    for _ in range(seats):
        k = max(range(len(targets)), key=lambda k: (targets[k] / (2 * quota[k] + 1), -k))
        quota[k] += 1
    return quota


def test_sainte_lague_is_seat_after_seat():
    rng = random.Random(1)
    for _ in range(200):
        targets = np.array([rng.choice([0, rng.random() * 9, rng.randrange(1, 50)]) for _ in range(rng.randrange(1, 9))], float)
        seats = rng.randrange(0, 60)
        got = mixing.sainte_lague(targets, seats)
        want = highest_quotients(targets, seats) if targets.sum() > 0 else [0] * len(targets)
        if len(set(targets)) == len(targets):
            assert got.tolist() == want, (targets, seats)
        assert got.sum() == sum(want)


def targets_by_rounds(sizes):
    """Share, stop at three times the size, reshare the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    done = {s: 0.0 for s in names if not sizes[s]}
    total = float(sum(sizes.values()))
    while True:
        left = total - sum(done.values())
        rest = [s for s in names if s not in done]
        whole = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / whole for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return {**done, **share}
        done |= {s: 3.0 * sizes[s] for s in above}


def check(rows, size_of):
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, size, got, *_ in rows:
        sizes[source] += size
        taken[source] += got
        assert 0 <= got <= 3 * size
    targets = targets_by_rounds(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for source, size, got, source_size, target in rows:
        assert source_size == sizes[source] and abs(target - targets[source]) < 1e-6 * (1 + target)
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= 2 * mixing.BLOCK_WORDS, (source, taken[source], targets[source])


def test_targets_and_taken_words(spark):
    rng = random.Random(2)
    for skew in (1, 40):
        rows = []
        for k in range(400):
            source = None if k % 50 == 0 else ("hot" if k % 3 == 0 else f"s{rng.randrange(9)}")
            size = rng.randrange(0, 60) if source != "hot" else rng.randrange(0, 60 * skew)
            rows.append((k, source, " ".join(["w"] * size)))
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = {r.doc_id: r for r in mixing.words_taken(docs).collect()}
        assert len(got) == 400
        check([(s, got[d].size, got[d].taken, got[d].source_size, got[d].target) for d, s, t in rows], None)
        assert all(got[d].size == len(words(t)) for d, s, t in rows)
        again = {r.doc_id: r.taken for r in mixing.words_taken(docs.repartition(7)).collect()}
        assert again == {d: r.taken for d, r in got.items()}


def test_shards_pay_the_same_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    docs = spark.range(1500).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', cast(1 + id % 37 AS int)) AS text")
    rows = mixing.words_taken(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[f"s{r.doc_id % 4}"] += r.taken
        target[f"s{r.doc_id % 4}"] = r.target
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in target)


def test_sparse_sources_of_short_texts_are_paid(spark, monkeypatch):
    """Rounding must not add up over the shards: few short documents among very many."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    many = spark.range(4000).selectExpr("id AS doc_id", "'big' AS source", "repeat('w ', 20) AS text")
    short = spark.range(40).selectExpr("10000 + id AS doc_id", "'one' AS source", "'w' AS text")
    seven = spark.range(40).selectExpr("20000 + id AS doc_id", "'seven' AS source", "repeat('w ', 7) AS text")
    rows = mixing.words_taken(many.union(short).union(seven)).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        source = {0: "big", 1: "one", 2: "seven"}[r.doc_id // 10_000]
        taken[source] += r.taken
        target[source] = r.target
    assert target["one"] == 120 and target["seven"] == 840
    assert all(abs(taken[s] - target[s]) <= 1 for s in target), (taken, target)


def test_blocks_of_several_words(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', cast(30 + id % 37 AS int)) AS text")
    rows = mixing.mix_plan(docs, block_words=16).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.doc_id % 4] += r.taken
        target[r.doc_id % 4] = r.target
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)


def test_mixed_rows(spark):
    docs = clashing(spark.range(600).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', cast(5 + id % 9 AS int)) AS text"), "k1", "times", "row")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert max(count.values()) <= 3
    sizes = defaultdict(int)
    for d, n in count.items():
        sizes[d % 3] += n * (5 + d % 9)
    target = {r.doc_id % 3: r.target for r in mixing.words_taken(docs).collect()}
    assert all(abs(sizes[s] - target[s]) < 40 for s in target)


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "size", "shard", "taken", "rows")
    rows = mixing.words_taken(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r.size for r in rows) == sorted(len(words(r.text)) for r in docs.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.words_taken(no_docs(spark)).count() == 0 and mixing.mixed(no_docs(spark)).count() == 0
    blank = docs.where("doc_id in (3, 4, 5)")
    assert {(r.taken, r.target) for r in mixing.words_taken(blank).collect()} == {(0, 0.0)}
    assert mixing.mixed(blank).count() == 0
