import random

import numpy as np
import pytest

from credence.llm import jaccard
from credence.llm.common import as_utf8
from credence.llm.words import shingle_sets

from .helpers import clashing, components, no_docs, odd_docs, odd_rows, shingle_set


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect())


def expected(rows):
    return sorted((d, len(shingle_set(t)), c) for (d, t), c in zip(rows, components(rows), strict=True))


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(share * len(out))):
        kind, k = rng.random(), rng.randrange(len(out))
        if kind < 0.5:
            out[k] = f"new{rng.randrange(10**6)}"
        elif kind < 0.75:
            out.insert(k, f"in{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[k]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_all_sizes_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 18, 22, 27, 31, 32, 33, 47, 60, 61, 80, 119, 150, 231, 400]:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08):
            rows.append((doc_id, " ".join(edited(rng, base, share))))
            doc_id += 1
        for cut in (1, 2, size // 8, size // 4):
            rows.append((doc_id, " ".join(base[cut:])))
            doc_id += 1
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_chains_and_boilerplate(spark):
    rng = random.Random(5)
    line = " ".join(f"common{k}" for k in range(30))
    rows = [(k, line + " " + " ".join(f"u{k}x{j}" for j in range(rng.randrange(5, 60)))) for k in range(150)]
    text = [f"c{k}" for k in range(60)]
    for k in range(40):  # each is similar to the one before, the first is far from the last
        rows.append((1000 - k, " ".join(text)))
        text[(7 * k) % 60] = f"changed{k}"
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08])))) for k in range(300)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_odd_rows(spark):
    got = jaccard.similar_groups(clashing(odd_docs(spark), "low", "high", "set", "component", "n_shingles")).collect()
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert len(got) == len(rows)
    with_id = [(d, t) for d, t in rows if d is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == expected(with_id)
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert jaccard.similar_groups(no_docs(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    kept = jaccard.one_per_group(clashing(odd_docs(spark), "low", "high", "row"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "low", "high", "row"]
    ids = sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.select("doc_id", "text").collect() if r.doc_id is not None)
    assert [i for _, i, _ in ids] == [-5, 1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 13]
    assert kept.where("doc_id is null").count() == 2
    assert jaccard.one_per_group(no_docs(spark)).count() == 0


def test_shingle_sets_are_those_of_the_words():
    import pyarrow as pa

    texts = [t for _, t, *_ in odd_rows()] + ["A a A a A a A a", "a b c d", "one", "a\x0bb\x0cc\rd\x1fe f", "a b c d e"]
    _, starts = shingle_sets(*as_utf8(pa.array(texts, pa.string())))
    assert np.diff(starts).tolist() == [len(shingle_set(t)) for t in texts]


def test_sets_without_enough_segments_also_index_empty_ones():
    # All shingles in one range of the universe: one segment, and more are needed.
    values = np.arange(1, 31, dtype=np.uint64)
    signature, row = jaccard.signatures(values, np.array([0, 30]), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    own = np.unique(signature & np.uint64(63))
    assert len(signature) >= 30 // 3 + 1 and set(row) == {0} and len(own) >= 1


def test_any_order_of_segments_gives_the_same_groups(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(90)]
    rows = [(k, " ".join(edited(rng, base, 0.03))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    values, _ = shingle_sets(*as_utf8(__import__("pyarrow").array([t for _, t in rows[:20]])))
    common, counts = np.unique(values, return_counts=True)
    monkeypatch.setattr(jaccard, "_common_shingles", lambda *_: (common, counts))
    assert found(df) == expected(rows)


@pytest.mark.parametrize("border", [14, 28, 56, 112, 224, 14336])
def test_both_sides_of_a_pair_index_enough_segments(border):
    sizes = range(border // 2, 8 * border // 3) if border < 1000 else [border - 1, 4 * (border - 1) // 3]
    rng = np.random.default_rng(border)
    sets = [np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    signature, row = jaccard.signatures(
        np.concatenate(sets), np.cumsum([0, *sizes]), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    band = (signature & np.uint64(63)).astype(np.int64)
    count = np.zeros((len(sizes), 64), np.int64)
    np.add.at(count, (row, band), 1)
    for i, s in enumerate(sizes):
        if s >= border:
            continue
        floor = int(jaccard.band_floor(np.array([s]))[0])
        own = 1 + int(np.log2(floor // 7))
        for j, t in enumerate(sizes):
            if s <= t <= 4 * s // 3:
                least = (s + t) // 7 + 1 + jaccard.more_than_needed(floor)
                assert min(count[i, own], count[j, own]) >= least, (s, t)


def test_pairs_across_a_border_share_signatures():
    rng = np.random.default_rng(4)
    for s, t in ((12, 16), (13, 17), (27, 36)):
        sets = []
        for _ in range(4000):
            large = rng.integers(0, 2**64, t, dtype=np.uint64)
            sets += [np.sort(large[:s]), np.sort(large)]
        signature, row = jaccard.signatures(
            np.concatenate(sets), np.cumsum([0, *map(len, sets)]), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _, both = np.unique(np.stack([signature, (row // 2).astype(np.uint64)]), axis=1, return_counts=True)
        pair = np.unique(np.stack([signature, (row // 2).astype(np.uint64)]), axis=1)[1][both > 1]
        assert len(np.unique(pair)) == 4000, (s, t)
