import hashlib
import random

import pytest

from credence.llm import fingerprints
from credence.llm.fingerprints import Tree, edits, likeness

from .helpers import WORDS, clashing, no_docs, odd_docs, odd_rows


def test_equal_roots_mean_equal_texts():
    texts = ["", "\n", "\n\n", "a", "a\n", "\na", "a\nb", "a b", "a  b", "ab", "a\n\nb", "b\na", "é", "e"]
    roots = [Tree(t).root for t in texts]
    assert len(set(roots)) == len(texts)
    assert [Tree(t).root for t in texts] == roots


def test_likeness():
    assert likeness(Tree(""), Tree("")) == 1.0
    assert likeness(Tree("a b c"), Tree("")) == 0.0
    text = "\n".join(" ".join(WORDS[(k * j) % 17] for j in range(1, 14)) + f" {k}." for k in range(40))
    assert likeness(Tree(text), Tree(text)) == 1.0
    assert 0.9 < likeness(Tree(text), Tree(text.replace(" 7.", " seven."))) < 1.0
    assert 0.45 < likeness(Tree(text), Tree(text[: len(text) // 2] + "z" * (len(text) // 2))) < 0.55
    assert likeness(Tree(text), Tree("entirely other words here\n" * 9)) == 0.0
    moved = text.split("\n")
    assert likeness(Tree(text), Tree("\n".join([*moved[20:], *moved[:20]]))) > 0.95


def test_differing_branches_locate_edits():
    lines = [f"line {k} has some words in it, and more." for k in range(50)]
    text = "\n".join(lines)
    lines[30] = lines[30].replace("some words", "other things")
    changed = "\n".join(lines)
    spots = edits(text, changed)
    at = text.index("some words", text.index("line 30"))
    assert len(spots) == 1 and spots[0][0] <= at < spots[0][1] and spots[0][1] - spots[0][0] < 60
    assert edits(text, text) == [] and edits("", "a") == [] and edits("a", "") == [(0, 1)]


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), Tree(text).root.hex(), Tree(edited).root.hex(),
            likeness(Tree(text), Tree(edited)), likeness(Tree(text), Tree(following)))
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_next_document_over_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(10**6) * 100 + k, "\n".join(" ".join(rng.choices(WORDS, k=rng.randrange(9))) for _ in range(rng.randrange(6)))) for k in range(60)]
    rows[5] = (rows[5][0], None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r[0]: tuple(r[1:]) for r in fingerprints.compare_with_next(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == expected(rows)


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "kind", "rank", "fingerprint", "sections")
    got = fingerprints.compare_with_next(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert fingerprints.compare_with_next(docs.where("doc_id = 7")).first().near_next == 1.0
    assert fingerprints.compare_with_next(no_docs(spark)).count() == 0
    for row in fingerprints.fingerprints(docs).collect():
        assert row.fingerprint == Tree(row.text or "").root.hex()
        assert row.n_chars == len(row.text or "") == sum(s.n_chars for s in row.sections)
    assert fingerprints.fingerprints(no_docs(spark)).count() == 0
