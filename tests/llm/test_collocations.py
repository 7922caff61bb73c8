import random
import re
from collections import Counter

import numpy as np
import pytest

from credence.llm import collocations

from .helpers import clashing, no_docs, odd_docs, odd_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    f = {k: c for k, c in f.items() if c >= least}
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = any(x == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), c in f.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, rank, x[2].decode(), *x[3:]) for lang, xs in found.items() for rank, x in enumerate(sorted(xs)[:top], 1))


def texts(seed, count=120):
    rng = random.Random(seed)
    words = "New york city of The big apple, a; is\tnot é ß word. zz".split(" ")
    out = []
    for k in range(count):
        parts = rng.choices(words, k=rng.randint(0, 25)) + ["in the new york city area"] * (k % 3 == 0)
        rng.shuffle(parts)
        out.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "  ", " \t"]).join(parts) + rng.choice(["", ".", "\n", "\r x"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "a", 1) for k, (lang, t) in enumerate(rows)], SCHEMA)


def got(df, **how):
    return sorted(map(tuple, collocations.collocations(df, **how).collect()))


@pytest.mark.parametrize("seed,least,longest", [(1, 3, 5), (2, 2, 4), (3, 6, 2)])
def test_matches_brute_force(spark, seed, least, longest):
    rows = texts(seed)
    df = clashing(frame(spark, rows), "w1", "count", "size", "phrase", "score", "rank").repartition(5)
    assert got(df, least=least, longest=longest) == brute(rows, least, longest)


def test_top_by_parts(spark, monkeypatch):
    rows = texts(4)
    monkeypatch.setattr(collocations, "RANKED_TOGETHER", 10)
    assert got(frame(spark, rows), least=2, top=7) == brute(rows, 2, top=7)


def test_few_slots_change_nothing(spark, monkeypatch):
    rows = texts(5)
    many = got(frame(spark, rows), least=3)
    monkeypatch.setattr(collocations, "LEAST_SLOTS", 1 << 18)
    assert many == got(frame(spark, rows), least=3)
    monkeypatch.setattr(collocations, "frequent_slots", lambda docs, slots, least, found: np.full(slots // 8, 255, np.uint8))
    assert many == got(frame(spark, rows), least=3) == brute(rows, 3)


def test_window_rows_do_not_grow_with_splits(spark, monkeypatch):
    """Every split has the same texts: four times the splits are four times the counts, not four times the rows."""
    cores = spark.sparkContext.defaultParallelism
    found = {}
    for splits in (cores, 4 * cores):
        rows = [(1, "one two three. four five", "en", "a", 24)] * (5 * splits)
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, splits), SCHEMA)
        assert docs.rdd.getNumPartitions() == splits
        found[splits] = collocations.task_windows(docs, least=3).collect()
    few, many = found.values()
    assert len(many) <= len(few) <= cores * len({r.window for r in few})
    assert sum(r["count"] for r in many) == 4 * sum(r["count"] for r in few) == 4 * cores * 5 * 5
    monkeypatch.setattr(collocations, "TASK_BYTES", 5 * 24 * 2)  # of text, in two splits
    assert len(few) < len(collocations.task_windows(docs, least=3).collect()) <= 2 * len(few)


def test_many_windows_in_a_task(spark, monkeypatch):
    """Windows that a task does not hold go on in parts, and those that it holds are added up."""
    rows = texts(6)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 64)
    for held in (1, 8, 40, 10_000):
        monkeypatch.setattr(collocations, "HELD_ROWS", held)
        assert got(frame(spark, rows).coalesce(1), least=3) == brute(rows, 3)


def test_odd_rows_and_no_rows(spark):
    docs = odd_docs(spark).where("n_chars is null or n_chars < 100000")
    rows = [(r[2], r[1]) for r in odd_rows() if r[4] is None or r[4] < 100_000]
    assert got(clashing(docs, "lang_", "f", "n"), least=2) == brute(rows, 2)
    assert got(odd_docs(spark), least=100) == brute([(r[2], r[1]) for r in odd_rows()], 100)
    assert got(no_docs(spark)) == []


def test_hot_phrase_and_short_batches(spark):
    rows = [("en", "one two")] * 300 + [("en", "one")] * 3 + [("fr", "x")] + [("en", "a b c d e f g " * 40)]
    assert got(frame(spark, rows), least=30) == brute(rows, 30)


def test_large_numbers_are_exact(spark):
    a, n = 10**9, 10**13
    df = spark.sql(f"SELECT CAST({a} AS DECIMAL(18,0)) * CAST({n} AS DECIMAL(18,0)) * 1000 div (CAST({a} AS DECIMAL(18,0)) * CAST(7 AS DECIMAL(18,0))) AS s")
    assert df.first().s == 1000 * a * n // (a * 7)
