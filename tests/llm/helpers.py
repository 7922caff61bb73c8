"""Rows that every operator must take, and plain versions of what the operators compute."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat sat on a mat and saw one bird fly over its old house while rain fell down".split()


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"{WORDS[k % 17]}{k % 911}" for k in range(40_000))
    rows = [
        (1, "The cat sat on a mat and saw one bird.\nIt flew.", "en", "a", 48),
        (2, "the cat sat on a mat AND saw one bird.\nIt flew.", "en", "b", 48),
        (3, None, "en", "a", None), (4, "", None, "b", 0), (5, " \n\t ", "en", None, 4), (6, "...!?", "de", "a", 5),
        (7, long, "en", "a", len(long)), (8, "x" * 200_000, "fr", "c", 200_000),
        (None, "a text without a number", "en", "a", 23), (None, None, None, None, None),
        (9, "zwei Wörter", "de", "c", 11), (10, "日本語 テキスト 😀 é", "ja", "c", 13),
        (12, "the same twice over and over", "en", "b", 28), (12, "the same twice over and over", "en", "b", 28),
        (13, "the same number, two texts", "en", "b", 26), (13, "two texts have one number here", "en", "a", 30),
        (-5, "line\n\nline\n\nline\r\nend<|endoftext|>of it", "en", "c", 39),
    ]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """The frame with more columns, of the names that operators use themselves."""
    for name in names:
        df = df.selectExpr("*", f"'mine' AS `{name}`")
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, width=5):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = words(low)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(rows):
    """component_id of each row of (doc_id, text), all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if a and b and 100 * same >= 75 * (len(a) + len(b) - same):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return [least[root(k)] for k in range(len(rows))]
