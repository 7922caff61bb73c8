import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from credence.llm import language
from credence.llm.common import as_utf8

from .helpers import clashing, no_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    """All ways to cut a word; a character that is no piece stands alone as None."""
    if not word:
        return [[]]
    out = [[p, *rest] for k in range(1, len(word) + 1) if (p := word[:k]) in pieces for rest in segmentations(word[k:], pieces)]
    return out


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "bab", "▁bab"]
    shape = language.Pieces(pieces)
    random = np.random.default_rng(1)
    chance = np.zeros((shape.size, 2))
    node = {}
    for p in pieces:
        at = shape.root[shape.code[ord(p[0])]]
        for c in p[1:]:
            at = shape.step[at, shape.code[ord(c)]]
        node[p] = at
        chance[at] = random.random(2)
    words = ["".join(w) for n in range(1, 6) for w in product("ab", repeat=n)]
    codes, begin, length, first = shape.runs(*as_utf8(pa.array(words)))
    assert first.tolist() == list(range(len(words) + 1))
    got = language.forward(shape, chance, codes, begin, length)
    for k, word in enumerate(words):
        cuts = segmentations("▁" + word, set(pieces))
        want = sum(np.prod([chance[node[p]] for p in cut], axis=0) for cut in cuts)
        assert np.allclose(got[k], want)
    uses = language.expected_counts(shape, chance, np.zeros(len(words), np.int64), np.ones(len(words)), codes, begin, length)
    want = np.zeros_like(uses)
    for word in words:
        cuts = segmentations("▁" + word, set(pieces))
        weight = [np.prod([chance[node[p], 0] for p in cut]) for cut in cuts]
        for cut, w in zip(cuts, weight, strict=True):
            for p in cut:
                want[node[p], 0] += w / sum(weight)
    assert np.allclose(uses, want)


def test_long_runs_and_no_letters():
    shape = language.Pieces(language.read_vocabulary(PATH))
    _, begin, length, first = shape.runs(*as_utf8(pa.array(["x" * 1000, None, "12 ...", "aB cÉ日", ""])))
    assert length.max() == language.RUN and length.sum() == 1001 + 7
    assert np.diff(first).tolist() == [21, 0, 0, 2, 0] and len(begin) == 23


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return language.fit(docs, language.read_vocabulary(PATH))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs.drop("n_chars"), model, ("lang",)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_but_the_text_decides(spark, model):
    docs = odd_docs(spark)
    other = docs.selectExpr("doc_id + 17 AS doc_id", "text", "'zz' AS lang", "source", "n_chars")
    a = sorted((r.lang_pred, r.score) for r in language.identify(docs, model).collect())
    assert a == sorted((r.lang_pred, r.score) for r in language.identify(other, model).collect())


def test_training_split_is_by_checksum(spark):
    rows = spark.range(200).select("id", language.in_training(__import__("pyspark.sql.functions", fromlist=["col"]).col("id")).alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in rows)


def test_odd_rows(spark, model):
    docs = clashing(odd_docs(spark), "score", "lang_pred")
    rows = language.identify(docs, model, ("text",)).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
    assert language.identify(no_docs(spark), model).count() == 0
    vocabulary = language.read_vocabulary(PATH)
    assert language.fit(no_docs(spark), vocabulary) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    again = language.fit(docs, vocabulary)
    assert again.languages and np.array_equal(again.chance, language.fit(docs, vocabulary).chance)


def test_a_long_run_of_an_untrained_script_does_not_decide():
    shape = language.Pieces(language.read_vocabulary(PATH))
    chance = np.where(shape.is_piece, 1.0, 0)[:, None].repeat(2, axis=1)
    sizes = np.array([1e6, 2e6])  # expected uses: an unseen piece has 0.1 of them
    chance *= language.SMOOTHING / sizes
    chance[2] = language.UNKNOWN
    for word, times in (("▁the", (1, 1e5)), ("▁and", (1, 1e5)), ("▁der", (1e5, 1)), ("▁und", (1e5, 1))):
        at = 1
        for c in word:
            at = shape.root[shape.code[ord(c)]] if at == 1 else shape.step[at, shape.code[ord(c)]]
        assert shape.is_piece[at]
        chance[at] = np.array(times) / sizes
    model = language.Model(shape, ["de", "en"], chance)
    singles = [chr(p) for p in range(0x4E00, 0x9FFF) if shape.code[p] >= shape.columns][:200]
    run = "".join(singles)
    assert len(run) == 200
    texts = ["the and " * 200 + run, "der und " * 200 + run, run, run[:150] + "x" * 50]
    data, offsets = as_utf8(pa.array(texts))
    logs, _ = model.log_likelihood(data, offsets)
    assert np.isfinite(logs).all()
    names, score = model.predict(data, offsets)
    assert names[:2] == ["en", "de"] and (score >= 0).all() and (score <= 1).all()
    # A run with no other cut than between its letters: the product over them.
    assert np.allclose(logs[2], np.log(chance[shape.root[shape.code[ord("▁")]]]) + 200 * np.log(language.SMOOTHING / sizes))


def test_runs_are_judged_whole_and_counts_do_not_underflow():
    pieces = ["▁", "a", "b", "ab", "ba", "aba"]
    shape = language.Pieces(pieces)
    chance = np.where(shape.is_piece, 1e-11, 0)[:, None].repeat(2, axis=1)
    word = "ab" * 100
    logs, _ = language.Model(shape, ["x", "y"], chance).log_likelihood(*as_utf8(pa.array([word])))
    ways = [-np.inf] * 201  # log of the probability up to each letter
    ways[0] = np.log(1e-11)
    for k in range(1, 201):
        ways[k] = np.logaddexp.reduce([ways[k - len(p)] + np.log(1e-11) for p in pieces[1:] if word[:k].endswith(p)])
    assert np.allclose(logs[0], ways[200])
    codes, begin, length, _ = shape.runs(*as_utf8(pa.array([word])), whole=True)
    uses = language.expected_counts(shape, chance, np.zeros(1, np.int64), np.ones(1), codes, begin, length)
    assert np.isfinite(uses).all() and uses[shape.root[shape.code[ord("▁")]], 0] == pytest.approx(1)
    a, b = shape.root[shape.code[ord("a")]], shape.root[shape.code[ord("b")]]
    ab, ba = shape.step[a, shape.code[ord("b")]], shape.step[b, shape.code[ord("a")]]
    assert uses[a, 0] + uses[b, 0] + 2 * (uses[ab, 0] + uses[ba, 0]) + 3 * uses[shape.step[ab, shape.code[ord("a")]], 0] == pytest.approx(200)
