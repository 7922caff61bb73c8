"""Basic tokens against a plain version, code point by code point."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from credence.functions import text
from credence.operators import encode, profile, subword

IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def plain(value):
    out = ""
    for c in value:
        if c not in "\t\n\r" and (c in "\0�" or unicodedata.category(c) in ("Cc", "Cf")):
            continue
        out += c
    out = "".join(c for c in unicodedata.normalize("NFD", out.lower()) if unicodedata.category(c) != "Mn")
    spaced = ""
    for c in out:
        apart = unicodedata.category(c)[0] == "P" or (ord(c) < 128 and c.isprintable() and not c.isalnum() and c != " ")
        spaced += f" {c} " if apart or any(a <= ord(c) <= b for a, b in IDEOGRAPHS) else c
    return spaced.split()


def settled(k):
    """Whether a code point has had its category since the first Unicode versions."""
    old = unicodedata.ucd_3_2_0.category(chr(k))
    return old not in ("Cn", "Cs", "Co") and old == unicodedata.category(chr(k))


def test_every_code_point_of_the_basic_plane(spark):
    points = [k for k in range(0x10000) if settled(k)]
    assert len(points) > 40_000
    df = spark.createDataFrame([(k, f"a{chr(k)}b {chr(k)}") for k in points], "k int, t string").repartition(8)
    got = {r.k: r.w for r in df.select("k", text.basic_tokens("t").alias("w")).collect()}
    wrong = [hex(k) for k in points if got[k] != plain(f"a{chr(k)}b {chr(k)}")]
    assert wrong == []


@pytest.mark.parametrize("value", [
    "Hello, \"token\" (Reuters) -- it's 3.5%!", "Ünïcödé ÅÇ ñandú ΆΣΑΣ Ёлка", "한국어 텍스트", "漢字kana かな。テスト",
    "tabs\tand\r\nlines\x00gone​joined�", "élève", "", "   ", "!!!", "\U0001F600 smile", "\U00020000x"])
def test_texts(spark, value):
    df = spark.createDataFrame([(value,), (None,)], "t string")
    words, lead = zip(*df.select(text.basic_tokens("t"), text.first_basic_tokens("t", 4)).collect(), strict=True)
    assert words == (plain(value), None) and lead[0] == plain(value)[:4]


def test_sub_words_of_basic_tokens(spark):
    df = spark.createDataFrame([(1, '"Tokens," said Élan.'), (2, "tokens tokens elan"), (3, None)], "id int, text_a string")
    counts = profile.token_frequency(df, "text_a", text.basic_tokens)
    assert {r.token: r["count"] for r in counts.collect()} == {'"': 2, "tokens": 3, ",": 1, "said": 1, "elan": 2, ".": 1}
    vocab = subword.subword_vocabulary(counts, 3)
    ids = {r.token: r.id for r in vocab.collect()}
    out = {r.id: r.input_ids for r in subword.encode_subword(df, vocab, 16, words=text.first_basic_tokens).collect()}
    said = [ids["s"], ids["##a"], ids["##i"], ids["##d"]]
    first = [encode.CLS, ids['"'], ids["tokens"], ids[","], ids['"'], *said, ids["elan"], ids["."], encode.SEP]
    assert out[1] == first + [0] * (16 - len(first))
    assert out[2][:5] == [encode.CLS, ids["tokens"], ids["tokens"], ids["elan"], encode.SEP]
    assert out[3][:3] == [encode.CLS, encode.SEP, 0]
    assert "Python" not in subword.encode_subword(df, vocab, 16, words=text.first_basic_tokens)._jdf.queryExecution().toString()
    assert df.select(F.size(text.basic_tokens("text_a"))).count() == 3


def test_each_different_word_is_cut_once(spark):
    """Counts of basic tokens cut words already counted, and say what cutting whole texts does."""
    given = [("Ab,c Ab,c\tÉté\x0b\x0cx",), ("Ab,c",), (None,), ("\x7f ´ 中文",)]
    texts = spark.createDataFrame(given, "text string")
    whole = texts.select(F.explode(text.basic_tokens("text")).alias("token")).groupBy("token").count()
    counted = profile.token_frequency(texts, words=text.basic_tokens)
    assert sorted(counted.collect()) == sorted(whole.collect())
    assert counted._jdf.queryExecution().analyzed().toString().count("Aggregate [") == 2


def test_first_tokens_where_words_have_none(spark):
    """Words of control characters or marks alone have no token; the words after them make up for it."""
    given = [("\x7f \u0301 a b c",), ("a.b c",), ("\x7f",), (None,), ("",), ("a\x0bb \x1c c d",)]
    texts = spark.createDataFrame(given, "text string")
    got = texts.select(text.first_basic_tokens("text", 2).alias("x")).collect()
    assert [r.x for r in got] == [["a", "b"], ["a", "."], [], None, [], ["ab", "c"]]
