"""Samples, splits, vocabulary and encoding."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from credence import schemas
from credence.functions import keys
from credence.operators import encode, profile, sample, subword


def plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


# --- samples

@pytest.mark.parametrize("n", [0, 1, 37, 1000, 5000, 6000])
@pytest.mark.parametrize("digits", [1, 5])
def test_sample_is_the_head_of_the_shuffled_order(spark, n, digits):
    df = spark.range(5000, numPartitions=6).withColumn("v", F.col("id") * 2)
    drawn = [r["id"] for r in sample.sample_n(df, n, "id", 3, digits).collect()]
    whole = [r["id"] for r in sample.shuffle(df, "id", 3).collect()]
    assert drawn == whole[:n]
    assert sorted(whole) == list(range(5000)) and whole != sorted(whole)


def test_sample_of_nothing(spark):
    assert sample.sample_n(spark.range(0), 5, "id", 1).count() == 0


def test_seed_changes_the_sample(spark):
    df = spark.range(1000)
    first, again, other = ([r["id"] for r in sample.sample_n(df, 20, "id", s).collect()] for s in (1, 1, 2))
    assert first == again != other


def test_sample_counts_by_key_only_and_passes_on_few_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000, numPartitions=4).withColumn("text", F.lit("x" * 50)).write.parquet(path)
    df = spark.read.parquet(path)
    drawn = sample.sample_n(df, 100, "id", 7)
    text = plan(drawn)
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text
    subquery = text[text.index("Subquery"):text.index("FileScan")]
    assert "text#" not in subquery
    bound_rows = df.filter(keys.hex_bucket(keys.shuffle_key("id", 7), 4) <= 100 / 20_000 * 65536 * 2).count()
    assert bound_rows < 400 and drawn.count() == 100


def test_slices_leave_gaps_and_do_not_overlap(spark):
    drawn = sample.sample_n(spark.range(12_000), 10_000, "id", 7)
    parts = sample.slice_split(drawn, "id")
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts == {"train": 100, "dev": 499, "test": 498}
    positions = {r["position"] for r in parts.collect()}
    assert len(positions) == 1097 and not positions & {100, 9000, 9500, 9999}


@pytest.mark.parametrize("rows,per_range", [(0, 10), (1, 10), (997, 100), (997, 5000), (40, 1)])
def test_position_equals_the_window_without_one_task(spark, rows, per_range):
    df = spark.range(rows).withColumn("k", F.sha1(F.col("id").cast("string"))).repartition(5)
    placed = sample.with_position(df, "k", "id", rows_per_range=per_range)
    wanted = df.withColumn("position", F.row_number().over(W.orderBy("k", "id")) - 1)
    assert {(r.id, r.position) for r in placed.collect()} == {(r.id, r.position) for r in wanted.collect()}
    text = plan(placed)
    assert "SinglePartition" not in text and "rangepartitioning" not in text
    if rows > 2 * per_range > 2:
        assert placed.select(F.spark_partition_id()).distinct().count() > 1


def test_slices_of_a_sample_of_any_size(spark):
    drawn = sample.sample_n(spark.range(3_000), 3_000, "id", 7)
    whole = {(r.id, r.position, r.split) for r in sample.slice_split(drawn, "id", sample.scaled_slices(3000)).collect()}
    parts = {(r.id, r.position, r.split) for r in sample.slice_split(drawn, "id", sample.scaled_slices(3000), rows_per_range=300).collect()}
    assert whole == parts and len(parts) == 2700 + 149 + 148


def test_scaled_slices_keep_their_gaps():
    assert sample.scaled_slices(10_000) == sample.WIDE_SLICES
    assert sample.scaled_slices(1000) == {"train": (0, 900), "dev": (901, 950), "test": (951, 999)}
    assert sample.scaled_slices(0) == {"train": (0, 0), "dev": (0, 0), "test": (0, 0)}


def test_fewer_rows_than_the_slices_want(spark):
    parts = sample.slice_split(sample.sample_n(spark.range(50), 10_000, "id", 7), "id")
    assert {r["split"] for r in parts.collect()} == {"train"} and parts.count() == 50


def test_preview(spark):
    assert [r["id"] for r in sample.preview(spark.range(100).orderBy(F.desc("id")), "id").collect()] == [0, 1, 2, 3, 4]


# --- vocabulary and single texts

@pytest.fixture
def vocab(spark):
    # An Arrow table, like a vocabulary read from files, has a size Catalyst knows.
    table = pa.table({"token": ["a", "b"], "id": pa.array([4, 5], pa.int32())})
    return spark.createDataFrame(table, schemas.VOCABULARY)


def test_vocabulary_order(spark):
    counts = spark.createDataFrame([("x", 2), ("b", 5), ("a", 5), ("rare", 1)], schemas.TOKEN_COUNTS)
    got = [(r["token"], r["id"]) for r in encode.vocabulary(counts, 3).orderBy("id").collect()]
    assert got == [("a", 4), ("b", 5), ("x", 6)]
    assert encode.vocabulary(counts, 10).count() == 4


def test_long_tokens_have_ids_too(spark):
    long = "y" * 5000
    counts = spark.createDataFrame([("x", 3), (long, 9), (long + "z", 1)], schemas.TOKEN_COUNTS)
    vocab = encode.vocabulary(counts, 2)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {long: 4, "x": 5}
    assert encoded(spark, vocab, [f"x {long} {long}z"], 6)[0][0] == [2, 5, 4, 1, 3, 0]


def test_repeated_ids_are_reported(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, text_a string")
    assert encode.repeated_ids(df).first()["repeated"] == 2
    assert encode.repeated_ids(df.filter("id = 2")).first()["repeated"] == 0


def arrays(row):
    return row["input_ids"], row["input_mask"], row["segment_ids"]


def encoded(spark, vocab, texts, max_len):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text_a string")
    out = encode.encode_single(df, vocab, max_len)
    got = {r["id"]: arrays(r) for r in out.collect()}
    return [got[i] for i in range(len(texts))]


def test_encode_single_hand_rows(spark, vocab):
    assert encoded(spark, vocab, ["a b"], 6) == [([2, 4, 5, 3, 0, 0], [1, 1, 1, 1, 0, 0], [0] * 6)]
    short = encoded(spark, vocab, ["zzz", "A B a", "", None, " \n "], 4)
    assert [s[0] for s in short] == [[2, 1, 3, 0], [2, 4, 5, 3], [2, 3, 0, 0], [2, 3, 0, 0], [2, 3, 0, 0]]
    assert [s[1] for s in short] == [[1, 1, 1, 0], [1] * 4, [1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 0, 0]]


def test_encode_keeps_order_of_many_tokens(spark):
    words = [f"w{i}" for i in range(300)]
    vocab = spark.createDataFrame([(w, i + 4) for i, w in enumerate(words)], schemas.VOCABULARY)
    (ids, mask, _), = encoded(spark, vocab, [" ".join(reversed(words))], 256)
    assert ids == [2, *[i + 4 for i in range(299, 45, -1)], 3] and mask == [1] * 256


def test_quality_counts(spark, vocab):
    df = spark.createDataFrame([(1, "a", 0), (2, "b b b b b b", None)], "id int, text_a string, label_id int")
    features = encode.encode_single(df, vocab, 5, keep=("label_id",))
    assert tuple(encode.quality(features, 5).first()) == (2, 0, 0, 0, 1)
    assert tuple(encode.quality(features, 6).first()) == (2, 2, 2, 2, 1)


def test_vocabulary_is_broadcast_and_only_ids_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "a b c " * 9) for i in range(50)], "id long, text_a string").write.parquet(path)
    df = spark.read.parquet(path)
    learned = encode.vocabulary(profile.token_frequency(df, "text_a"), 100)
    text = plan(encode.encode_single(df, learned, 8))
    main = text[:text.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in main and "SortMergeJoin" not in text
    assert main.count("Exchange hashpartitioning(id#") == 1
    assert "Python" not in text


def test_bucketed_documents_are_encoded_without_a_shuffle(spark, vocab):
    spark.sql("DROP TABLE IF EXISTS bucketed_docs")
    docs = spark.createDataFrame([(i, "a b") for i in range(40)], "id long, text_a string")
    docs.write.bucketBy(4, "id").sortBy("id").saveAsTable("bucketed_docs")
    out = encode.encode_single(spark.table("bucketed_docs"), vocab, 6)
    assert "Exchange hashpartitioning(id#" not in plan(out)
    assert out.count() == 40
    spark.sql("DROP TABLE bucketed_docs")


# --- pairs

def test_pair_lengths_equal_popping_the_longer(spark):
    def pop(a, b, budget):
        while a + b > budget:
            if a > b:
                a -= 1
            else:
                b -= 1
        return a, b

    cases = [(a, b) for a in range(30) for b in range(30)]
    df = spark.createDataFrame(cases, "a int, b int")
    for budget in range(1, 40, 3):
        n_a, n_b = encode.pair_lengths(F.col("a"), F.col("b"), budget)
        got = {(r["a"], r["b"]): (r["x"], r["y"]) for r in df.select("a", "b", n_a.alias("x"), n_b.alias("y")).collect()}
        assert got == {(a, b): pop(a, b, budget) for a, b in cases}


def test_encode_pair_hand_rows(spark, vocab):
    df = spark.createDataFrame(
        [(1, "a b", "a"), (2, "a b a", "b b b"), (3, "a b", None), (4, "a a a a a a a a", " "), (5, "", "b")],
        "id int, text_a string, text_b string",
    )
    got = {r["id"]: arrays(r) for r in encode.encode_pair(df, vocab, 8).collect()}
    assert got[1] == ([2, 4, 5, 3, 4, 3, 0, 0], [1] * 6 + [0, 0], [0, 0, 0, 0, 1, 1, 0, 0])
    assert got[2][0] == [2, 4, 5, 4, 3, 5, 5, 3]
    assert got[3] == ([2, 4, 5, 3, 0, 0, 0, 0], [1] * 4 + [0] * 4, [0] * 8)
    assert got[4][0] == [2, 4, 4, 4, 4, 4, 4, 3]
    assert got[5] == ([2, 3, 5, 3, 0, 0, 0, 0], [1] * 4 + [0] * 4, [0, 0, 1, 1, 0, 0, 0, 0])
    short = {r["id"]: r["input_ids"] for r in encode.encode_pair(df, vocab, 6).collect()}
    assert short[2] == [2, 4, 5, 3, 5, 3]


# --- sub-words

def split_all(spark, pieces, words, at_most=1000):
    vocab = spark.createDataFrame(list(pieces.items()), schemas.VOCABULARY)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: r["ids"] for r in subword.word_pieces(df, vocab, at_most).collect()}


def greedy(pieces, word):
    ids, start = [], 0
    while start < len(word):
        prefix = "##" if start else ""
        end = next((e for e in range(len(word), start, -1) if prefix + word[start:e] in pieces), None)
        if end is None:
            return None
        ids.append(pieces[prefix + word[start:end]])
        start = end
    return ids


def test_greedy_longest_match(spark):
    pieces = {"un": 4, "unaff": 5, "##aff": 6, "##able": 7, "a": 8, "##a": 9, "é😀": 10, "##😀": 11, "##": 12}
    got = split_all(spark, pieces, ["unaffable", "unaa", "a" * 200, "a" * 700, "unx", "é😀😀", "##a"])
    assert got == {"unaffable": [5, 7], "unaa": [4, 9, 9], "a" * 200: [8] + [9] * 199, "a" * 700: [8] + [9] * 699, "é😀😀": [10, 11], "##a": [9]}
    assert split_all(spark, pieces, ["a" * 300], 5) == {"a" * 300: [8, 9, 9, 9, 9]}


def test_greedy_match_of_random_words(spark):
    rng = random.Random(4)
    alphabet = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)]
    pieces = {p: i + 4 for i, p in enumerate({*alphabet, *("##" + p for p in alphabet), "##a", "##b", "a", "b"})}
    words = ["".join(rng.choices("abc", k=rng.randint(1, 600))) for _ in range(60)] + ["".join(rng.choices("ab", k=9)) for _ in range(60)]
    want = {w: ids for w in words if (ids := greedy(pieces, w)) is not None}
    assert split_all(spark, pieces, sorted(set(words))) == want and len(want) > 50


def test_subword_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, "abab ab ab c"), (2, ""), (3, None), (4, "abc " * 50), (5, "ab zz c")], "id int, text_a string")
    counts = profile.token_frequency(df.filter("id = 1"), "text_a")
    vocab = subword.subword_vocabulary(counts, 1)
    pieces = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(pieces) == ["##a", "##ab", "##b", "##c", "a", "ab", "b", "c"]
    assert sorted(pieces.values()) == list(range(4, 12))
    out = {r["id"]: arrays(r) for r in subword.encode_subword(df, vocab, 8).collect()}
    assert subword.encode_subword(df.limit(0), vocab, 8).count() == 0
    ab, rest, c = pieces["ab"], pieces["##ab"], pieces["c"]
    assert out[1][0] == [2, ab, rest, ab, ab, c, 3, 0]
    assert out[2][0] == out[3][0] == [2, 3, 0, 0, 0, 0, 0, 0]
    assert out[4][0] == [2, *[ab, pieces["##c"]] * 3, 3]
    assert out[5][0] == [2, ab, encode.UNK, c, 3, 0, 0, 0]
    none = vocab.filter("false")
    assert {r["id"]: r["input_ids"] for r in subword.encode_subword(df, none, 8).collect()}[5] == [2, 1, 1, 1, 3, 0, 0, 0]


def test_subword_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text_a string")
    vocab = spark.createDataFrame([("a", 4)], schemas.VOCABULARY)
    assert "Python" not in plan(subword.encode_subword(df, vocab, 8))
