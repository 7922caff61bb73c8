"""Vocabulary and fixed-length id arrays.

Encoding explodes at most ``max_len`` tokens per document, looks them up in the
vocabulary and folds each document's tokens into one row before anything is shuffled.
The shuffle is by document id alone: texts do not travel, and a table bucketed by that
id needs no shuffle at all. Catalyst broadcasts the vocabulary when its size (the row
limit it was built with, or the files it is read from) is below the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_TOKEN_ID = 4


def vocabulary(counts: DataFrame, n: int) -> DataFrame:
    """``token, id`` of the ``n`` most frequent tokens; ids follow the special ones."""
    order = [F.col("count").desc(), F.col("token")]
    top = counts.orderBy(*order).limit(n)
    # Unpartitioned, but over the n rows of the limit only.
    rank = F.row_number().over(W.orderBy(*order))
    return top.select("token", (rank + (FIRST_TOKEN_ID - 1)).cast("int").alias("id"))


def pair_lengths(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Tokens kept of each text when the longer one is trimmed first, token by token.

    On equal lengths the second text loses a token first. Lengths may be capped at
    ``budget`` beforehand; the result is the same.
    """
    m = F.lit(budget)
    half_up, half_down = -(-budget // 2), budget // 2
    return (
        F.least(a, F.greatest(m - b, F.lit(half_up))),
        F.least(b, F.greatest(m - a, F.lit(half_down))),
    )


def assemble(ids: Column, n_a: Column, n_b: Column, max_len: int) -> list[Column]:
    """``input_ids, input_mask, segment_ids`` from the ids of text a followed by text b."""
    empty = F.array().cast("array<int>")
    second = F.when(n_b > 0, F.concat(F.slice(ids, n_a + 1, n_b), F.array(F.lit(SEP)))).otherwise(empty)
    n_second = F.when(n_b > 0, n_b + 1).otherwise(0)
    padding = F.array_repeat(F.lit(PAD), max_len)

    def fit(*parts: Column) -> Column:
        return F.slice(F.concat(*parts, padding), 1, max_len)

    return [
        fit(F.array(F.lit(CLS)), F.slice(ids, F.lit(1), n_a), F.array(F.lit(SEP)), second).alias("input_ids"),
        fit(F.array_repeat(F.lit(1), (n_a + 2 + n_second).cast("int"))).alias("input_mask"),
        fit(F.array_repeat(F.lit(0), (n_a + 2).cast("int")), F.array_repeat(F.lit(1), n_second.cast("int")))
        .alias("segment_ids"),
    ]


def _look_up(tokenized: DataFrame, vocab: DataFrame, row: Sequence[str], max_len: int) -> DataFrame:
    """Rows with ``tokens, n_a, n_b`` to rows of features, by the join with the vocabulary."""
    ids = vocab.select("token", F.col("id").alias("token_id"))
    pieces = tokenized.select(*row, "n_a", "n_b", F.posexplode_outer("tokens").alias("pos", "token"))
    # Position and id in one BIGINT: half the width of a struct, and sorted as a primitive.
    packed = F.when(
        F.col("pos").isNotNull(),
        F.shiftleft(F.col("pos").cast("bigint"), 32) + F.coalesce("token_id", F.lit(UNK)),
    )
    folded = (
        pieces.join(ids, "token", "left").select(*row, "n_a", "n_b", packed.alias("packed"))
        .groupBy(*row, "n_a", "n_b").agg(F.sort_array(F.collect_list("packed")).alias("packed"))
        .withColumn("ids", F.transform("packed", lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int")))
    )
    return folded.select(*row, *assemble(F.col("ids"), F.col("n_a"), F.col("n_b"), max_len))


def encode_single(
    examples: DataFrame, vocab: DataFrame, max_len: int, id: str = "id", text_a: str = "text_a",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Encode ``text_a`` of every row; ``id`` identifies a row, ``keep`` is carried along."""
    tokenized = examples.select(
        id, *keep, F.coalesce(text.first_tokens(text_a, max_len - 2), F.array().cast("array<string>")).alias("tokens")
    ).select("*", F.size("tokens").alias("n_a"), F.lit(0).alias("n_b"))
    return _look_up(tokenized, vocab, [id, *keep], max_len)


def encode_pair(
    examples: DataFrame, vocab: DataFrame, max_len: int, id: str = "id", text_a: str = "text_a",
    text_b: str = "text_b", keep: Sequence[str] = (),
) -> DataFrame:
    """Encode two texts per row; a row without a second text is encoded as a single one."""
    budget = max_len - 3
    none = F.array().cast("array<string>")
    # One token past the pair budget fits where there is no second text.
    tokenized = examples.select(
        id, *keep,
        F.coalesce(text.first_tokens(text_a, max_len - 2), none).alias("a"),
        F.coalesce(text.first_tokens(text_b, budget), none).alias("b"),
    )
    a, b = F.least(F.size("a"), F.lit(budget)), F.size("b")
    n_a, n_b = pair_lengths(a, b, budget)
    sized = tokenized.select(
        "*",
        F.when(b > 0, n_a).otherwise(F.size("a")).cast("int").alias("n_a"),
        F.when(b > 0, n_b).otherwise(0).cast("int").alias("n_b"),
    )
    cut = sized.withColumn("tokens", F.concat(F.slice("a", F.lit(1), F.col("n_a")), F.slice("b", F.lit(1), F.col("n_b"))))
    return _look_up(cut.drop("a", "b"), vocab, [id, *keep], max_len)


def repeated_ids(examples: DataFrame, id: str = "id") -> DataFrame:
    """How many rows share their id with another one; encoding merges such rows into one."""
    per_id = examples.groupBy(id).agg(F.count("*").alias("rows"))
    return per_id.agg(F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("repeated"))


def quality(features: DataFrame, max_len: int) -> DataFrame:
    """Counts that must be zero: arrays of the wrong length, and labels outside the list.

    Rows that had one id before encoding are counted by ``repeated_ids``.
    """
    return features.agg(
        F.count("*").alias("rows"),
        F.count_if(F.size("input_ids") != max_len).alias("bad_ids"),
        F.count_if(F.size("input_mask") != max_len).alias("bad_mask"),
        F.count_if(F.size("segment_ids") != max_len).alias("bad_segments"),
        F.count_if(F.col("label_id").isNull()).alias("unknown_labels"),
    )
