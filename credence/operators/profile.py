"""Token frequencies and their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def token_frequency(articles: DataFrame, column: str = "text", words: Callable[[str], Column] = text.split_words) -> DataFrame:
    """``token, count`` over whole texts; hot tokens are combined before the shuffle.

    ``words`` cuts a text: ``text.split_words``, or ``text.basic_tokens`` for word pieces. These
    take long to cut, so words as they stand are counted first and each different one is cut once.
    """
    if words is text.basic_tokens:
        raw = articles.select(F.explode(text.gap_words(column)).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
        cut = raw.select("count", F.explode(words("word")).alias("token"))
        return cut.groupBy("token").agg(F.sum("count").alias("count"))
    pieces = articles.select(F.explode(words(column)).alias("token"))
    return pieces.filter(F.col("token") != "").groupBy("token").agg(F.count("*").alias("count"))


def by_count(counts: DataFrame) -> DataFrame:
    """Rarest first; equal counts in token order, so the order is repeatable."""
    return counts.orderBy("count", "token")
