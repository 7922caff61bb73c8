"""Scores, polarity, content keys and the example projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys


def attach_score(articles: DataFrame, scores: DataFrame, keep_unscored: bool = False) -> DataFrame:
    """Joins ``sentiment`` by ``site``; unscored sites go unless asked for."""
    return articles.join(scores, "site", "left" if keep_unscored else "inner")


def attach_constant_score(articles: DataFrame, score: int = 1) -> DataFrame:
    """One score for a whole listed corpus; 1 is least credible."""
    return articles.withColumn("sentiment", F.lit(score).cast("int"))


def unscored_sites(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Sites without a score and how many articles each has (counted before the join)."""
    per_site = articles.groupBy("site").agg(F.count("*").alias("articles"))
    return per_site.join(scores.select("site"), "site", "left_anti")


def attach_polarity(articles: DataFrame) -> DataFrame:
    return articles.withColumn("polarity", keys.polarity("sentiment"))


def attach_content_key(articles: DataFrame, text: str = "text") -> DataFrame:
    return articles.withColumn("sha1", keys.content_key(text))


def as_examples(
    labelled: DataFrame, text: str = "sentence", label: str = "sentiment", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``text_a, text_b (null), label`` from a text column and either label column."""
    return labelled.select(
        *keep,
        F.col(text).alias("text_a"),
        F.lit(None).cast("string").alias("text_b"),
        F.col(label).alias("label"),
    )


def label_index(label: Column | str, label_list: list[int]) -> Column:
    """Position of a label in the label list; null for a label outside it."""
    position = F.array_position(F.lit([int(x) for x in label_list]), F.col(label) if isinstance(label, str) else label)
    return F.nullif(position - 1, F.lit(-1)).cast("int")


def label_name(label_id: Column | str, names: tuple[str, ...] = ("Negative", "Positive")) -> Column:
    """Name of a label id; null outside the names."""
    index = F.col(label_id) if isinstance(label_id, str) else label_id
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))
