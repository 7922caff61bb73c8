"""Counts over sites, corpora and loads; all combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def reason_counts(
    pages: DataFrame, excluded: DataFrame, scores: DataFrame, words: int = 50
) -> DataFrame:
    """``site, reason, count`` of pages (``site, host, text``): why each was left out, the
    first cause in pipeline order (excluded, failed, too_short, unscored), or ``kept``.

    Pages are counted by site, host and what their text shows before anything is
    joined: a site that fills the crawl is one row per task, and the joins see sites.
    """
    failed = F.col("text").isNull() | F.col("host").isNull()
    tallied = pages.groupBy(
        "site", "host", failed.alias("failed"),
        F.coalesce(~text.has_min_words("text", words), F.lit(False)).alias("too_short"),
    ).agg(F.count("*").alias("pages"))
    marks = excluded.select("host").distinct().withColumn("is_excluded", F.lit(True))
    reason = (
        F.when(F.col("is_excluded"), "excluded").when(F.col("failed"), "failed")
        .when(F.col("too_short"), "too_short").when(F.col("sentiment").isNull(), "unscored")
        .otherwise("kept")
    )
    return (
        tallied.join(marks, "host", "left").join(scores, "site", "left")
        .groupBy("site", reason.alias("reason")).agg(F.sum("pages").alias("count"))
    )


def _found_and_included() -> tuple[Column, Column]:
    kept = F.when(F.col("reason") == "kept", F.col("count")).otherwise(0)
    return F.sum("count").alias("found"), F.sum(kept).alias("included")


def site_counts(reasons: DataFrame) -> DataFrame:
    """Articles found and included per site, from ``reason_counts``."""
    return reasons.groupBy("site").agg(*_found_and_included())


def site_rollup(reasons: DataFrame) -> DataFrame:
    """``site_counts`` and the grand total (``is_total`` = 1), from ``reason_counts``."""
    return reasons.rollup("site").agg(
        *_found_and_included(), F.grouping("site").cast("int").alias("is_total"),
    )


def polarity_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("corpus", "polarity").agg(F.count("*").alias("count"))


def corpus_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("corpus").agg(F.count("*").alias("count"))


def load_counts(scanned: DataFrame) -> DataFrame:
    """Files loaded, failed and read as empty, per polarity (``with_load_status`` rows)."""
    return scanned.groupBy("polarity").agg(
        F.count_if("loaded").alias("success"),
        F.count_if(~F.col("loaded")).alias("fails"),
        F.count_if(text.decode_or_empty("value") == "").alias("empty"),
    )
