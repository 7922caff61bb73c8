"""Union and exact dedupe of corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..session import staging

# Columns that hold whole texts; rows that carry one are not aggregated themselves.
TEXT_COLUMNS = ("text", "sentence", "html")
_ROW = "__row"


def dedupe_exact(
    articles: DataFrame,
    row_id: Sequence[str],
    by: Sequence[str] = ("sha1", "sentiment"),
    texts: Sequence[str] = TEXT_COLUMNS,
    unique_ids: bool = False,
) -> DataFrame:
    """One row per ``by``: the one with the lowest ``row_id``; nulls come first.

    Of rows with an equal ``row_id`` the one whose other columns, texts aside, are lowest
    stays. Without a column of ``texts`` the rows themselves are aggregated: one scan, one
    shuffle. With one, the rows are written down under numbers, only keys and numbers are
    aggregated, and the winners pick their rows by number; where ``unique_ids`` says that no
    two rows share their (never null) ``row_id``, that stands for the number and nothing is
    written. Either way copies are combined on the map side, so a text copied into a third
    of all rows is one row per task, and no text is aggregated.
    """
    plain = [c for c in articles.columns if c not in by and c not in row_id and c not in texts]
    chosen = [c for c in row_id if c not in by]
    if not set(texts) & set(articles.columns):
        return _lowest(articles, chosen, by, plain).select(*articles.columns)
    if unique_ids:
        winners = _lowest(articles, chosen, by, []).select(*row_id)
        return articles.join(winners, list(row_id), "left_semi")
    numbered = staging(articles.withColumn(_ROW, F.monotonically_increasing_id()))
    winners = _lowest(numbered, chosen, by, [*plain, _ROW]).select(_ROW)
    return numbered.join(winners, _ROW, "left_semi").select(*articles.columns)


def _lowest(rows: DataFrame, row_id: Sequence[str], by: Sequence[str], others: Sequence[str]) -> DataFrame:
    if len(row_id) == 1 and not others:
        # A plain numeric minimum keeps the aggregation in a hash map.
        return rows.groupBy(*by).agg(F.min(row_id[0]).alias(row_id[0]))
    if not row_id and not others:
        return rows.select(*by).distinct()
    lowest = F.min(F.struct(*row_id, *others)).alias("lowest")
    return rows.groupBy(*by).agg(lowest).select(*by, "lowest.*")


def concat_labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Positive and negative frames under a ``polarity`` column."""
    return positive.withColumn("polarity", F.lit(1)).unionByName(
        negative.withColumn("polarity", F.lit(0))
    )


def combine_corpora(
    known: DataFrame, listed: DataFrame, row_id: Sequence[str] = ("corpus", "sha1", "url"),
    by: Sequence[str] = ("sha1", "sentiment"),
) -> DataFrame:
    """Known articles and the *negative* listed ones, one per content key and score."""
    both = known.unionByName(listed.filter(F.col("polarity") == 0))
    return dedupe_exact(both, row_id, by)


def with_article_name(articles: DataFrame) -> DataFrame:
    return articles.withColumn("name", keys.article_name("sha1", "sentiment"))
