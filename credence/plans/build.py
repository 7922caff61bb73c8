"""Raw articles to cleaned, merged corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merge, tally
from ..sources import articles, scans


def clean_articles(
    raw: DataFrame, mode: str = "literal", tokens: Sequence[str] = text.BOILERPLATE_TOKENS
) -> DataFrame:
    """Cleans ``text``; the content key stays that of the raw text."""
    return raw.withColumn("text", text.clean("text", mode, tokens))


def raw_folders(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Raw articles of ``{corpus: folder}``."""
    frames = [
        scans.article_files(scans.scan_files(spark, root)).withColumn("corpus", F.lit(corpus))
        for corpus, root in roots.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def raw_table(stored: DataFrame) -> DataFrame:
    """Raw articles of an article table, under the names files would have."""
    return merge.with_article_name(stored).select("name", "sha1", "sentiment", "polarity", "text", "corpus")


def build_corpora(raw: DataFrame, out: str, mode: str = "literal") -> DataFrame:
    """Cleans raw articles, writes ``out``; returns counts of what was written.

    A second run replaces the first.
    """
    cleaned = clean_articles(raw, mode)
    articles.write_articles(cleaned, out)
    return tally.polarity_counts(articles.read_articles(raw.sparkSession, out, cleaned.schema))


def known(processed: DataFrame) -> DataFrame:
    """The known corpus alone of a processed table, one per content key and score."""
    return merge.dedupe_exact(processed.filter(F.col("corpus") == "known"), ("name",))


def combined(processed: DataFrame) -> DataFrame:
    """The combined corpus of a processed table (``corpus`` 'known' and 'listed')."""
    known = processed.filter(F.col("corpus") == "known")
    listed = processed.filter(F.col("corpus") == "listed")
    return merge.combine_corpora(known, listed, row_id=("corpus", "name"))
