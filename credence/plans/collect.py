"""Stored pages to scored articles: the article of each page, not its menus and notices, is measured and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas, session
from ..functions import text
from ..operators import ingest, label, merge
from ..sources import articles


def _as_articles(scored: DataFrame, corpus: str) -> DataFrame:
    labelled = label.attach_polarity(label.attach_content_key(scored))
    return labelled.withColumn("corpus", F.lit(corpus)).select(*schemas.ARTICLES.names)


def _texts(pages: DataFrame, long_enough: Column) -> DataFrame:
    return ingest.extract_article(pages).filter(long_enough)


def known_articles(
    pages: DataFrame, excluded: DataFrame, scores: DataFrame, words: int = 50
) -> DataFrame:
    """Pages (``site, url, html``) of known sites: excluded hosts, short texts and sites
    without a score go; the score of the site is the score of the article."""
    allowed = ingest.drop_excluded(ingest.with_host(pages), excluded)
    texts = _texts(label.attach_score(allowed, scores), text.has_min_words("text", words))
    return _as_articles(texts, "known")


def listed_articles(pages: DataFrame, chars: int = 1000, score: int = 1) -> DataFrame:
    """Pages of a listed (not credible) group of sites: all share one score."""
    texts = _texts(pages, text.has_min_chars("text", chars))
    return _as_articles(label.attach_constant_score(texts, score), "listed")


def store_articles(found: DataFrame, out: str) -> None:
    """Writes one article per content key and score, the one with the lowest URL; a second
    run replaces the first.

    The articles are written down once, so that picking one copy reads keys, not pages.
    """
    with session.work_folder(found.sparkSession):
        articles.write_articles(merge.dedupe_exact(found, ["url"]), out)
