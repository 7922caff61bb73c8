"""From stored pages to candidate articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, text


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", keys.host(url))


def drop_excluded(pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """Exact-match anti join on ``host``; a page without a host stays."""
    return pages.join(excluded.select("host"), "host", "left_anti")


def drop_seen(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Candidates whose key no earlier run has stored.

    The history, of which only the key column is read, is first cut down to the keys
    on offer. Where Catalyst knows those to be few it broadcasts them, and the history
    is not shuffled however long it has grown; otherwise both are shuffled by key.
    """
    offered = candidates.select(key).distinct()
    stored = seen.select(key).join(offered, key, "left_semi").distinct()
    return candidates.join(stored, key, "left_anti")


def with_identity(candidates: DataFrame, key: str = "url", content: str = "sha1") -> DataFrame:
    """``identity``: the key of an article, or its content key where it has none."""
    return candidates.withColumn("identity", F.coalesce(F.col(key), F.concat(F.lit("sha1:"), content)))


def one_per_key(numbered: DataFrame, key: str = "identity", prefer: str = "sha1", number: str = "row") -> DataFrame:
    """One candidate per key, the one with the lowest ``prefer``; ``number`` tells rows apart
    and must be written down. Rows without a key all stay.

    Keys, preferences and numbers are combined on the map side; the rows themselves are
    picked by number.
    """
    winners = numbered.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(prefer, number)).alias("first"))
    kept = numbered.filter(F.col(key).isNotNull()).join(winners.select(f"first.{number}"), number, "left_semi")
    return kept.select(*numbered.columns).unionByName(numbered.filter(F.col(key).isNull()))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the HTML column with ``text``, the visible text."""
    return _extracted(pages, html, text.html_text)


def extract_article(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the HTML column with ``text``, the article alone; '' where a page has none."""
    return _extracted(pages, html, text.article_text)


def _extracted(pages: DataFrame, html: str, extract: Callable[[str], Column]) -> DataFrame:
    """``text`` in place of the HTML, computed in one place.

    A filter on ``text`` would be pushed down through a plain projection, and the
    extraction then run once per mention and before any join above. ``explode`` of a
    one-element array keeps filters above it: every page is extracted once.
    """
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.explode(F.array(extract(html))).alias("text"))
