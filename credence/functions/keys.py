"""Keys and names: URL host, content hash, article name, hash-based draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def site_url(line: Column | str) -> Column:
    """A line of a site list as a URL; trailing whitespace of any kind goes."""
    return F.regexp_replace(F.concat(F.lit("https://"), _col(line)), r"(?U)[\s\x1c-\x1f]+$", "")


def host(url: Column | str) -> Column:
    """Third '/'-piece of a URL, port and case kept; null where there is none."""
    return F.try_element_at(F.split(_col(url), "/"), F.lit(3))


def content_key(text: Column | str) -> Column:
    """SHA-1 of the raw text, taken before any cleaning."""
    return F.sha1(_col(text))


def article_name(sha1: Column | str, sentiment: Column | str) -> Column:
    return F.concat_ws("_", _col(sha1), _col(sentiment).cast("string"))


def score_of_name(name: Column | str) -> Column:
    """Digits after the last '_' that has any; null where there are none."""
    digits = F.regexp_extract(_col(name), r"^.*_([0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def polarity(sentiment: Column | str) -> Column:
    """1 (credible) above score 5, else 0."""
    return (_col(sentiment) > 5).cast("int")


def shuffle_key(key: Column | str, seed: int) -> Column:
    """Repeatable random order: rows sorted by it are shuffled the same way every run."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def hex_bucket(hex_digits: Column | str, digits: int) -> Column:
    """The leading hex digits as a number."""
    return F.conv(F.substring(_col(hex_digits), 1, digits), 16, 10).cast("bigint")


def hash_split(sha1: Column | str) -> Column:
    """train / dev / test by content hash: 1 in 101 to dev, 1 in 101 to test."""
    draw = F.pmod(hex_bucket(sha1, 8), F.lit(101))
    return F.when(draw == 0, "dev").when(draw == 1, "test").otherwise("train")
