"""Site dimensions.

They are made from Arrow tables, which Spark plans as local relations of known size:
Catalyst broadcasts them by that size, and a larger replacement table falls back to
a shuffled join by itself. No broadcast is forced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..functions import keys

# Sites crawled as real news.
REAL_NEWS = (
    "http://reuters.com",
    "https://www.bbc.com",
    "https://www.npr.org",
    "https://www.nytimes.com",
    "https://www.wsj.com",
    "https://www.washingtonpost.com",
    "https://www.economist.com",
    "https://www.ap.org",
    "https://www.theatlantic.com",
    "https://gizmodo.com/",
    "https://www.wired.com/",
    "https://www.nature.com/",
    "https://www.vox.com/",
    "https://www.theguardian.com/",
    "https://www.kiro7.com/",
    "https://www.staradvertiser.com/",
    "https://www.independent.co.uk/",
    "https://www.newsweek.com/",
    "https://www.businessinsider.com/",
    "https://www.forbes.com",
    "https://www.bloomberg.com",
)

# Sites crawled as fake news.
FAKE_NEWS = (
    "https://www.oann.com/",
    "https://www.breitbart.com",
    "https://www.infowars.com",
    "https://www.foxnews.com",
    "https://www.theepochtimes.com/",
    "https://mynorthwest.com/",
)

# Credibility score of a site, 1 (least) to 10.
SITE_SCORES = {
    "http://cnn.com": 10,
    "http://reuters.com": 10,
    "https://www.bbc.com": 10,
    "https://www.npr.org": 10,
    "https://www.nytimes.com": 7,
    "https://www.wsj.com": 10,
    "https://www.washingtonpost.com": 7,
    "https://www.economist.com": 10,
    "https://www.ap.org": 10,
    "https://www.theatlantic.com": 10,
    "https://gizmodo.com/": 7,
    "https://www.wired.com/": 7,
    "https://www.nature.com/": 10,
    "https://www.vox.com/": 7,
    "https://www.kiro7.com/": 7,
    "https://www.staradvertiser.com/": 6,
    "https://www.independent.co.uk/": 6,
    "https://www.theguardian.com/": 9,
    "https://www.newsweek.com/": 5,
    "https://www.businessinsider.com/": 5,
    "https://www.breitbart.com": 1,
    "https://www.infowars.com": 1,
    "https://www.foxnews.com": 3,
    "https://mynorthwest.com/": 1,
    "https://www.oann.com/": 2,
    "https://www.theepochtimes.com/": 1,
}

# Foreign-language and help-desk hosts left out of every corpus.
EXCLUDED_HOSTS = (
    "cnnespanol.cnn.com",
    "arabic.cnn.com",
    "br.reuters.com",
    "fr.reuters.com",
    "es.reuters.com",
    "it.reuters.com",
    "cn.reuters.com",
    "reuters.zendesk.com",
    "ru.reuters.com",
    "ara.reuters.com",
    "de.reuters.com",
    "ar.reuters.com",
    "mx.reuters.com",
    "jp.reuters.com",
    "cn.nytimes.com",
)


def concat_site_lists(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One list after another; repeats stay."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out


def score_table(spark: SparkSession, scores: dict[str, int]) -> DataFrame:
    table = pa.table({
        "site": pa.array(list(scores), pa.string()),
        "sentiment": pa.array(list(scores.values()), pa.int32()),
    })
    return spark.createDataFrame(table, schemas.SITE_SCORES)


def site_scores(spark: SparkSession) -> DataFrame:
    return score_table(spark, SITE_SCORES)


def host_table(spark: SparkSession, hosts: tuple[str, ...] | list[str]) -> DataFrame:
    return spark.createDataFrame(
        pa.table({"host": pa.array(list(hosts), pa.string())}), schemas.EXCLUDED_HOSTS
    )


def excluded_hosts(spark: SparkSession) -> DataFrame:
    return host_table(spark, EXCLUDED_HOSTS)


def site_seeds(spark: SparkSession) -> DataFrame:
    def group(sites: tuple[str, ...], name: str) -> DataFrame:
        table = pa.table({
            "site": pa.array(list(sites), pa.string()),
            "group": pa.array([name] * len(sites), pa.string()),
        })
        return spark.createDataFrame(table, schemas.SITE_SEEDS)

    return concat_site_lists(group(REAL_NEWS, "real"), group(FAKE_NEWS, "fake"))


def site_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Bare domains, one per row, as site URLs; repeats stay."""
    return lines.select(keys.site_url(column).alias("site"))


def write_site_list(sites: DataFrame, path: str) -> None:
    """The bare domains of ``SITE_LIST`` rows as lines."""
    sites.select(*schemas.SITE_LIST.names).write.text(path)


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    return site_list(spark.read.text(path))
