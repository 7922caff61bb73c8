"""The article table: written by corpus and polarity, read back with both pruned; or clustered by id."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas


def write_articles(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by ``corpus, polarity``; a second run replaces the first."""
    articles.write.mode(mode).partitionBy("corpus", "polarity").parquet(path)


def read_articles(spark: SparkSession, path: str, schema: T.StructType = schemas.ARTICLES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_clustered(articles: DataFrame, table: str, id: str, buckets: int) -> None:
    """A catalogue table in ``buckets`` files' worth of parts by hash of ``id``, each sorted by it.

    What groups or joins by that id later on reads the parts as they are; the articles are not
    shuffled again. Rows are dealt to their bucket once before they are written, so a bucket
    is one file. A second run replaces the first.
    """
    dealt = articles.repartition(buckets, id)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, id).sortBy(id).saveAsTable(table)


def clustered_for_session(articles: DataFrame, id: str, buckets: int) -> DataFrame:
    """``write_clustered`` under a fresh name, read back; the table goes when the driver ends."""
    spark = articles.sparkSession
    name = f"credence_{uuid.uuid4().hex}"
    write_clustered(articles, name, id, buckets)

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may have gone before
            spark.sql(f"DROP TABLE IF EXISTS {name}")

    atexit.register(drop)
    return spark.table(name)
