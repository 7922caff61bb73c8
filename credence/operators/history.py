"""What earlier runs have stored, as a Bloom filter in pages beside the table.

A key's hash picks one page of 32,768 bits and sets ``PROBES`` bits in it. A run appends the pages
of its own keys; a page is the union of what all runs wrote for it. A key with a bit missing was
never stored. The others may have been, and only they are compared with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_BITS = 32_768
PROBES = 6
KEYS_PER_PAGE = 3_000  # about eleven bits for each key: one new key in two hundred looks seen


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("page"), key), F.lit(pages))


def _bits(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), key), F.lit(PAGE_BITS)) for k in range(PROBES)])


def filter_pages(keys: DataFrame, key: str, pages: int) -> DataFrame:
    """``page, keys, bits``: a row for each page in use, null keys left out."""
    each = keys.filter(F.col(key).isNotNull()).select(_page(F.col(key), pages).alias("page"), F.explode(_bits(F.col(key))).alias("bit"))
    return each.groupBy("page").agg(F.floor(F.count("*") / PROBES).alias("keys"), F.bitmap_construct_agg("bit").alias("bits"))


def maybe_seen(candidates: DataFrame, key: str, filters: DataFrame, pages: int) -> DataFrame:
    """``candidates`` with ``maybe``: false where the key was certainly not stored; null keys never were.

    The filter's pages are joined with the keys on offer by page. Where those are few, they are
    broadcast and only the pages are read; no key of the history is.
    """
    whole = filters.groupBy(F.col("page").alias("__page")).agg(F.bitmap_or_agg("bits").alias("bits"))
    joined = candidates.withColumn("__page", _page(F.col(key), pages)).join(whole, "__page", "left")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    found = F.forall(_bits(F.col(key)), is_set)
    return joined.withColumn("maybe", F.col(key).isNotNull() & F.coalesce(found, F.lit(False))).drop("__page", "bits")


def pages_for(keys: int) -> int:
    """Pages of a filter for so many keys and as many again that come later."""
    return max(1, -(-2 * keys // KEYS_PER_PAGE))


class Filters:
    """The filters in ``folder``: one generation for each number of pages, of which the largest counts.

    A generation is a folder of its own and counts from when its first write has ended, so one
    that was being made when a run failed is not read. Later runs append to it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        whole = [n for n in names if n.isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        self.pages = max(map(int, whole), default=0)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("page long, keys long, bits binary").parquet(f"{self.folder}/{self.pages}")

    def add(self, keys: DataFrame, key: str) -> None:
        filter_pages(keys, key, self.pages).write.mode("append").parquet(f"{self.folder}/{self.pages}")

    def rebuild(self, keys: DataFrame, key: str, count: int) -> None:
        """A generation for ``count`` keys, these; what a failed run left of it is replaced."""
        pages = max(pages_for(count), self.pages + 1)
        filter_pages(keys, key, pages).write.mode("overwrite").parquet(f"{self.folder}/{pages}")
        self.pages = pages

    def full(self) -> bool:
        return (self.rows().agg(F.sum("keys")).first()[0] or 0) > self.pages * KEYS_PER_PAGE
