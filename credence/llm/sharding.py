"""Random order of a corpus that fits no memory, in two passes.

First pass: every record goes to a shard and, inside it, to one of many buckets that fit in
memory, both by seeded hashes. Second pass: each bucket is shuffled by Fisher-Yates with a
generator seeded by its number, and written. A shard is its buckets after each other.

The shard of a record is the one with the highest hash of (seed, shard, doc_id), so it depends
on doc_id and the number of shards alone, and one more shard takes records only into itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, staged

BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 4
BROADCAST_BUCKETS = 500_000


def shard_column(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash; the first of equal ones. A null id is an id like others."""
    score = F.array(*(F.xxhash64(F.lit(seed), F.lit(k), doc_id) for k in range(shards)))
    return (F.array_position(score, F.array_max(score)) - 1).cast("int")


def fisher_yates(size: int, random: np.random.Generator) -> list[int]:
    """A uniformly random order of ``size`` places."""
    order = list(range(size))
    draw = random.random(size)
    for k in range(size - 1, 0, -1):
        j = int(draw[k] * (k + 1))
        order[k], order[j] = order[j], order[k]
    return order


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write all rows and columns of ``docs`` with shard, bucket and position in the bucket.

    Buckets are as many as hold ``bucket_bytes`` of text each, and ``LEAST_BUCKETS`` in each
    shard; records go to them by a hash of all their columns, so that equal or null ids spread.
    Columns named shard, bucket, position or order_key are replaced. The order depends on the
    records, seed and number of buckets only, so reruns agree. Null texts count as no bytes.
    """
    names = ("shard", "bucket", "position", "order_key")
    docs = docs.drop(*names)
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / shards / bucket_bytes))
    key = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in docs.columns))
    dealt = docs.select(
        "*", shard_column(F.col("doc_id"), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(buckets)).cast("int").alias("bucket"), key.alias("order_key"))
    schema = dealt.drop("order_key").withColumn("position", F.lit(0)).schema

    def shuffle(table: pa.Table) -> pa.Table:
        shard, bucket = table["shard"][0].as_py(), table["bucket"][0].as_py()
        ordered = table.sort_by([("order_key", "ascending"), ("doc_id", "ascending")]).drop_columns(["order_key"])
        order = fisher_yates(len(ordered), np.random.Generator(np.random.PCG64([seed, shard, bucket])))
        return ordered.take(pa.array(order, pa.int64())).append_column("position", pa.array(np.arange(len(order), dtype=np.int32)))

    dealt.groupBy("shard", "bucket").applyInArrow(shuffle, schema).write.parquet(path)


def read_shards(docs: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote, with the slot of each row in its shard, gapless from 0."""
    sizes = docs.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = staged(sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "buckets")
    if first.count() <= BROADCAST_BUCKETS:  # else the records are shuffled by bucket once more
        first = F.broadcast(first)
    return docs.drop("slot").join(first, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("position")).drop("first")


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """``docs`` dealt into shards in the shared folder and read back, with shard and slot.

    ``grown_shard`` is the shard that the record would have among one more.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    write_shards(docs, path, shards, seed)
    out = read_shards(spark.read.parquet(path).drop("grown_shard"))
    return out.withColumn("grown_shard", shard_column(F.col("doc_id"), shards + 1, seed))
