"""Exact duplicates through an extendible-hash index on shared files.

Each text has a 64-bit key. Every document leaves one narrow entry (doc_id, key, SHA-256) on a
shared file; texts are not moved for that. Keys that occur once need no comparison. Of the others
the texts are grouped by key and bytes, copies combined before they are shuffled, so a text with
very many copies is one row for each task; texts that differ under one key form its chain.

The index has a directory: the first bits of a key are its address, each address points to a
bucket, and a bucket holds a bounded number of keys. While a bucket is overfull, the directory
doubles (one more bit) and the bucket is split; addresses whose buckets still fit together share
one. Buckets are ranges of keys, so the tasks that own the index's files each take a range of
keys, lay the chains and write them in order. All of it is tables and SQL functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 50_000  # keys of a bucket
FEW_KEYS = 1_000_000  # so many repeated keys of 8 bytes are sent to all tasks, more are joined by a shuffle
BITS = 64


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _rows(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text")).withColumn("key", key(F.col("text")).cast("long"))


def entries(docs: DataFrame, key: Callable[[Column], Column] = text_key) -> DataFrame:
    """(doc_id, key, digest) for each row of ``docs``, written down; null texts count as empty."""
    digest = F.unhex(F.sha2("text", 256))
    return staged(_rows(docs, key).select("doc_id", "key", digest.alias("digest")), "dedup-entries")


def _address(key: Column, bits: int) -> Column:
    """The first ``bits`` bits of a key, in the order of signed keys."""
    return F.shiftright(key, BITS - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(address, depth, bucket, held) of each address in use, and the bits of an address.

    ``keys`` has one row for each different ``key``. ``depth`` is how many of the bits tell the
    bucket from the others, ``bucket`` its first address, ``held`` its number of keys: at most
    ``capacity``.
    """
    total = keys.count()
    bits = max(0, math.ceil(math.log2(max(1, total) / capacity)))
    while True:
        held = staged(keys.groupBy(_address(F.col("key"), bits).alias("address")).agg(F.count("*").alias("held")), "dedup-directory")
        if bits == BITS or (held.agg(F.max("held")).first()[0] or 0) <= capacity:
            break
        bits += 1  # the directory doubles and overfull buckets split
    # Of the prefixes of an address the shortest whose keys fit in a bucket is its bucket.
    at = held.select("address", "held", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"CASE WHEN depth = 0 THEN 0L ELSE shiftright(address, {bits} - depth) END")
    at = at.withColumn("prefix", prefix)
    fits = at.groupBy("depth", "prefix").agg(F.sum("held").alias("all")).where(F.col("all") <= capacity)
    leaf = at.join(fits, ["depth", "prefix"]).groupBy("address").agg(F.min(F.struct("depth", "prefix", "all")).alias("leaf"))
    first = F.expr(f"CASE WHEN leaf.depth = 0 THEN 0L ELSE shiftleft(leaf.prefix, {bits} - leaf.depth) END")
    table = leaf.select("address", F.col("leaf.depth").alias("depth"), first.alias("bucket"), F.col("leaf.all").alias("held"))
    return staged(table, "dedup-directory"), bits


def build_index(docs: DataFrame, found: DataFrame, key: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> DataFrame:
    """The index of ``docs``, one row for each different text: (bucket, key, chain, chained, digest,
    keep_id, group_size).

    ``found`` are the ``entries`` of ``docs``. The texts of one key are numbered by ``chain``, and
    ``chained`` is how many they are. Of equal texts the largest doc_id is ``keep_id``.
    """
    keys = staged(found.groupBy("key").agg(
        F.count("*").alias("rows"), F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest")), "dedup-keys")
    single = keys.where("rows = 1").select("key", "digest", F.col("doc_id").alias("keep_id"), F.col("rows").alias("group_size"))
    repeated = keys.where("rows > 1").select("key")
    rows = _rows(docs, key)
    if repeated.count() <= FEW_KEYS:
        # Only texts that may have a copy are moved. Beyond that size all are, copies combined first.
        rows = rows.join(F.broadcast(repeated), "key", "left_semi")
    grouped = rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = grouped.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size")
    grouped = grouped.join(repeated, "key", "left_semi")
    buckets, bits = directory(keys.select("key"), capacity)
    owners = max(1, buckets.select("bucket").distinct().count())
    whole = single.unionAll(grouped).withColumn("address", _address(F.col("key"), bits))
    whole = whole.join(buckets.select("address", "bucket"), "address").drop("address")
    chain = Window.partitionBy("bucket", "key")
    laid = whole.repartitionByRange(owners, "bucket", "key").select(
        "bucket", "key", F.row_number().over(chain.orderBy("digest", "keep_id")).alias("chain"),
        F.count("*").over(chain).alias("chained"), "digest", "keep_id", "group_size")
    return staged(laid.sortWithinPartitions("bucket", "key", "chain"), "dedup-index")


def exact_groups(docs: DataFrame, key: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs`` (doc_id, text, ...).

    Texts are equal if all their bytes are; null counts as empty. Of a group the row with the
    largest doc_id stays, and ``group_size`` counts all its rows. A null doc_id is the smallest; in
    a group without any other, ``keep_id`` is null and its rows are kept. A row that occurs more
    than once with the same doc_id and text is kept or dropped as a whole. Other columns are
    ignored, an empty table gives no rows, and texts may be as long as a row may.
    """
    found = entries(docs, key)
    index = build_index(docs, found, key, capacity)
    alone = index.where("chained = 1").select("key", "keep_id", "group_size")
    out = found.join(alone, "key").select("doc_id", "keep_id", "group_size", "digest")
    crowded = index.where("chained > 1").select("key").distinct()
    if not crowded.isEmpty():
        # Different texts under one key: each document is led to its own by the bytes.
        rows = _rows(docs, key).join(crowded, "key", "left_semi")
        chains = rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        told = rows.join(chains, ["key", "text"])
        out = out.unionAll(told.select("doc_id", "keep_id", "group_size", F.unhex(F.sha2("text", 256)).alias("digest")))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, key: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> DataFrame:
    """One row of ``docs`` for each different text, that with the largest doc_id; all columns kept.

    Of rows that repeat both doc_id and text any one stays.
    """
    found = entries(docs, key)
    index = build_index(docs, found, key, capacity).select(F.col("key").alias("of"), F.col("digest").alias("told"), "keep_id")
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), docs["doc_id"].alias("id")).withColumn("key", key(F.col("text")).cast("long"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    same = (F.col("key") == F.col("of")) & (F.col("digest") == F.col("told")) & F.col("id").eqNullSafe(F.col("keep_id"))
    stay = rows.join(index, same, "left_semi")
    return stay.groupBy("key", "text").agg(F.first("row").alias("row")).select("row.*")
