"""A mix of sources by target weights, in blocks of equally many words.

Targets are shares of all words, at most ``REPEATS`` times what the source has; what is above
goes to the others by weight. The targets are paid in blocks by Sainte-Laguë: block after block
goes to the source with the highest quotient target / (2 * blocks so far + 1). The corpus is
dealt into shards by hash, and a source's blocks are dealt to its shards by their words added up in
order: what is rounded off in one shard is paid in a later one, so that the quotas of all shards
are the source's blocks exactly, however few words a shard has of it. The source's documents in
the shard, in seeded order, form a ring of words; its quota is taken from a seeded block on, round
and round. So whole documents are taken but for the two at the ends.

A block is one word by default. With larger ones a shard that is paid close to all its repeats may
end up to a block short.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

REPEATS = 3
BLOCK_WORDS = 1
SHARD_ROWS = 20_000
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009..U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(targets: np.ndarray, seats: int) -> np.ndarray:
    """``seats`` to the highest quotients target / (2 k + 1), equal ones to the earlier.

    A common divisor gives nearly all of them at once; the few seats that rounding gave too
    many or too few are taken from the lowest, or given to the highest, quotients.
    """
    total = targets.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(targets), np.int64)
    quota = np.floor(targets * (seats / total) + 0.5).astype(np.int64)
    extra = int(quota.sum()) - seats
    if extra > 0:
        heap = [(targets[k] / (2 * quota[k] - 1), -k) for k in range(len(targets)) if quota[k]]
        heapq.heapify(heap)
        for _ in range(extra):
            _, k = heapq.heappop(heap)
            quota[-k] -= 1
            if quota[-k]:
                heapq.heappush(heap, (targets[-k] / (2 * quota[-k] - 1), k))
    elif extra < 0:
        heap = [(-targets[k] / (2 * quota[k] + 1), k) for k in range(len(targets))]
        heapq.heapify(heap)
        for _ in range(-extra):
            _, k = heapq.heappop(heap)
            quota[k] += 1
            heapq.heappush(heap, (-targets[k] / (2 * quota[k] + 1), k))
    return quota


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Targets for (source, source_size), a row for each source; weights go round by code point, null last.

    Sources are filled up to one level of target per weight, except those that would be above
    their limit at it. In the order of limit per weight the level is the first that the next
    source's limit is not below. The windows hold a row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("limit", (F.lit(repeats) * F.col("source_size")).cast("double"))
    sources = sources.withColumn("ratio", F.col("limit") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(fill), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    place = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    sources = sources.withColumn("level", left / open_weight).withColumn("place", place)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)["level"]
    return sources.withColumn("target", F.least("limit", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select(
        "source", "source_size", "target")


def _keys(columns: list[Column]) -> list[Column]:
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("second"), *columns).alias("k2")]


def mix_plan(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How many words the mix takes of each different (doc_id, source, text).

    Columns k1, k2 (hashes of the three), doc_id, size, source_size, target, rows (equal rows)
    and taken (words of all of them). Null texts have no words; null is a source of its own.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *_keys([F.col("doc_id"), F.col("source"), F.col("text")]))
    rows = staged(rows.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-rows")
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    words = F.col("size") * F.col("rows")
    sources = source_targets(rows.groupBy("source").agg(F.sum(words).alias("source_size")))

    def apportion(whole: pd.DataFrame) -> pd.DataFrame:
        whole = whole.sort_values("source", na_position="last", kind="stable")
        target = whole["target"].to_numpy(float)
        whole["blocks"] = sainte_lague(target, int(round(target.sum() / block_words)))
        return whole[["source", "source_size", "target", "blocks"]]

    # A row for each source, in one task like the windows that gave the targets.
    sources = staged(sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        apportion, "source string, source_size long, target double, blocks long"), "mix-sources")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(shards)))
    parts = rows.groupBy("source", "shard").agg(F.sum(words).alias("words")).alias("r")
    parts = parts.join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_size", "target", "blocks")
    # A row for each shard of a source: its share of the blocks is what is due with it less what was before.
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("shard")).cast("decimal(18,0)")
    due = lambda c: F.when(F.col("source_size") > 0, F.expr(f"(2 * CAST(blocks AS DECIMAL(18,0)) * {c} + source_size) div (2 * CAST(source_size AS DECIMAL(18,0)))")).otherwise(0)
    parts = parts.withColumn("upto", upto).withColumn("before", (F.col("upto") - F.col("words")).cast("decimal(18,0)"))
    quotas = parts.withColumn("quota", due("upto") - due("before"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source", "shard"), F.greatest(F.ceil(F.col("words") / block_words), F.lit(1)))
    quotas = staged(quotas.select(
        "source", "shard", "words", "source_size", "target", (start * block_words).alias("start"),
        F.least(F.col("quota") * block_words, F.col("words") * REPEATS).alias("paid")), "mix-quotas")

    ring = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "k1"), "k1", "k2")
    placed = rows.withColumn("end", F.sum(words).over(ring)).withColumn("begin", F.col("end") - words)
    joined = placed.alias("d").join(
        quotas.alias("q"), (F.col("d.shard") == F.col("q.shard")) & F.col("d.source").eqNullSafe(F.col("q.source"))
    ).select("d.*", "q.words", "q.source_size", "q.target", "q.start", "q.paid")
    rounds = F.when(F.col("words") > 0, F.floor(F.col("paid") / F.col("words"))).otherwise(0)
    rest = F.col("paid") - rounds * F.col("words")

    def within(first: Column) -> Column:
        return F.greatest(F.least(F.col("end"), first + rest) - F.greatest(F.col("begin"), first), F.lit(0))

    taken = rounds * words + within(F.col("start")) + within(F.col("start") - F.col("words"))
    return joined.select("k1", "k2", "doc_id", "size", "source_size", "target", "rows", taken.cast("long").alias("taken"))


def words_taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row; equal rows share what they get."""
    plan = mix_plan(docs, seed)
    number = plan.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("number"))
    upto = lambda k: F.floor(F.col("taken") * k / F.col("rows"))
    own = F.when(F.col("rows") == 1, F.col("taken")).otherwise(upto(F.col("number")) - upto(F.col("number") - 1))
    return number.select("doc_id", "size", "source_size", "target", own.cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole number.

    Documents without words are not taken. Columns stay as they are.
    """
    plan = mix_plan(docs, seed).select(
        "k1", "k2", F.round(F.col("taken") / F.greatest(F.col("size") * F.col("rows"), F.lit(1))).cast("int").alias("times"))
    keyed = docs.select(F.struct("*").alias("row"), *_keys([F.col("doc_id"), F.col("source"), F.col("text")]))
    taken = keyed.join(plan.where("times > 0"), ["k1", "k2"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
