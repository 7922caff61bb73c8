"""Repeatable shuffles, exact samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from ..session import staging

_RANGE = "__range"

# Positional slices of a 10,000-row sample, start included, end not.
# Rows 100-9000, 9500 and 9999 belong to no slice.
DEFAULT_SLICES = {"train": (0, 100), "dev": (9001, 9500), "test": (9501, 9999)}
# The slices of the larger runs, whose training rows end where the others begin.
WIDE_SLICES = {"train": (0, 9000), "dev": (9001, 9500), "test": (9501, 9999)}
SLICES_OF = 10_000
ROWS_PER_RANGE = 1_000_000


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in a random order fixed by ``seed`` (``key`` identifies a row)."""
    return df.orderBy(keys.shuffle_key(key, seed), key)


def sample_n(df: DataFrame, n: int, key: str, seed: int, digits: int = 5) -> DataFrame:
    """Exactly ``n`` rows without replacement (all of them if there are fewer).

    Top-``n`` of the shuffled order. A plain ``orderBy.limit`` would send ``n`` rows
    *per input partition* to one task. So the rows are first counted by the leading
    hex digits of their order key, reading the key column only; the digits at which
    the running count reaches ``n`` bound the sample from above, and each task then
    passes on only rows below that bound: about ``n + rows / 16**digits`` in all.
    """
    order = keys.shuffle_key(key, seed)
    bucket = keys.hex_bucket(order, digits)
    per_bucket = df.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("rows"))
    # At most 16**digits rows, so the unpartitioned window is bounded.
    running = F.sum("rows").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    bound = per_bucket.withColumn("running", running).agg(
        F.coalesce(F.min(F.when(F.col("running") >= n, F.col("bucket"))), F.lit(16**digits))
    )
    candidates = df.filter(bucket <= bound.scalar())
    return candidates.withColumn("sample_key", order).orderBy("sample_key", key).limit(n)


def scaled_slices(rows: int, slices: dict[str, tuple[int, int]] | None = None, of: int = SLICES_OF) -> dict[str, tuple[int, int]]:
    """Slices of a sample of ``of`` rows, moved to one of ``rows`` rows; the gaps stay."""
    chosen = WIDE_SLICES if slices is None else slices
    return {name: (-(-start * rows // of), end * rows // of) for name, (start, end) in chosen.items()}


def with_position(rows: DataFrame, *order: str, position: str = "position", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each row's place, from 0, in the order of ``order``, which tells all rows apart.

    Rows are dealt into ranges of that order and written down with the number of their range. The
    ranges are counted, their counts added up (a number for each range), and rows are numbered
    within a range only. So no task sees more than its range, however many rows there are.
    """
    parts = -(-max(1, rows.count()) // rows_per_range)
    ranged = staging(rows.repartitionByRange(parts, *order).withColumn(_RANGE, F.spark_partition_id()))
    counts = {r[_RANGE]: r["count"] for r in ranged.groupBy(_RANGE).count().collect()}
    begins = [0]
    for k in range(max(counts, default=0)):
        begins.append(begins[-1] + counts.get(k, 0))
    own = F.row_number().over(W.partitionBy(_RANGE).orderBy(*order)) - 1
    return ranged.withColumn(position, F.get(F.lit(begins), F.col(_RANGE)).cast("bigint") + own).drop(_RANGE)


def slice_split(
    sample: DataFrame, key: str, slices: dict[str, tuple[int, int]] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``position`` and ``split`` of the rows of ``sample_n``; rows between the slices go."""
    bounds = DEFAULT_SLICES if slices is None else slices
    placed = with_position(sample, "sample_key", key, rows_per_range=rows_per_range)
    split = F.lit(None).cast("string")
    for name, (start, end) in bounds.items():
        split = F.when((F.col("position") >= start) & (F.col("position") < end), name).otherwise(split)
    return placed.withColumn("split", split).filter("split is not null")


def preview(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
