"""Session settings the operators were planned with, and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Sizes are left to Spark: AQE splits skewed join partitions, merges small ones, and
# turns a sort-merge join into a hash join where the build partitions are small.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the next step could have reused the partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "credence", **extra: str) -> SparkSession:
    """A session with ``SETTINGS``; the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path that all executors can reach; what is written there goes when the driver ends.

    It is under ``spark.checkpoint.dir``, or under the warehouse where that is not set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/credence-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have gone before
            _remove(spark, path)

    atexit.register(remove)
    return path


_folders: list[str] = []


@contextlib.contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """While it lasts, ``staging`` writes to a folder of its own, which is removed at the end."""
    path = shared_folder(spark)
    _folders.append(path)
    try:
        yield path
    finally:
        _folders.remove(path)
        _remove(spark, path)


def staging(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written down and read back: for a frame that is costly to compute and read more
    than once. It is computed once, survives lost executors, and has a known size.

    Every call writes to a fresh folder. It is removed with the ``work_folder`` around the call,
    or else when the driver ends, since the frame may be read until then.
    """
    spark = df.sparkSession
    path = f"{_folders[-1]}/{uuid.uuid4().hex}" if _folders else shared_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
