"""Scans of one-file-per-article folders, ``<root>/{pos,neg}/<sha1>_<score>``.

Spark packs many small files into each partition, so the number of tasks follows the
bytes and not the files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text

# Names that are a file's own; others need a folder's name, in which Spark escapes them.
_PLAIN = "^[0-9A-Za-z][0-9A-Za-z_-]{0,199}$"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``folder, name, value`` of every file, read whole.

    Besides ``pos/<name>``, the layout that Spark's own writer has is read: one folder for
    each article, ``folder=pos/name=<name>/part-...``. A missing ``pos`` or ``neg`` folder
    is simply no rows.
    """
    path = F.split(F.col("_metadata.file_path"), "/")
    parent = F.try_element_at(path, F.lit(-2))
    written = parent.startswith("name=")
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(
            F.when(written, F.replace(F.try_element_at(path, F.lit(-3)), F.lit("folder="), F.lit("")))
            .otherwise(parent).alias("folder"),
            F.when(written, F.substr(parent, F.lit(6))).otherwise(F.col("_metadata.file_name")).alias("name"),
            F.col("content").cast("string").alias("value"),
        )
        .filter(F.col("folder").isin("pos", "neg"))
    )


def write_files(files: DataFrame, root: str) -> None:
    """``folder, name, value`` as one file for each article; each ends with a line feed.

    In a file system that all machines have mounted, tasks write ``pos/<name>`` as they are: Spark's
    writer would make a folder, a checksum and, to set permissions, several processes for each
    article. Elsewhere, and for names that no file can have, it does write them.
    """
    rows = files.select("folder", "name", "value")
    local = _mounted(files.sparkSession, root)
    plain = F.col("folder").isin("pos", "neg") & F.col("name").rlike(_PLAIN)
    others = rows.filter(~F.coalesce(plain, F.lit(False))) if local else rows
    others.dropDuplicates(["folder", "name"]).write.partitionBy("folder", "name").text(root)
    if not local:
        return
    for folder in ("pos", "neg"):
        os.makedirs(f"{local}/{folder}", exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Renamed when whole, so that a repeated task leaves whole files too. Spark skips hidden ones.
                part = f"{local}/{folder}/.{uuid.uuid4().hex}"
                with open(part, "wb") as file:
                    file.write((value or b"") + b"\n")
                os.replace(part, f"{local}/{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"files": pa.array([len(batch)], pa.int64())})

    unique = rows.filter(plain).dropDuplicates(["folder", "name"])
    written = unique.select("folder", "name", F.col("value").cast("binary")).mapInArrow(write, "files long")
    written.agg(F.sum("files")).collect()


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` where it is a folder of the machines' own file system; elsewhere nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def article_files(files: DataFrame) -> DataFrame:
    """``name, sha1, sentiment, polarity, text``; an unreadable file is an empty article.

    Line ends are read as LF. The boilerplate passes can tell the difference.
    """
    return files.select(
        "name",
        F.substring_index("name", "_", 1).alias("sha1"),
        keys.score_of_name("name").alias("sentiment"),
        (F.col("folder") == "pos").cast("int").alias("polarity"),
        text.universal_newlines(text.decode_or_empty("value")).alias("text"),
    )


def with_load_status(files: DataFrame) -> DataFrame:
    """Adds ``sentiment``, ``polarity`` and ``loaded``: valid UTF-8 and a score in the name."""
    return files.select(
        "*",
        keys.score_of_name("name").alias("sentiment"),
        (F.col("folder") == "pos").cast("int").alias("polarity"),
    ).withColumn(
        "loaded", F.coalesce(F.is_valid_utf8("value"), F.lit(False)) & F.col("sentiment").isNotNull()
    )


def labelled(files: DataFrame) -> DataFrame:
    """``name, sentence, sentiment, polarity`` of the files that load; others are skipped."""
    return with_load_status(files).filter("loaded").select(
        "name", F.col("value").alias("sentence"), "sentiment", "polarity"
    )


def read_labelled(spark: SparkSession, root: str) -> DataFrame:
    return labelled(scan_files(spark, root))
