"""Incremental ingest of newly stored pages: batches against the history, and a stateful stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import history, ingest
from ..session import staging, work_folder
from ..sources import articles


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return ingest.with_identity(spark.read.parquet(path).select("url", "sha1")).select("identity")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None  # Nothing stored yet.
        raise


def append_unseen(candidates: DataFrame, path: str) -> None:
    """Append one article per URL that ``path`` does not hold; running it again adds nothing.

    An article without a URL is told by its content key. The candidates are written down first:
    they are prepared once, and their size is known when they are joined. ``<path>/_seen`` holds a
    filter of the identities stored; only candidates that it may hold are compared with the
    history, of which only URLs and content keys are read, and none where there are no such
    candidates. The filter is written before the articles: a run that fails in between leaves it
    with more than was stored, which the comparison finds out.
    """
    spark = candidates.sparkSession
    with work_folder(spark):
        numbered = staging(ingest.with_identity(candidates).withColumn("row", F.monotonically_increasing_id()))
        offered = ingest.one_per_key(numbered)
        filters, seen = history.Filters(spark, f"{path}/_seen"), _stored(spark, path)
        if seen is None:
            fresh = staging(offered)
            filters.rebuild(fresh, "identity", fresh.count())
        else:
            if not filters.pages:
                filters.rebuild(seen, "identity", seen.count())
            told = staging(history.maybe_seen(offered, "identity", filters.rows(), filters.pages))
            fresh, maybe = told.filter("not maybe"), told.filter("maybe")
            if not maybe.isEmpty():
                fresh = fresh.unionByName(ingest.drop_seen(maybe, seen, "identity"))
            filters.add(fresh, "identity")
            if filters.full():
                both = seen.union(fresh.select("identity"))
                filters.rebuild(both, "identity", both.count())
        articles.write_articles(fresh.select(*candidates.columns), path, mode="append")


def ingest_stream(
    pages: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Prepare and append every page file not yet taken, then stop.

    The checkpoint remembers the files, the anti join remembers the URLs: a batch
    replayed after a failure finds its URLs stored.
    """
    def take(batch: DataFrame, _: int) -> None:
        append_unseen(prepare(batch), path)

    return (
        pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def first_of_each(candidates: DataFrame) -> DataFrame:
    """Of a stream of candidates, the first of each identity; later ones, and copies in the same
    batch, are dropped. Of a batch's candidates for one identity the lowest ``sha1`` is first.

    The state of an identity is that it was seen; it lies in the state store, by identity, and is
    never read as a whole. Candidates of one identity meet in one task, as they must.
    """
    names = candidates.columns
    keyed = ingest.with_identity(candidates)

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lowest = None
        for rows in batches:
            own = rows.sort_values("sha1", kind="stable").head(1)
            if lowest is None or own["sha1"].iloc[0] < lowest["sha1"].iloc[0]:
                lowest = own
        if not state.exists and lowest is not None:
            state.update((True,))
            yield lowest[names]

    return keyed.groupBy("identity").applyInPandasWithState(
        first, candidates.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def stateful_stream(
    pages: DataFrame, prepare: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Like ``ingest_stream``, but what was seen is the stream's own state, not the stored table.

    ``prepare`` may only use steps that a stream allows, joins with tables among them. Every batch
    writes a folder of its own, ``<path>/batch=<id>``, and replaces it: a batch replayed after
    a failure, whose state was not committed, writes the same articles again.
    """
    def store(batch: DataFrame, number: int) -> None:
        articles.write_articles(batch, f"{path}/batch={number}")

    return (
        first_of_each(prepare(pages)).writeStream.foreachBatch(store).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
