"""Centroid clustering in whole numbers, each vector's nearest centroid found by Orchard's search.

Every centroid has a list of the others, nearest first. A vector starts at one centroid and walks
its list; when a centroid turns out to be closer, the walk goes on in that one's list from its
begin. Centroids once measured are marked and not measured again. By the triangle inequality the
walk ends where the list's centroid is strictly more than twice as far from the current one as the
vector is; so a tie is never overlooked, and the smaller number gets it.

Vectors are staged once as 32-bit numbers. Each round reads them once; a task adds up its own
vectors by cluster, and what is shuffled and sent to the driver is a number for each cluster and
component. The centroids, k times the dimension, are all that is sent to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE = 1024
LIMIT = 1 << 26  # squared distances of up to 2^10 such components fit in 64 bits
_MOST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dims: int = 64, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows with exactly ``dims`` components, all of them finite numbers.

    ``vector`` holds floor(1024 * x) of each component as 32-bit little-endian numbers. Beyond
    +-2^26 (a component of 65,536) it stays at that, as 64-bit distances would not be exact.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().cast(pa.float64())
            x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            whole = np.clip(np.floor(SCALE * x[good]), -LIMIT, LIMIT).astype("<i4")
            ends = np.arange(len(whole) + 1, dtype=np.int32) * (4 * dims)
            packed = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(ends), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), packed], names=["vec_id", "vector"])

    rows = vectors.where(F.size(column) == dims).select("vec_id", F.col(column).alias("v"))
    return staged(rows.mapInArrow(run, "vec_id long, vector binary"), "vectors")


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch, one a row."""
    _, _, data = column.buffers()
    if not len(column):
        return np.zeros((0, dims), np.int64)
    start = column.offset * dims
    return np.frombuffer(data, "<i4")[start : start + len(column) * dims].reshape(-1, dims).astype(np.int64)


class Neighbours:
    """Centroids (k rows of whole numbers), and for each the others by distance, the smaller number first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        apart = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids]) if k else np.zeros((0, 0), np.int64)
        order = np.argsort(apart, axis=1, kind="stable")
        self.order = order[order != np.arange(k)[:, None]].reshape(k, max(k - 1, 0))
        self.gap = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid, the squared distance, and how many distances were measured."""
        k = len(self.centroids)
        best = np.zeros(len(x), np.int64)
        distance = ((x - self.centroids[0]) ** 2).sum(axis=1)
        marked = np.zeros((len(x), k), bool)
        marked[:, 0] = True
        place = np.zeros(len(x), np.int64)
        live, measured = np.arange(len(x)), len(x)
        while len(live):
            live = live[place[live] < k - 1]
            # Strictly beyond twice the current distance nothing can be as close.
            live = live[self.gap[best[live], place[live]] <= 4 * distance[live]]
            other = self.order[best[live], place[live]]
            fresh = ~marked[live, other]
            row, c = live[fresh], other[fresh]
            marked[row, c] = True
            place[live] += 1
            d = ((x[row] - self.centroids[c]) ** 2).sum(axis=1)
            measured += len(row)
            closer = (d < distance[row]) | ((d == distance[row]) & (c < best[row]))
            best[row[closer]], distance[row[closer]], place[row[closer]] = c[closer], d[closer], 0
        return best, distance, measured


def first_centroids(whole: DataFrame, k: int, salt: str, dims: int = 64) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and vec_id, in that order; a null id comes last."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = whole.select("vector", by.alias("by")).orderBy(F.col("by").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([np.frombuffer(r.vector, "<i4") for r in rows], np.int64).reshape(-1, dims)


def moved_centroids(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the exact mean of their vectors; empty ones stay."""
    near, dims = Neighbours(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _unpacked(batch.column("vector"), dims)
            best = near.nearest(x)[0]
            order = np.argsort(best, kind="stable")
            used, begin = np.unique(best[order], return_index=True)
            total[used] += np.add.reduceat(x[order], begin, axis=0) if len(used) else 0
            rows += np.bincount(best, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(used))),
             pa.array(total[used].ravel()), pa.array(np.repeat(rows[used], dims))], names=["cluster", "dim", "total", "rows"])

    sums = whole.select("vector").mapInArrow(run, "cluster int, dim int, total long, rows long")
    sums = sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("rows").alias("rows"))
    moved = centroids.copy()
    for r in sums.collect():  # k times the dimension
        moved[r.cluster, r.dim] = int(r.total) // r.rows
    return moved


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    near, dims = Neighbours(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = near.nearest(_unpacked(batch.column("vector"), dims))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return whole.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:", dims: int = 64, column: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable vector.

    ``vectors`` (vec_id, embedding, ...) may have other columns, which are ignored. Rows whose
    embedding is null, has another number of components, or a component that is null or not finite,
    are left out. Rows with one vec_id are vectors each; a null vec_id is the last choice for a
    first centroid. With fewer than k vectors there are as many centroids; with none, no rows.
    Inertia beyond 64 bits is given as the largest 64-bit number.
    """
    whole = whole_vectors(vectors, dims, column)
    centroids = first_centroids(whole, k, salt, dims)
    out = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *[
            F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in out.split(", ")[1:])])
    for _ in range(rounds):
        moved = moved_centroids(whole, centroids)
        if (moved == centroids).all():
            break  # further rounds would give the same
        centroids = moved
    told = staged(assigned(whole, centroids), "clusters")
    sums = {r.cluster: int(r.total) for r in told.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(28,0)")).alias("total")).collect()}
    inertia = min(sum(sums.values()), _MOST)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, min(total, _MOST), inertia, names[c]) for c, total in sums.items()]
    totals = told.sparkSession.createDataFrame(rows, out)
    return told.join(F.broadcast(totals), "cluster").select(  # k rows at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
