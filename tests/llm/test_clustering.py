import hashlib
import math

import numpy as np
import pytest

from credence.llm import clustering

from .helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, dims=64):
    kept = []
    for vec_id, e in rows:
        if e is None or len(e) != dims or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((vec_id, [max(-clustering.LIMIT, min(clustering.LIMIT, math.floor(1024 * float(np.float32(x))))) for x in e]))
    packed = lambda v: np.array(v, "<i4").tobytes()
    by = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", packed(r[1])))
    centroids = [v for _, v in by[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds if centroids else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    told = [(vec_id, *nearest(v)) for vec_id, v in kept]
    total = {j: sum(d for _, d, c in told if c == j) for j in range(k)}
    most = 2**63 - 1
    return sorted((str(i), c, d, min(most, total[c]), min(most, sum(total.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in told)


def got(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], f"vec_id long, embedding array<{kind}>, label int")
    out = clustering.clusters(clashing(df, "cluster", "vector", "inertia", "v"))
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=64) + 3 * (k % 5)).tolist()) for k in range(150)]
    assert got(spark, rows) == brute(rows)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    one, two = [0.5] * 64, [-0.25] * 64
    rows = [(k, one if k % 3 else two) for k in range(40)] + [
        (3, one), (None, two), (None, [9.0] * 64), (50, None), (51, []), (52, one[:63]), (53, one + [1.0]), (54, [None] + one[1:]),
        (55, [float("nan")] + one[1:]), (56, [float("inf")] + one[1:]), (57, [-0.0001] * 64), (58, [3e38] * 64), (59, [-3e38] * 64)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, count):
    rows = [(k, [float(k)] * 64) for k in range(count)]
    assert got(spark, rows, "double") == brute(rows)


def test_hot_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [0.125] * 64 if k % 3 == 0 else rng.normal(size=64).tolist()) for k in range(120)]
    assert got(spark, rows) == brute(rows)


def test_search_is_exact_and_measures_less():
    rng = np.random.default_rng(7)
    centres = rng.integers(-5000, 5000, (60, 16))
    x = (centres[rng.integers(0, 60, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    best, distance, measured = clustering.Neighbours(centres).nearest(x)
    every = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.7 * every.size


def test_search_on_a_grid_of_ties():
    grid = np.array([(a, b) for a in range(4) for b in range(4)], np.int64) * 2
    x = np.array([(a, b) for a in range(8) for b in range(8)], np.int64)
    best, distance, _ = clustering.Neighbours(np.concatenate([grid, grid])).nearest(x)
    every = ((x[:, None] - grid[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
