"""Softmax fits whose steps send a number for each row and label to the driver, not one for each feature.

The optimum of a penalised softmax is a sum of the rows it is fitted on, and so is every step of L-BFGS
towards it: coefficients ``X' A`` for some ``A`` of rows x labels, X being the standardised features. What a step
needs of the features is ``X X' R`` for its residuals R, which the tasks that hold the features compute.
Margins, and so the whole line search, follow from that on the driver. A sample of some thousand rows
has far fewer rows than hashed features; the features themselves never leave the tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector, Matrices
from pyspark.sql import DataFrame

HISTORY = 20  # steps whose changes L-BFGS remembers
SETTLED_OVER = 10  # steps over which the loss has settled
SEARCHED, FLAT, FALLS = 60, 0.1, 1e-4  # tries of a line search, the share of the slope that ends it, and that it must gain


# Workers need not be able to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Entries sorted by what they are added up for: their values, the place of the other factor, where each sum begins.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]
# Some features of all rows: their numbers, means, and 1 / variance (0 where they never vary); what is not
# zero by feature, and by row; the rows that have something.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, Entries, Entries, np.ndarray]


def _block(parts: Iterable[tuple[int, np.ndarray, np.ndarray]], count: int) -> Block:
    """Of (row, features, values)."""
    parts = sorted(parts, key=lambda part: part[0])
    row = np.repeat([r for r, _, _ in parts], [len(f) for _, f, _ in parts])
    features, column = np.unique(np.concatenate([f for _, f, _ in parts]), return_inverse=True)
    value = np.concatenate([v for _, _, v in parts])
    mean = np.bincount(column, value, len(features)) / count
    # Squares of the distances from the mean: of the values there are, and of the zeros.
    zeros = count - np.bincount(column, minlength=len(features))
    spread = np.bincount(column, (value - mean[column]) ** 2, len(features)) + zeros * mean**2
    varies = spread > 1e-12 * count * mean**2
    scale = np.where(varies, (count - 1) / np.where(varies, spread, 1), 0)
    order, begin = np.argsort(column, kind="stable"), np.flatnonzero(np.diff(row, prepend=-1))
    by_feature = value[order], row[order], np.flatnonzero(np.diff(column[order], prepend=-1))
    return features, mean, scale, by_feature, (value, column, begin), row[begin]


def _added(entries: Entries, by: np.ndarray) -> np.ndarray:
    value, place, begin = entries
    return np.stack([np.add.reduceat(value * of.take(place), begin) for of in np.ascontiguousarray(by.T)], axis=1)


def _sums(block: Block, by_row: np.ndarray) -> np.ndarray:
    """``X' by_row``, each feature divided by its variance."""
    return _added(block[3], by_row) * block[2][:, None]


def _product(block: Block, by_row: np.ndarray) -> np.ndarray:
    whole = np.zeros(by_row.shape)
    whole[block[5]] = _added(block[4], _sums(block, by_row))
    return whole


class RowSpace:
    """The rows (``label_id``, ``features``) of a fit, dealt by features into ``blocks``, one for a task each."""

    def __init__(self, rows: DataFrame, blocks: int = 1):
        self.context = rows.sparkSession.sparkContext
        numbered = rows.select("label_id", "features").rdd.zipWithIndex()
        labels = dict(numbered.map(lambda r: (r[1], int(r[0]["label_id"]))).collect())
        self.labels = np.array([labels[k] for k in range(len(labels))], np.int64)
        self.size = len(rows.select("features").first()["features"])
        count = len(labels)

        def dealt(numbered: tuple) -> Iterator[tuple[int, tuple[int, np.ndarray, np.ndarray]]]:
            whole, row = numbered[0]["features"].toArray(), numbered[1]
            at = np.flatnonzero(whole)
            value = whole[at]
            for k in range(blocks):
                own = at % blocks == k
                yield k, (row, at[own], value[own])

        parts = numbered.flatMap(dealt).groupByKey(blocks, lambda k: k)
        self.blocks = parts.mapValues(lambda parts: _block(parts, count)).values().persist(StorageLevel.MEMORY_AND_DISK)

    def product(self, by_row: np.ndarray) -> np.ndarray:
        """``X X' by_row`` of the centred features; the labels of a row of ``by_row`` add up to zero, so one is left out."""
        sent = self.context.broadcast((by_row - by_row.mean(axis=0))[:, 1:])
        got = sum(self.blocks.map(lambda block: _product(block, sent.value)).collect())
        sent.destroy()
        got -= got.mean(axis=0)
        return np.hstack([-got.sum(axis=1, keepdims=True), got])

    def coefficients(self, by_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``X' by_row`` for features as they are, and what their means take from the intercepts."""
        sent = self.context.broadcast(by_row - by_row.mean(axis=0))

        def own(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sums = _sums(block, sent.value)
            return block[0], sums, block[1] @ sums

        whole, taken = np.zeros((self.size, by_row.shape[1])), np.zeros(by_row.shape[1])
        for features, sums, off in self.blocks.map(own).collect():
            whole[features] = sums
            taken += off
        sent.destroy()
        return whole, taken

    def close(self) -> None:
        self.blocks.unpersist()


class Fit(NamedTuple):
    """``place``: A, then X X' A (a line for each row), then the intercepts."""

    place: np.ndarray
    steps: int
    loss: float


def fit(space: RowSpace, penalty: float, max_iter: int, tol: float, start: np.ndarray | None = None) -> Fit:
    """The least mean log loss plus half the penalty on squared coefficients of standardised features, by L-BFGS.

    It ends where the loss fell by less than ``tol`` of itself over the last steps, or where the
    gradient is as small.
    """
    count, kinds = len(space.labels), int(space.labels.max()) + 1
    known = np.eye(kinds)[space.labels]

    def dot(u: np.ndarray, v: np.ndarray) -> float:
        return float(np.vdot(u[:count], v[count:-1]) + u[-1] @ v[-1])

    def judged(place: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and the probabilities."""
        margins = place[count:-1] + place[-1]
        margins -= margins.max(axis=1, keepdims=True)
        p = np.exp(margins)
        total = p.sum(axis=1, keepdims=True)
        loss = (np.log(total[:, 0]) - margins[np.arange(count), space.labels]).mean()
        return float(loss + penalty / 2 * np.vdot(place[:count], place[count:-1])), p / total

    def gradient(place: np.ndarray, p: np.ndarray) -> np.ndarray:
        off = (p - known) / count
        return np.vstack([off, space.product(off), off.sum(axis=0)]) + penalty * np.vstack([place[:-1], np.zeros(kinds)])

    def searched(place: np.ndarray, step: np.ndarray, slope: float, start: float) -> float:
        """How far to go: the loss along ``step`` is convex, its slopes are known without the features. Beyond
        the least a small slope is not enough, as the loss may have risen again by then."""
        low, high, t = 0.0, np.inf, 1.0
        along = step[count:-1] + step[-1]
        pull, bend = np.vdot(step[:count], place[count:-1]), np.vdot(step[:count], step[count:-1])
        for tried in range(SEARCHED):
            loss, p = judged(place + t * step)
            here = ((p - known) * along).sum() / count + penalty * (pull + t * bend)
            if abs(here) <= FLAT * abs(slope) and (here <= 0 or loss <= start + FALLS * t * slope):
                return t
            low, high = (t, high) if here < 0 else (low, t)
            curve = ((p * along**2).sum(axis=1) - (p * along).sum(axis=1) ** 2).mean() + penalty * bend
            t = t - here / curve if curve > 0 else np.inf
            if not low < t < high or tried % 3 == 2 and np.isfinite(high):
                t = (low + high) / 2 if np.isfinite(high) else 2 * low
        return low or t

    place = start
    if place is None:
        place = np.zeros((2 * count + 1, kinds))
        place[-1] = np.log1p(known.sum(axis=0))
        place[-1] -= place[-1].mean()
    loss, p = judged(place)
    down, past, losses = gradient(place, p), [], [loss]
    for done in range(max_iter):
        if np.sqrt(max(dot(down, down), 0)) <= max(tol * abs(loss), 1e-8):
            return Fit(place, done, loss)
        step, shares = -down, []
        for moved, changed, inverse in reversed(past):
            shares.append(inverse * dot(moved, step))
            step = step - shares[-1] * changed
        if past:
            moved, changed, inverse = past[-1]
            step = step / (inverse * dot(changed, changed))
        for (moved, changed, inverse), share in zip(past, reversed(shares), strict=True):
            step = step + (share - inverse * dot(changed, step)) * moved
        slope = dot(step, down)
        if not slope < 0:
            return Fit(place, done, loss)  # rounding is all that is left
        moved = searched(place, step, slope, losses[-1]) * step
        loss, p = judged(place + moved)
        if not loss <= losses[-1]:
            return Fit(place, done, losses[-1])
        place, before = place + moved, down
        losses.append(loss)
        if len(losses) > SETTLED_OVER and losses[-1 - SETTLED_OVER] - loss <= tol * abs(loss):
            return Fit(place, done + 1, loss)
        down = gradient(place, p)
        changed = down - before
        if (gain := dot(moved, changed)) > 0:
            past = [*past[1 - HISTORY :], (moved, changed, 1 / gain)]
    return Fit(place, max_iter, loss)


def as_model(space: RowSpace, found: Fit, estimator: LogisticRegression) -> LogisticRegressionModel:
    """What ``estimator`` would have fitted, with these coefficients."""
    whole, taken = space.coefficients(found.place[: len(space.labels)])
    intercepts = found.place[-1] - taken
    context = space.context
    java = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        estimator.uid, _py2java(context, Matrices.dense(*whole.T.shape, whole.ravel())),
        _py2java(context, DenseVector(intercepts - intercepts.mean())), whole.shape[1], True,
    )
    return estimator._copyValues(LogisticRegressionModel(java))
