"""Sample, split, choose the penalty, train, evaluate; and the grid of variants."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate, label, model, rowspace, sample
from ..session import staging

ROWS_PER_TASK = 10_000
# The many fits of the grid end where the loss has settled to six digits.
VARIANT_TOLERANCE = 1e-6
# Fits of the grid at a time. Each holds some thirty vectors of labels x features numbers on the driver (the last
# ten steps and gradients, those of the step and its broadcast): 11 labels and 65,536 features take 170 MB.
FITS_AT_ONCE = 2
# The penalties tried, in this order, until the loss on the dev slice rises; the one with the least is taken.
PENALTIES = (1.0, 0.1)


class Trained(NamedTuple):
    """A fitted pipeline, its predictions on all slices (``split`` tells them apart), and the path of the
    fits compared: ``penalty, steps, rows, accuracy, loss`` on the dev slice and whether it was ``chosen``."""

    model: PipelineModel
    judged: DataFrame
    path: DataFrame


def labelled_examples(
    labelled: DataFrame, label_column: str, label_list: Sequence[int], *keep: str
) -> DataFrame:
    examples = label.as_examples(labelled, "sentence", label_column, keep=keep)
    return model.with_label_id(examples, label_list)


def split_sample(
    labelled: DataFrame, key: str, n: int, slices: dict[str, tuple[int, int]] | None, seed: int
) -> DataFrame:
    """The sliced sample, staged, so that no later job redraws it. Without ``slices`` a tenth of
    the rows drawn, however many they are, are dev and test."""
    drawn = staging(sample.sample_n(labelled, n, key, seed))
    chosen = sample.scaled_slices(drawn.count()) if slices is None else slices
    return staging(sample.slice_split(drawn, key, chosen), partition_by=("split",))


def train_on(
    parts: DataFrame,
    key: str,
    label_column: str,
    label_list: Sequence[int],
    token_limit: int | None = None,
    num_features: int = 1 << 16,
    max_iter: int = model.MOST_STEPS,
    penalties: Sequence[float] = PENALTIES,
) -> Trained:
    """Fits on the ``train`` rows of a split sample and judges all of them, these included."""
    examples = model.with_tokens(
        labelled_examples(parts, label_column, label_list, key, "split"), token_limit=token_limit
    )
    return _fit(examples, key, label_list, num_features, max_iter, penalties)


def _fit(
    examples: DataFrame, key: str, label_list: Sequence[int], num_features: int, max_iter: int, penalties: Sequence[float],
    tol: float = model.TOLERANCE,
) -> Trained:
    """One feature table for all penalties, from the strongest on: once the loss on dev has risen
    none of the weaker ones is fitted. They are compared by fits that end early; the one taken is
    fitted to its optimum."""
    training = (F.col("split") == "train") & F.col("label_id").isNotNull()
    weights = model.text_features(num_features).fit(examples.filter(training))
    features = PipelineModel(stages=[*weights.stages, model.used_features(weights)])
    table = staging(features.transform(examples).select(key, "split", "label", "label_id", "features"))
    # The sample is bounded: each step sends its gradient once for so many rows, not per file.
    rows = table.filter(training)
    count = rows.count()
    rows = rows.coalesce(1 + count // ROWS_PER_TASK).cache()
    space = _row_space(rows, count, len(features.stages[-1].getIndices()))

    def fit(penalty: float, tol: float, start=None) -> tuple:
        """The model, its steps, and where to start another fit from."""
        estimator = model.softmax(penalty, max_iter, tol)
        if space is None or penalty <= 0:
            own = estimator.fit(rows)
            return own, own.summary.totalIterations, None
        found = rowspace.fit(space, penalty, max_iter, tol, start)
        return rowspace.as_model(space, found, estimator), found.steps, found.place

    def judged_by(fitted) -> DataFrame:
        scored = model.predict(fitted, table, label_list)
        return scored.select(key, "split", "label", "label_id", "log_probs", "pred", "pred_id")

    path, chosen = [], None
    if table.filter("split = 'dev' and label_id is not null").isEmpty():
        penalties = penalties[-1:]  # nothing to choose by
    for penalty in penalties:
        fitted, steps, place = fit(penalty, tol if len(penalties) == 1 else model.COMPARED)
        dev = evaluate.split_measures(judged_by(fitted).filter("split = 'dev' and label_id is not null")).first()
        path.append([penalty, steps, dev.rows if dev else 0, dev.accuracy if dev else None, dev.loss if dev else None, False])
        if chosen is None or path[-1][4] < chosen[4]:
            chosen, start = path[-1], place
        else:
            break
    chosen[-1] = True
    best = fitted if len(penalties) == 1 else fit(chosen[0], tol, start)[0]
    if space is not None:
        space.close()
    rows.unpersist()
    return Trained(
        PipelineModel(stages=[*features.stages, best]), judged_by(best),
        table.sparkSession.createDataFrame(path, "penalty double, steps int, rows long, accuracy double, loss double, chosen boolean"),
    )


def _row_space(rows: DataFrame, count: int, used: int) -> rowspace.RowSpace | None:
    """Where the rows are fewer than the features, steps that send a number for each row send less. A single
    label is left to Spark, which fits it without a step."""
    blocks = 1 + count // ROWS_PER_TASK
    if count * blocks >= used or rows.select("label_id").distinct().limit(2).count() < 2:
        return None
    return rowspace.RowSpace(rows, blocks)


def train_and_evaluate(
    labelled: DataFrame,
    key: str = "name",
    label_column: str = "sentiment",
    label_list: Sequence[int] = tuple(range(11)),
    n: int = 10_000,
    slices: dict[str, tuple[int, int]] | None = None,
    seed: int = 7,
    token_limit: int | None = None,
    num_features: int = 1 << 16,
    max_iter: int = model.MOST_STEPS,
    penalties: Sequence[float] = PENALTIES,
) -> Trained:
    """``labelled`` has ``sentence``, the label column and ``key``. Training sees the
    sample only, whatever the size of the corpus."""
    parts = split_sample(labelled, key, n, slices, seed)
    return train_on(parts, key, label_column, label_list, token_limit, num_features, max_iter, penalties)


def run_variants(
    labelled: DataFrame,
    key: str,
    n: int,
    slices: dict[str, tuple[int, int]] | None = None,
    seed: int = 7,
    grid: Sequence[dict] | None = None,
    num_features: int = 1 << 16,
    max_iter: int = model.MOST_STEPS,
    penalties: Sequence[float] = PENALTIES[:1],
    parallelism: int = FITS_AT_ONCE,
) -> list[tuple[dict, Trained]]:
    """One training run per variant, on one sample for each kind of corpora and under one penalty,
    so that the variants differ in their data alone.

    The corpus is read once per kind of corpora, for the sample, and the sample's tokens are
    cut once per kind and whitespace handling; the runs share them.
    """
    chosen = model.variants() if grid is None else list(grid)
    tokens = {}
    for corpora in dict.fromkeys(v["corpora"] for v in chosen):
        rows = labelled if corpora == "combined" else labelled.filter(F.col("corpus") == "known")
        parts = split_sample(rows, key, n, slices, seed)
        for spaces in dict.fromkeys(v["spaces"] for v in chosen if v["corpora"] == corpora):
            cut = parts.withColumn("sentence", text.strip_control("sentence")) if spaces == "stripped" else parts
            longest = max(v["token_limit"] for v in chosen)
            kept = model.with_tokens(cut, "sentence", longest - 2)
            tokens[corpora, spaces] = staging(kept.select(key, "split", "sentiment", "polarity", "tokens"))

    def run(variant: dict) -> tuple[dict, Trained]:
        labels = tuple(range(11)) if variant["label_kind"] == "sentiment" else (0, 1)
        rows = tokens[variant["corpora"], variant["spaces"]].select(
            key, "split", F.col(variant["label_kind"]).alias("label"),
            F.slice("tokens", F.lit(1), F.lit(variant["token_limit"] - 2)).alias("tokens"),
        )
        return variant, _fit(model.with_label_id(rows, labels), key, labels, num_features, max_iter, penalties, VARIANT_TOLERANCE)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(run, chosen))
