"""Evaluation aggregates: each is one pass with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors


def accuracy(judged: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return judged.agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"))


def split_measures(judged: DataFrame, binary: bool = False) -> DataFrame:
    """Rows, accuracy and mean loss per ``split``, in one pass (``label, pred, label_id, log_probs``);
    with ``binary`` labels 0 and 1 also all of ``binary_metrics``."""
    if binary:
        loss = judged.groupBy("split").agg(F.count("*").alias("rows"), F.avg(vectors.cross_entropy("log_probs", "label_id")).alias("loss"))
        return loss.join(binary_metrics(judged, by=("split",)), "split")
    return judged.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"),
        F.avg(vectors.cross_entropy("log_probs", "label_id")).alias("loss"),
    )


def confusion(judged: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion matrix over any label set, one row per pair that occurs."""
    return judged.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("count")
    )


def binary_counts(judged: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    yes, no = F.col(label) == 1, F.col(label) == 0
    said_yes, said_no = F.col(pred) == 1, F.col(pred) == 0
    return judged.groupBy(*by).agg(
        F.count_if(yes & said_yes).alias("tp"),
        F.count_if(no & said_no).alias("tn"),
        F.count_if(no & said_yes).alias("fp"),
        F.count_if(yes & said_no).alias("fn"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def binary_metrics(judged: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and the AUC of hard labels; 0/0 reads 0.

    The AUC is that of the one point a hard label gives: the mean of both recalls.
    """
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return binary_counts(judged, label, pred, by).select(
        *by, "tp", "tn", "fp", "fn",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("auc"),
    )


def _above(scored: DataFrame, score: str, label: str, parts: int) -> DataFrame:
    """``score, pos, neg`` for each different score, with ``pos_above, neg_above`` of higher ones.

    Rows are counted per score first. The scores are cut into ``parts`` ranges; what is above a
    score are the ranges above, whose totals are few, and the higher ones of its own range.
    """
    counts = scored.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    marks = [k / parts for k in range(1, parts)]
    bounds = counts.agg(F.percentile_approx("score", marks, 10_000).alias("b")).scalar()
    ranged = counts.withColumn("bounds", F.lit(bounds)).withColumn(
        "range", F.size(F.filter("bounds", lambda b: b < F.col("score")))
    ).drop("bounds")
    higher = W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, -1)  # at most `parts` rows
    own = W.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    totals = totals.select("range", *[F.coalesce(F.sum(f"all_{c}").over(higher), F.lit(0)).alias(f"ranges_{c}") for c in ("pos", "neg")])
    within = ranged.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"own_{c}") for c in ("pos", "neg")])
    return within.join(totals, "range").select(
        "score", "pos", "neg", *[(F.col(f"ranges_{c}") + F.col(f"own_{c}")).alias(f"{c}_above") for c in ("pos", "neg")])


def score_auc(scored: DataFrame, score: str = "rawPrediction", label: str = "label", parts: int = 200) -> DataFrame:
    """``auc``, the exact area under the ROC curve of a score: the chance that a positive row
    scores above a negative one, ties counting half. Null if either kind is missing."""
    # A negative loses to the positives above it and to half of those that tie with it.
    above = _above(scored, score, label, parts)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return above.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def threshold_curve(scored: DataFrame, score: str = "rawPrediction", label: str = "label", parts: int = 200) -> DataFrame:
    """``threshold, tp, fp, fn, tn, precision, recall, f1, fpr`` for each different score as the
    threshold: rows that score as much or more are called positive. Recall against ``fpr`` is the
    ROC curve, precision against recall that of the same name. Rows without a score or a label of
    0 or 1 are left out; 0/0 reads 0."""
    above = _above(scored, score, label, parts)
    total = scored.filter(F.col(score).isNotNull()).agg(
        F.count_if(F.col(label) == 1).alias("all_pos"), F.count_if(F.col(label) == 0).alias("all_neg"))
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    counted = above.filter("pos + neg > 0").select(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (total.select("all_pos").scalar() - tp).alias("fn"), (total.select("all_neg").scalar() - fp).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(fp, fp + tn).alias("fpr"))


def best_threshold(scored: DataFrame, score: str = "rawPrediction", label: str = "label", parts: int = 200) -> DataFrame:
    """The row of ``threshold_curve`` with the highest F1, of equal ones that with the highest
    threshold. Only the best row of each task is shuffled."""
    curve = threshold_curve(scored, score, label, parts)
    return curve.agg(F.max(F.struct("f1", "threshold", *[c for c in curve.columns if c not in ("f1", "threshold")])).alias("best")).filter(
        "best is not null").select(*[f"best.{c}" for c in curve.columns])
