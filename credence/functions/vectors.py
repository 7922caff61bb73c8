"""Array expressions of the softmax head."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col


def _minus(values: Column, amount: Column) -> Column:
    """``amount`` off every value; repeated as an array because a column captured by a
    lambda would be evaluated again for every element."""
    return F.zip_with(values, F.array_repeat(amount, F.size(values)), lambda x, y: x - y)


def linear_logits(
    vector: Column | str, weights: Sequence[Sequence[float]], bias: Sequence[float]
) -> Column:
    """One logit per label: x·Wᵀ + b, as a matrix product over each Arrow batch.

    ``zip_with`` and ``aggregate`` can say the same, but interpret one lambda call per
    product: six times slower at 64 x 10, and labels x dimensions worse beyond.
    """
    w, b = np.asarray(weights, dtype="float64").T, np.asarray(bias, dtype="float64")

    @F.pandas_udf("array<double>")
    def logits(batch: pd.Series) -> pd.Series:
        present = batch[batch.notna()]
        if present.empty:
            return pd.Series([None] * len(batch), index=batch.index, dtype=object)
        x = np.stack(present.to_numpy()).astype("float64")
        return pd.Series(list(x @ w + b), index=present.index).reindex(batch.index)

    # Not said to be deterministic, so that a filter on its result is not pushed below it and
    # the product computed a second time there.
    return logits.asNondeterministic()(_col(vector))


def with_log_softmax(df: DataFrame, logits: str = "logits", out: str = "log_probs") -> DataFrame:
    """Log-probabilities; the maximum is taken off first, so no exponential overflows.

    Each step is a column of its own and so computed once per row.
    """
    z, shifted = F.col(logits), "__shifted"
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return (
        df.withColumn(shifted, _minus(z, F.array_max(z)))
        .withColumn(out, _minus(F.col(shifted), F.log(total)))
        .drop(shifted)
    )


def argmax(values: Column | str) -> Column:
    """Zero-based position of the largest value, the lowest one on ties."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(label_id: Column | str, k: int) -> Column:
    positions = F.array(*[F.lit(i) for i in range(k)])
    return F.transform(positions, lambda i: (i == _col(label_id)).cast("double"))


def cross_entropy(log_probs: Column | str, label_id: Column | str) -> Column:
    """Per-row loss: minus the log-probability of the true label."""
    return -F.try_element_at(_col(log_probs), (_col(label_id) + 1).cast("int"))
