"""Fits of few rows with many features: the optimum, and what their steps send to the driver."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from credence.operators import model, rowspace
from credence.plans import train
from tests.test_model import plain_fit

SLICES = {"train": (0, 80), "dev": (80, 120), "test": (120, 150)}


def sentences(spark, kinds):
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, 60) % 700), int(rng.integers(0, kinds))) for k in range(150)]
    rows += [(150, None, 0), (151, "", 1)]
    return spark.createDataFrame(rows, "doc_id long, sentence string, label int")


@pytest.mark.parametrize("per_task", [10_000, 50])
@pytest.mark.parametrize("kinds", [2, 4])
def test_fit_by_rows_is_the_optimum(spark, tmp_path, monkeypatch, kinds, per_task):
    monkeypatch.setattr(train, "ROWS_PER_TASK", per_task)
    monkeypatch.setattr(model.LogisticRegression, "_fit", lambda *_: pytest.fail("a step would send a number for each feature"))
    made = []
    own = rowspace.RowSpace.product
    monkeypatch.setattr(rowspace.RowSpace, "product", lambda self, rows: made.append(rows.shape) or own(self, rows))
    data = sentences(spark, kinds)
    labels = tuple(range(kinds))
    trained = train.train_and_evaluate(data, "doc_id", "label", labels, 152, SLICES, num_features=256)
    assert all(r.steps > 0 for r in trained.path.collect())
    assert made and set(made) == {(80, kinds)}
    parts = train.split_sample(data, "doc_id", 152, SLICES, 7)
    features = model.text_features(256).fit(model.with_tokens(parts.filter("split = 'train'"), "sentence"))
    rows = features.transform(model.with_tokens(parts.filter("split = 'train'"), "sentence")).collect()
    x, y = np.array([r.weights.toArray() for r in rows]), np.array([r.label for r in rows])
    x = x[:, x.any(axis=0)]
    assert x.shape[1] > 160
    penalty = trained.path.filter("chosen").first().penalty
    want = plain_fit(x, y, kinds, penalty, steps=12)
    got = {r.doc_id: r.log_probs for r in trained.judged.collect()}
    for r, logs in zip(rows, want, strict=True):
        assert np.allclose(got[r.doc_id], logs, atol=2e-4)
    trained.model.write().save(str(tmp_path / "model"))
    again = model.predict(PipelineModel.load(str(tmp_path / "model")), model.with_tokens(data, "sentence"), labels)
    for r in again.join(trained.judged.select("doc_id", F.col("log_probs").alias("first")), "doc_id").collect():
        assert np.allclose(r.log_probs, r.first)


def test_one_label_is_left_to_spark(spark):
    trained = train.train_and_evaluate(sentences(spark, 1).filter("label = 0"), "doc_id", "label", (0,), 150, SLICES, num_features=256)
    assert {r.pred for r in trained.judged.collect()} == {0}


@pytest.mark.parametrize("penalty", [1.0, 0.1, 0.01])
def test_far_first_step_is_taken_back(spark, penalty):
    """The first step of rows with very many features goes far beyond the least loss. At the optimum the
    coefficients are the rows times what is left of their labels, by the penalty."""
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(0, 2)), Vectors.sparse(3000, {int(j): float(rng.integers(1, 9)) for j in rng.integers(0, 3000, 300)})) for _ in range(60)]
    space = rowspace.RowSpace(spark.createDataFrame(data, ["label_id", "features"]))
    found = rowspace.fit(space, penalty, 500, 1e-10)
    margins = found.place[60:-1] + found.place[-1]
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    left = np.eye(2)[[y for y, _ in data]] - p / p.sum(axis=1, keepdims=True)
    assert found.steps > 0 and np.abs(left.sum(axis=0)).max() < 1e-3
    x = np.array([v.toArray() for _, v in data])
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0, ddof=1), 1)
    assert np.allclose(x.T @ found.place[:60], x.T @ left / 60 / penalty, atol=2e-4)
    space.close()
