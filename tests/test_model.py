"""Softmax head, training, prediction and evaluation."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from credence.functions import vectors
from credence.operators import evaluate, model
from credence.plans import predict, train


def test_head_against_numpy(spark):
    rng = np.random.default_rng(1)
    w, b, x = rng.normal(size=(4, 6)), rng.normal(size=4), rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<float>")
    df = df.union(spark.createDataFrame([(99, None)], "i int, v array<float>"))
    scored = vectors.with_log_softmax(df.select("i", vectors.linear_logits("v", w, b).alias("logits")))
    got = {r["i"]: r["log_probs"] for r in scored.collect()}
    z = x.astype("float32").astype("float64") @ w.T + b
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert got[99] is None
    for i in range(20):
        assert np.allclose(got[i], want[i], atol=1e-9)
        assert math.isclose(sum(math.exp(v) for v in got[i]), 1.0, rel_tol=1e-9)


def test_log_softmax_does_not_overflow(spark):
    df = spark.createDataFrame([([1e4, 0.0, 1e4],)], "logits array<double>")
    row = vectors.with_log_softmax(df).withColumn("pred", vectors.argmax("log_probs")).first()
    assert row["log_probs"] == [pytest.approx(-math.log(2)), pytest.approx(-1e4 - math.log(2)), pytest.approx(-math.log(2))]
    assert row["pred"] == 0, "the lowest index wins a tie"


def test_loss_and_one_hot(spark):
    df = spark.createDataFrame([([-0.1, -2.0], 1), ([-0.5, -1.0], 0)], "log_probs array<double>, label_id int")
    assert model.mean_loss(df).first()["loss"] == pytest.approx(1.25)
    hot = df.select(vectors.one_hot("label_id", 3).alias("h")).collect()
    assert [r["h"] for r in hot] == [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]


def judged(spark, tp, tn, fp, fn):
    data = [(1, 1)] * tp + [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn
    return spark.createDataFrame(data, "label int, pred int")


def test_binary_metrics(spark):
    df = judged(spark, 3, 2, 1, 4)
    m = evaluate.binary_metrics(df).first()
    assert (m["tp"], m["tn"], m["fp"], m["fn"]) == (3, 2, 1, 4)
    assert m["tp"] + m["tn"] + m["fp"] + m["fn"] == df.count()
    assert m["accuracy"] == evaluate.accuracy(df).first()["accuracy"] == 0.5
    assert [round(m[c], 6) for c in ("precision", "recall", "f1", "auc")] == [0.75, 0.428571, 0.545455, 0.547619]
    assert evaluate.confusion(df).agg(F.sum("count")).first()[0] == 10


def test_hard_auc_is_the_evaluators(spark):
    df = judged(spark, 3, 2, 1, 4).withColumn("score", F.col("pred").cast("double"))
    hard = evaluate.binary_metrics(df).first()["auc"]
    assert evaluate.score_auc(df, "score").first()["auc"] == pytest.approx(hard)


@pytest.mark.parametrize("parts", [2, 200])
def test_score_auc_against_all_pairs(spark, parts):
    rng = np.random.default_rng(5)
    data = [(int(rng.integers(0, 2)), float(rng.integers(0, 40)) if rng.random() < 0.95 else None) for _ in range(400)]
    df = spark.createDataFrame(data, "label int, score double")
    pos, neg = ([s for y, s in data if y == k and s is not None] for k in (1, 0))
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.score_auc(df, "score", parts=parts).first()["auc"] == pytest.approx(wins)
    assert evaluate.score_auc(df.filter("label = 1"), "score").first()["auc"] is None


def test_empty_ratios_are_zero(spark):
    m = evaluate.binary_metrics(judged(spark, 0, 2, 0, 0)).first()
    assert (m["precision"], m["recall"], m["f1"], m["auc"]) == (0.0, 0.0, 0.0, 0.5)


@pytest.fixture
def labelled(spark):
    good = [(f"g{i}", f"calm report number {i} with sources", 9, 1, "known") for i in range(60)]
    bad = [(f"b{i}", f"shocking secret number {i} they hide", 2, 0, "known" if i % 2 else "listed") for i in range(60)]
    return spark.createDataFrame(
        good + bad, "name string, sentence string, sentiment int, polarity int, corpus string"
    )


def test_softmax_fit_is_the_maximum_likelihood(spark):
    """With an intercept, the mean probability of a label at the optimum is its frequency,
    and the residuals are orthogonal to every feature."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x @ rng.normal(size=(3, 4)) + rng.normal(size=(300, 4))).argmax(axis=1)
    df = spark.createDataFrame(
        [([float(v) for v in r], int(k)) for r, k in zip(x, y, strict=True)], "v array<double>, label_id int"
    )
    rows = model.with_vector(df, "v")
    fitted = model.vector_pipeline(max_iter=200).fit(rows)
    scored = model.predict(fitted, rows, (0, 1, 2, 3)).collect()
    p = np.exp(np.array([r["log_probs"] for r in scored]))
    residual = p - np.eye(4)[[r["label_id"] for r in scored]]
    features = np.array([r["v"] for r in scored])
    assert np.abs(residual.mean(axis=0)).max() < 1e-3
    assert np.abs(features.T @ residual / 300).max() < 1e-3
    assert all(r["pred"] == int(np.argmax(q)) for r, q in zip(scored, p, strict=True))


SLICES = {"train": (0, 80), "dev": (81, 100), "test": (101, 119)}


@pytest.mark.parametrize("kind,labels", [("polarity", (0, 1)), ("sentiment", tuple(range(11)))])
def test_training_separates_what_is_separable(spark, labelled, tmp_path, kind, labels):
    fitted, scored, _ = train.train_and_evaluate(
        labelled, "name", kind, labels, 120, SLICES, num_features=512
    )
    measures = {r["split"]: r for r in evaluate.split_measures(scored, binary=kind == "polarity").collect()}
    if kind == "polarity":
        for r in measures.values():
            assert (r["f1"], r["auc"], r["precision"], r["recall"]) == (1.0, 1.0, 1.0, 1.0) and r["tp"] + r["tn"] == r["rows"]
    sums = model.label_sums(scored.filter("split = 'train'"), labels).collect()
    assert sum(r["rows"] for r in sums) == 80 and all(abs(r["rows"] - r["expected"]) < 0.05 for r in sums)
    assert (measures["dev"]["rows"], measures["test"]["rows"]) == (19, 18)
    assert measures["dev"]["accuracy"] == measures["test"]["accuracy"] == 1.0
    assert 0 < measures["dev"]["loss"] < 1
    for row in scored.collect():
        assert sum(math.exp(v) for v in row["log_probs"]) == pytest.approx(1.0)

    fitted.write().overwrite().save(str(tmp_path / "model"))
    sentences = spark.createDataFrame([("a calm report with sources",), ("a shocking secret",), ("",)], "sentence string")
    predict.predict_to_table(str(tmp_path / "model"), sentences, str(tmp_path / "out"), labels)
    out = {r["sentence"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["a calm report with sources"] == (1 if kind == "polarity" else 9)
    assert out["a shocking secret"] == (0 if kind == "polarity" else 2)
    assert len(out) == 3
    assert isinstance(PipelineModel.load(str(tmp_path / "model")), PipelineModel)


def test_variants(spark, labelled):
    counts = model.variant_counts(labelled.withColumnRenamed("sentence", "text"))
    got = {(r["label_kind"], r["corpora"], r["spaces"], r["token_limit"]): r for r in counts.collect()}
    assert len(got) == len(model.variants()) == 24
    assert got["polarity", "combined", "raw", 32]["rows"] == 120
    assert got["polarity", "known", "raw", 32]["rows"] == 90
    assert got["sentiment", "known", "raw", 32]["labels"] == 2
    assert got["sentiment", "combined", "stripped", 128]["tokens"] == 60 * 6 + 60 * 6


def test_run_variants(spark, labelled):
    grid = [v for v in model.variants() if v["token_limit"] == 32 and v["label_kind"] == "polarity"][:2]
    runs = train.run_variants(labelled, "name", 90, {"train": (0, 60), "dev": (61, 85)}, grid=grid, num_features=512)
    assert [v for v, _ in runs] == grid
    for _, (_, judged, path) in runs:
        assert path.filter("chosen").count() == 1
        dev = evaluate.split_measures(judged).filter("split = 'dev'").first()
        assert dev["rows"] == 24 and dev["accuracy"] > 0.8


def test_command_line_trains_and_predicts(spark, tmp_path, capsys):
    from credence.__main__ import main

    articles = spark.createDataFrame(
        [(f"k{i}_{9 if i % 2 else 1}", f"k{i}", 9 if i % 2 else 1, i % 2,
          f"{'calm report' if i % 2 else 'shocking secret'} number {i}", "known") for i in range(120)],
        "name string, sha1 string, sentiment int, polarity int, text string, corpus string",
    )
    articles.write.partitionBy("corpus", "polarity").parquet(str(tmp_path / "processed"))
    (tmp_path / "sentences.txt").write_text("a calm report\na shocking secret\n")
    main(["train", str(tmp_path / "processed"), str(tmp_path / "model"), "--label", "polarity"])
    main(["predict", str(tmp_path / "model"), str(tmp_path / "sentences.txt"), str(tmp_path / "out"), "--label", "polarity"])
    got = {r["sentence"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a calm report": 1, "a shocking secret": 0}
    main(["train", str(tmp_path / "processed"), str(tmp_path / "other"), "--label", "polarity", "--corpora", "known", "--spaces", "stripped",
          "--token-limit", "32", "--sample", "110", "--slice", "train=0:90", "--slice", "dev=90:110", "--seed", "3"])
    shown = capsys.readouterr().out
    assert "|  dev|  20|" in shown and "|train|  90|" in shown and "f1" in shown and "auc" in shown


def plain_fit(x, y, k, penalty, steps=4000):
    """Penalised softmax by Newton's method on standardised features, the intercept free."""
    n, d = x.shape
    scale = x.std(axis=0, ddof=1)
    z1 = np.hstack([np.where(scale > 0, x / np.where(scale > 0, scale, 1), 0), np.ones((n, 1))])
    w = np.zeros((k, d + 1))
    ridge = np.append(np.full(d, penalty), 0)
    for _ in range(steps):
        s = z1 @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = (p - np.eye(k)[y]).T @ z1 / n + ridge * w
        if np.abs(grad).max() < 1e-12:
            break
        hess = np.zeros((k * (d + 1),) * 2)
        for a in range(k):
            for b in range(k):
                q = p[:, a] * ((a == b) - p[:, b])
                hess[a * (d + 1):(a + 1) * (d + 1), b * (d + 1):(b + 1) * (d + 1)] = (z1 * q[:, None]).T @ z1 / n
        hess += np.diag(np.tile(ridge, k)) + 1e-12 * np.eye(k * (d + 1))
        w -= np.linalg.lstsq(hess, grad.ravel(), rcond=None)[0].reshape(k, d + 1)
    s = z1 @ w.T
    return s - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - s.max(axis=1, keepdims=True)


def test_fits_reach_the_optimum_and_the_path_is_judged_on_dev(spark, labelled):
    """Log-probabilities of every slice, and the whole path, against Newton's method."""
    slices = {"train": (0, 70), "dev": (70, 100), "test": (100, 120)}
    noisy = labelled.withColumn("sentence", F.concat(
        F.array_join(F.slice(F.split("sentence", " "), F.pmod(F.hash("name"), F.lit(3)) + 1, F.lit(2)), " "), F.lit(" "),
        F.expr("array('the', 'a', 'one')[pmod(hash(name, 1), 3)]")))
    trained = train.train_and_evaluate(noisy, "name", "polarity", (0, 1), 120, slices, num_features=16)
    parts = train.split_sample(noisy, "name", 120, slices, 7)
    features = model.text_features(16).fit(model.with_tokens(parts.filter("split = 'train'"), "sentence"))
    rows = features.transform(model.with_tokens(parts, "sentence")).collect()
    x = np.array([r.weights.toArray() for r in rows])
    y = np.array([r.polarity for r in rows])
    of = np.array([r.split for r in rows])
    own = {}
    for penalty in train.PENALTIES:
        logs = plain_fit(x[of == "train"], y[of == "train"], 2, penalty)
        own[penalty] = logs
    path = {r.penalty: r for r in trained.path.collect()}
    tried = sorted(path, reverse=True)
    assert tried == list(train.PENALTIES[: len(tried)]) and [r.chosen for r in path.values()].count(True) == 1
    assert len(tried) == len(train.PENALTIES) or path[tried[-1]].loss > path[tried[-2]].loss
    chosen = next(p for p, r in path.items() if r.chosen)
    assert path[chosen].loss == min(r.loss for r in path.values()) and path[chosen].rows == 30
    got = {r.name: r.log_probs for r in trained.judged.collect()}
    train_rows = [r for r in rows if r.split == "train"]
    for r, want in zip(train_rows, own[chosen], strict=True):
        assert np.allclose(got[r.name], want, atol=2e-4), chosen
    measures = {r["split"]: r for r in evaluate.split_measures(trained.judged, binary=True).collect()}
    assert measures["dev"]["loss"] == pytest.approx(path[chosen].loss, rel=0.02)
    judged_rows = {r.name: r for r in trained.judged.collect()}
    for split in ("train", "dev", "test"):
        inside = [r for r in rows if r.split == split]
        loss = -np.mean([judged_rows[r.name].log_probs[r.polarity] for r in inside])
        right = np.mean([int(np.argmax(judged_rows[r.name].log_probs)) == r.polarity for r in inside])
        assert measures[split]["loss"] == pytest.approx(loss) and measures[split]["accuracy"] == pytest.approx(right)


@pytest.mark.parametrize("parts", [2, 200])
def test_threshold_curve_against_counting(spark, parts):
    rng = np.random.default_rng(9)
    data = [(int(rng.integers(0, 2)) if rng.random() < 0.9 else None, float(rng.integers(0, 25)) if rng.random() < 0.95 else None) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, score double")
    rows = [(y, s) for y, s in data if s is not None and y is not None]
    curve = {r.threshold: r for r in evaluate.threshold_curve(df, "score", parts=parts).collect()}
    assert set(curve) == {s for _, s in rows}
    for t, r in curve.items():
        tp, fp = (sum(y == k and s >= t for y, s in rows) for k in (1, 0))
        fn, tn = (sum(y == k and s < t for y, s in rows) for k in (1, 0))
        assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
        assert r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0) and r.fpr == pytest.approx(fp / (fp + tn))
    best = evaluate.best_threshold(df, "score", parts=parts).collect()
    assert [(best[0].f1, best[0].threshold)] == [max((r.f1, t) for t, r in curve.items())]
    assert evaluate.best_threshold(df.filter("label is null"), "score").collect() == []
