"""Softmax classifier: features, training, batch prediction, loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import label as labels


# A fit ends where the loss has settled to eight digits, one that is only compared with others to
# five; the steps are a stop for one that never settles.
TOLERANCE, COMPARED, MOST_STEPS = 1e-8, 1e-5, 5000


def text_features(num_features: int = 1 << 16) -> Pipeline:
    """``weights``: hashed token counts times inverse document frequency.

    Hashing needs no vocabulary pass and keeps the coefficients at labels x features.
    """
    return Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=num_features),
        IDF(inputCol="counts", outputCol="weights"),
    ])


def used_features(fitted: PipelineModel) -> VectorSlicer:
    """``features``: the weights of the slots that some token of the fitted rows fell in. At the optimum
    all others have the coefficient zero, so leaving them out changes no fit."""
    used = [k for k, rows in enumerate(fitted.stages[1].docFreq) if rows > 0]
    return VectorSlicer(inputCol="weights", outputCol="features", indices=used or [0])


def softmax(reg: float = 0.01, max_iter: int = MOST_STEPS, tol: float = TOLERANCE) -> LogisticRegression:
    """Multinomial logistic regression over ``features``, with an intercept that is not penalised.
    Features are penalised as if all had the same deviation."""
    return LogisticRegression(
        family="multinomial", featuresCol="features", labelCol="label_id", maxIter=max_iter, regParam=reg, tol=tol
    )


def vector_pipeline(max_iter: int = MOST_STEPS, reg: float = 0.0) -> Pipeline:
    """The softmax layer alone, over a ``features`` vector column."""
    return Pipeline(stages=[softmax(reg, max_iter)])


def with_tokens(examples: DataFrame, text_a: str = "text_a", token_limit: int | None = None) -> DataFrame:
    """``tokens``: all of them, or the first ``token_limit`` where the model reads no more."""
    tokens = text.tokens(text_a) if token_limit is None else text.first_tokens(text_a, token_limit)
    return examples.withColumn("tokens", F.coalesce(tokens, F.array().cast("array<string>")))


def with_vector(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def with_label_id(examples: DataFrame, label_list: Sequence[int], label: str = "label") -> DataFrame:
    return examples.withColumn("label_id", labels.label_index(label, list(label_list)))


def predict(model: PipelineModel, examples: DataFrame, label_list: Sequence[int]) -> DataFrame:
    """Adds ``log_probs`` (from the logits, so never the log of zero), ``pred_id`` and ``pred``."""
    scored = model.transform(examples).withColumn("logits", vector_to_array("rawPrediction"))
    return (
        vectors.with_log_softmax(scored)
        .withColumn("pred_id", vectors.argmax("log_probs"))
        .withColumn("pred", F.try_element_at(F.lit([int(x) for x in label_list]), F.col("pred_id") + 1))
    )


def predict_sentences(model: PipelineModel, sentences: DataFrame, label_list: Sequence[int],
                      sentence: str = "sentence", token_limit: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Text in; ``sentence, log_probs, label`` out, scored in the same row, after ``keep``."""
    scored = predict(model, with_tokens(sentences, sentence, token_limit), label_list)
    return scored.select(*keep, F.col(sentence).alias("sentence"), "log_probs", F.col("pred").alias("label"))


def label_sums(scored: DataFrame, labels: Sequence[int], *by: str) -> DataFrame:
    """``label, rows, expected`` for each of ``labels``: how many rows have it, and the sum of
    its probability. At a fit's optimum both are equal over the rows it was fitted on."""
    each = F.explode(F.array(*[
        F.struct(F.lit(int(x)).alias("label"), (F.col("label_id") == k).cast("int").alias("is"),
                 F.coalesce(F.exp(F.try_element_at("log_probs", F.lit(k + 1))), F.lit(0.0)).alias("p"))
        for k, x in enumerate(labels)
    ]))
    return scored.select(*by, each.alias("e")).groupBy(*by, "e.label").agg(
        F.sum("e.is").alias("rows"), F.sum("e.p").alias("expected")
    )


def mean_loss(scored: DataFrame) -> DataFrame:
    """Mean cross-entropy of ``log_probs`` against ``label_id``."""
    return scored.agg(F.avg(vectors.cross_entropy("log_probs", "label_id")).alias("loss"))


# The variants tried: label kind, corpus, whitespace handling, token limit.
VARIANT_LABELS = ("sentiment", "polarity")
VARIANT_CORPORA = ("known", "combined")
VARIANT_SPACES = ("raw", "stripped")
VARIANT_LIMITS = (32, 128, 256)


def variants() -> list[dict]:
    return [
        {"label_kind": kind, "corpora": corpora, "spaces": spaces, "token_limit": limit}
        for kind in VARIANT_LABELS for corpora in VARIANT_CORPORA
        for spaces in VARIANT_SPACES for limit in VARIANT_LIMITS
    ]


def variant_counts(articles: DataFrame) -> DataFrame:
    """What each variant would train on: ``rows``, distinct ``labels``, ``tokens`` kept.

    Articles (``corpus, sentiment, polarity, text``) are read once and summed per
    corpus and score; the variants are laid over those few sums, never over articles.
    """
    def kept(column, limit):
        return F.sum(F.least(F.col(column), F.lit(limit - 2)).cast("bigint"))

    longest = max(VARIANT_LIMITS) - 2
    tokenized = articles.select(
        "corpus", "sentiment", "polarity",
        text.token_count("text", longest).alias("raw"),
        text.token_count(text.strip_control("text"), longest).alias("stripped"),
    )
    sums = tokenized.groupBy("corpus", "sentiment", "polarity").agg(
        F.count("*").alias("rows"),
        *[kept(s, n).alias(f"{s}_{n}") for s in VARIANT_SPACES for n in VARIANT_LIMITS],
    )
    grid = F.array(*[
        F.struct(
            F.lit(v["label_kind"]).alias("label_kind"), F.lit(v["corpora"]).alias("corpora"),
            F.lit(v["spaces"]).alias("spaces"), F.lit(v["token_limit"]).alias("token_limit"),
            F.col(v["label_kind"]).alias("label"),
            F.col(f"{v['spaces']}_{v['token_limit']}").alias("tokens"),
        )
        for v in variants()
    ])
    return (
        sums.select("corpus", "rows", F.inline(grid))
        .filter((F.col("corpora") == "combined") | (F.col("corpus") == "known"))
        .groupBy("label_kind", "corpora", "spaces", "token_limit")
        .agg(
            F.sum("rows").alias("rows"),
            F.count_distinct("label").alias("labels"),
            F.sum("tokens").alias("tokens"),
        )
    )
