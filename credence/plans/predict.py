"""Apply a saved classifier to sentences and store the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas
from ..operators import model


def predict_to_table(
    model_path: str, sentences: DataFrame, out: str, label_list: Sequence[int] = tuple(range(11)),
    token_limit: int | None = None, keep: Sequence[str] = (),
) -> None:
    fitted = PipelineModel.load(model_path)
    model.predict_sentences(fitted, sentences, label_list, token_limit=token_limit, keep=keep).write.mode(
        "overwrite"
    ).parquet(out)


def read_predictions(spark: SparkSession, path: str, keep: T.StructType | None = None) -> DataFrame:
    """What ``predict_to_table`` wrote; ``keep`` has the fields it carried along."""
    fields = [*(keep.fields if keep else ()), *schemas.PREDICTIONS.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
