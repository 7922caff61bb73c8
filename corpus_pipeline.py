"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; what it returns is
written as Parquet and read back before the next one begins. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from credence.llm import decontamination, jaccard, language, mixing, sharding
from credence.llm.common import staged

LEAST_SCORE = 0.5
SEED = 0
SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: no null text, no text without letters, one likeliest language."""
    model = language.fit(docs, language.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return language.told(docs, model, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one with the least doc_id."""
    return jaccard.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times."""
    return mixing.mixed(docs, SEED)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard and the slot in it where they are written."""
    return sharding.sharded(docs, SHARDS, SEED).drop("bucket", "position", "grown_shard")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("sharding", shard),
]
# The language model and the edit distances have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
