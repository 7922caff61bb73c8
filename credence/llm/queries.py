"""Each operator applied to its whole table, with the parameters a production run would use."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, collocations, decontamination, dedup, fingerprints, language, mixing, quality, sharding, tokens, urls, warc
from .common import table
from .jaccard import similar_groups


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op2_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, language.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    out = language.identify(docs, model)
    return out.withColumn("held_out", ~language.in_training(out.doc_id)).select("doc_id", "held_out", "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page shows the document of the same number, so that document's labels tag it.
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), bad)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(table(spark, sf_dir, "documents"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_shingle_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_orchard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fingerprints": op1_merkle_fingerprints,
    "op2_two_pass_sharding": op2_two_pass_sharding,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_source_mix": op5_source_mix,
    "op6_warc_archive": op6_warc_archive,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_shingle_jaccard_join": op9_shingle_jaccard_join,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_orchard_clustering": op11_orchard_clustering,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_exact_dedup": op13_exact_dedup,
}
