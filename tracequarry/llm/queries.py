"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import decontamination, ngram_scores, packing, quality, secrets, simhash, substring_dedup, suffix_dedup, token_counts, topk

VOCABULARY = "byte_bpe_50k.json"
PACKING_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op3_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores.digest(ngram_scores.ngram_scores(table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_VOCABULARY))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_ngram_scores, op4_quality, op5_packing, op6_substring_dedup, op7_secret_scans, op8_decontamination, op9_exact_top_k, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix_dedup.SQL, "op3_ngram_scores": ngram_scores.SQL, "op6_substring_dedup": substring_dedup.SQL, "op8_decontamination": decontamination.SQL, "op9_exact_top_k": topk.SQL}
