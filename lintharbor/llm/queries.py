"""The registered queries of the operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    filter_audit,
    language_id,
    license_scan,
    merkle_manifest,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    source_mixing,
    suffix_dedup,
    token_records,
    toxicity,
)
from .oracle import SQL  # noqa: F401


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Component of near-duplicates of each document."""
    return ngram_join.components_of(_table(spark, sf, "documents").select("doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """License notices of all documents."""
    return license_scan.scan(_table(spark, sf, "documents").select("doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf, "documents").select("doc_id", "text"))


def op4_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items held by each document."""
    return decontamination.matches(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each document."""
    return language_id.identify(_table(spark, sf, "documents").select("doc_id", "text", "lang"))


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of each document from both views."""
    return quality_classifier.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts of each document and the verdict of the adaptive limits."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity.classify(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each document that belong to no 200-byte string found elsewhere."""
    return suffix_dedup.dedup(_table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_token_records(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as binary token records, read back through their index."""
    out = token_records.scratch(spark, "token-records")
    token_records.write_records(_table(spark, sf, "documents").select("doc_id", "text"), out)
    return token_records.read_index(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes, in every order and for each language."""
    return filter_audit.audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op12_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix by source weights takes of each document."""
    return source_mixing.mix(_table(spark, sf, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and checked proof of each document."""
    return merkle_manifest.manifest(_table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_records": op10_token_records,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_mixing": op12_source_mixing,
    "op13_merkle_manifest": op13_merkle_manifest,
}
