"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of
`documents`; `run` writes each result as Parquet below the shared folder and reads it for the next.
A stage works on all its predecessor kept, whatever columns come along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintharbor.llm import decontamination, ngram_join, packing, quality_rules, suffix_dedup
from lintharbor.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits of their language and source."""
    return quality_rules.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return ngram_join.one_per_group(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 200-byte strings found elsewhere; n_chars counts what is left.

    A document of which nothing is left stays, with an empty text.
    """
    kept = suffix_dedup.dedup(docs.select(*COLUMNS), keep_text=True)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.without_matches(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_items),
    ("best_fit_packing", pack),
]

#: Tokens and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the `documents` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
