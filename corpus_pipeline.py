"""Corpus pipeline: filter, deduplicate, decontaminate, redact and encode documents.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written
as Parquet below the shared folder and reread as the next stage's ``docs``. All
but the last keep the columns of ``documents``. Models and tables that a stage
learns from or compares with come from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import decontaminate, quality, secrets, simhash, spm_codec
from cadence.llm.common import read_table, small_batches
from cadence.session import shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.3 go."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit_from_tables(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    small_batches(spark)
    return simhash.keep_one_per_component(docs, shingle=3, max_distance=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; documents stay."""
    small_batches(spark)
    return secrets.redact_secrets(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document left."""
    small_batches(spark)
    return spm_codec.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learnt rules nor the encoder; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; the last one's rows, written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
