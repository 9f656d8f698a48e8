"""From raw documents to token ids: quality rules, near duplicates, benchmark passages, secrets, BPE.

Each stage reads all that the one before it kept; what it decides takes effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard_join, quality_rules, secrets
from tidemark.llm.common import delete, shared_dir, temporary
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the adaptive rules."""
    return quality_rules.passing(spark, docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard_join.representatives(spark, docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that hold little else go."""
    return decontaminate.decontaminate(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials masked."""
    return secrets.redact(spark, docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.round_trip(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark_passages),
    ("secret_scans", live_secrets),
    ("bpe", tokens),
]

#: Adaptive limits, connected components and BPE merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next. Of all that is written, the last stage's rows stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        with temporary():
            done = stage(spark, docs, sf_dir)
            done.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{root}/{name}")
        if last:
            delete(spark, f"{root}/{last}")
        last = name
    return docs
