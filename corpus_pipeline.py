"""From raw documents to token files: the stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, mixing, neardup, quality, tokens
from tessella.llm.common import scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go; null and empty texts are among them."""
    return quality.keep_good(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item, up to its edits, go."""
    return decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix of sources (5, 2, 1, repeating) takes it."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: the mix as wavelet-matrix shards, and from these doc_id, start, n_tokens and ids_crc32 of each row."""
    out = scratch(spark, "pipeline-tokens")
    tokens.write_tokens(docs, out, tokens.vocabulary_path())
    return tokens.read_documents(spark, out)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", keep_first),
    ("benchmark decontamination", keep_clean),
    ("mixing sources", mixed),
    ("token-ID output", to_tokens),
]
#: SQL can express neither the bands of the near-duplicates nor the tokens; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
