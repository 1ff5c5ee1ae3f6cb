"""The queries of this subpackage: one for each operator, over its whole table, and what SQL says to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, kdshard, mixing, neardup, oracles, quality, secrets_scan, tokens, urlfilter, warc
from .common import scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is one whose id has a label; bad is low quality or toxic."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urlfilter.filter_urls(_read(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), digest=True).drop("rejected_by")


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokens.write_tokens(_read(spark, sf_dir, "documents"), out, tokens.vocabulary_path())
    return tokens.read_documents(spark, out)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.shard_documents(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mix": op2_mix,
    "op3_main_text": op3_main_text,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_kd_shards": op10_kd_shards,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": oracles.OP1, "op4_url_filter": oracles.OP4, "op7_quality": oracles.OP7, "op9_near_duplicates": oracles.OP9}
