"""All queries of the library by name, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import dedup, pii, quality, selection

from . import corpus_queries, question_queries, result_queries, selection_queries, stream_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES, table

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents to the split corpus, by source and side: paragraphs filtered in place, short documents out, copies out, personal data replaced, hash split.
    Two shuffles of ids and counts for the copies and the split; texts move with their ids once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = F.filter(F.split("text", "\n"), lambda p: (F.trim(p) != "") & quality.paragraph_rule(p).isNull())
    docs = docs.withColumn("text", F.array_join(kept, "\n")).withColumn("n_words", F.size(T.tokens(F.col("text")))).where("n_words >= 50")
    docs = docs.join(dedup.exact_duplicates(docs).select(F.col("dropped").alias("doc_id")), "doc_id", "left_anti")
    s = docs.withColumn("s", pii.scrub(F.col("text"))).select("doc_id", "source", "n_words", F.expr("s.email + s.phone + s.id").alias("replaced"))
    split = selection.stratified_split(s, "doc_id", "source")
    return split.groupBy("source", "split").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"), F.sum("replaced").alias("replaced"))
