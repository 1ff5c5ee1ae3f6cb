"""Lexical retrieval and statistics: TF-IDF keywords, BM25, diversity, multiset overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T


def keywords(docs: DataFrame, reference: DataFrame, top: int, least_tf: int = 20, least_df: int = 3, least_length: int = 3) -> DataFrame:
    """(term, tf, df, score): tf * ln(n / (1 + reference df)) over documents (doc_id, text); the best terms, ties by term, descending."""
    n = reference.select("doc_id").distinct().count()
    term = lambda d: d.select("doc_id", F.explode(T.words(F.col("text"))).alias("term"))
    tf = term(docs).groupBy("term", "doc_id").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))
    tf = tf.where((F.col("tf") >= least_tf) & (F.col("df") >= least_df) & (F.length("term") >= least_length))
    ref = term(reference).distinct().groupBy("term").agg(F.count("*").alias("rdf"))
    scored = tf.join(ref, "term", "left").withColumn("score", F.round(F.col("tf") * F.ln(F.lit(float(n)) / (1 + F.coalesce("rdf", F.lit(0)))), 6))
    return scored.orderBy(F.col("score").desc(), F.col("term").desc()).limit(top).select("term", "tf", "df", "score")


def bm25(queries: DataFrame, docs: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q, doc, score, rank): the best ``top`` documents (id, text) for each query (id, text), a query being its set of content words.

    Postings of words that no query has never leave their partition: they are dropped by a semi-join before they are counted across documents. Scores are summed
    in the map stage first; a query's documents are cut to ``top`` by rank, ties by id.
    """
    q = queries.select(F.col("id").alias("q"), F.explode(F.array_distinct(T.content_words(F.col("text")))).alias("term"))
    bags = docs.select(F.col("id").alias("doc"), T.content_words(F.col("text")).alias("w"))
    n, mean = bags.agg(F.count("*"), F.avg(F.size("w"))).first()
    post = bags.select("doc", F.size("w").alias("len"), F.explode("w").alias("term"))
    post = post.join(q.select("term").distinct(), "term", "left_semi").groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1))))
    scores = post.join(df, "term").withColumn("part", part).join(q, "term").groupBy("q", "doc").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "doc"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top)


def diversity(texts: DataFrame, n: int = 4, group: str = "grp") -> DataFrame:
    """(group, texts, distinct_n, entropy, mean_words): share of distinct word n-grams over all, bits of the word distribution."""
    w = texts.select(group, T.words(F.col("text")).alias("w"))
    grams = w.select(group, F.explode(T.ngrams(F.col("w"), n)).alias("g")).groupBy(group, "g").agg(F.count("*").alias("c"))
    distinct = grams.groupBy(group).agg((F.count("*") / F.sum("c")).alias("distinct_n"))
    unigrams = w.select(group, F.explode("w").alias("u")).groupBy(group, "u").agg(F.count("*").cast("double").alias("c"))
    total = F.sum("c")
    entropy = unigrams.groupBy(group).agg(((F.ln(total) - F.sum(F.col("c") * F.ln("c")) / total) / F.ln(F.lit(2.0))).alias("entropy"))
    sizes = w.groupBy(group).agg(F.count("*").alias("texts"), F.avg(F.size("w")).alias("mean_words"))
    out = sizes.join(distinct, group, "left").join(entropy, group, "left")
    return out.select(group, "texts", *[F.round(c, 6).alias(c) for c in ("distinct_n", "entropy", "mean_words")])


def multiset_overlap(pairs: DataFrame, a: str, b: str, ident: list[str]) -> DataFrame:
    """(ident, overlap): sum of the least counts of each word over the longer text's words, for pairs of texts in a row."""
    words_ = F.struct(T.words(F.col(a)).alias("a"), T.words(F.col(b)).alias("b"))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))

    def share(p: Column) -> Column:
        most = F.greatest(F.size(p["a"]), F.size(p["b"]))
        common = F.aggregate(F.array_intersect(p["a"], p["b"]), F.lit(0), lambda s, x: s + F.least(count(p["a"], x), count(p["b"], x)))
        return F.when(most > 0, common / most).otherwise(0.0)

    return pairs.select(*ident, F.round(T.let(words_, share), 6).alias("overlap"))


def surface_forms(docs: DataFrame) -> DataFrame:
    """(term, surface, n): for each lower-case run of ASCII letters in documents (doc_id, text) its most frequent spelling; ties to the one seen first.
    Counts and first places are combined before the shuffle."""
    at = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "surface"))
    seen = at.groupBy(F.lower("surface").alias("term"), "surface").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("at"))
    best = F.struct("n", -F.col("at.doc_id"), -F.col("at.pos"))
    return seen.groupBy("term").agg(F.max_by("surface", best).alias("surface"), F.max("n").alias("n"))
