"""Exact and near duplicates, first copy wins, cluster reports, question and term keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.storage import staged


def exact_key(text: Column) -> Column:
    """SHA-1 of the text's words, so case, punctuation and spacing don't count."""
    return F.sha1(F.array_join(T.words(text), " "))


def exact_duplicates(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(dropped, kept): every copy but the first of each text. Only ids and digests move; the minimum is combined before the shuffle."""
    keyed = docs.select(F.col(ident), exact_key(F.col("text")).alias("key"))
    first = keyed.groupBy("key").agg(F.min(ident).alias("kept"), F.count("*").alias("n")).where("n > 1").select("key", "kept")
    return keyed.join(first, "key").where(F.col(ident) != F.col("kept")).select(F.col(ident).alias("dropped"), "kept")


def shingled(rows: DataFrame, ident: str, text: str, k: int, whole: bool = False) -> DataFrame:
    """(ident, n, g): the distinct word k-grams of each text and how many there are; shorter texts have none, or with ``whole`` one, themselves."""
    grams = F.array_distinct((T.ngrams_or_whole if whole else T.ngrams)(T.words(F.col(text)), k))
    return rows.select(F.col(ident).alias("id"), grams.alias("gs")).where(F.size("gs") > 0).select("id", F.size("gs").alias("n"), F.explode("gs").alias("g"))


def similar_pairs(rows: DataFrame, ident: str = "id", text: str = "text", k: int = 5, percent: int = 80, whole: bool = False) -> DataFrame:
    """(a, b, common, na, nb), a < b: pairs of texts whose k-gram sets have a Jaccard similarity of ``percent`` or more. Exact.

    Grams are hashed and ordered from rare to common. If two sets are that similar, they share one of the first n - ceil(percent n) + 1 grams of that
    order, so only these enter the join; sizes must allow the similarity; the candidates are then counted over all grams.
    Callers collapse identical texts first, so large groups of copies form no pairs.
    """
    grams = staged(shingled(rows, ident, text, k, whole).select("id", "n", F.xxhash64("g").alias("g")), "grams")
    order = grams.groupBy("g").agg(F.count("*").alias("df"))
    ranked = grams.join(order.where("df > 1"), "g")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    # Grams that stand in one text only come first in the order and can't be shared.
    lonely = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    prefix = ranked.withColumn("place", place + lonely).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = staged(prefix.select("g", "id", "n"), "prefix")
    a, b = prefix.select("g", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("g", F.col("id").alias("b"), F.col("n").alias("nb"))
    sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    pairs = staged(a.join(b, "g").where(sized).select("a", "b", "na", "nb").distinct(), "pairs")
    left = pairs.join(grams.select(F.col("id").alias("a"), "g"), "a")
    both = left.join(grams.select(F.col("id").alias("b"), "g"), ["b", "g"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common", "na", "nb")


def banded_candidates(rows: DataFrame, ident: str, text: str, k: int = 5, bands: int = 9, width: int = 13) -> DataFrame:
    """(a, b) with an equal band of min-hashes: the candidates of banded locality-sensitive hashing, unverified. Each hash is a
    minimum of ``xxhash64(seed, gram)``, one aggregation for all."""
    grams = shingled(rows, ident, text, k)
    mins = [F.min(F.xxhash64(F.lit(i), "g")).alias(f"m{i}") for i in range(bands * width)]
    sig = grams.groupBy("id").agg(*mins)
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[f"m{b * width + i}" for i in range(width)]).alias("h")) for b in range(bands)])
    banded = sig.select("id", F.explode(keys).alias("k"))
    a, b = banded.select("k", F.col("id").alias("a")), banded.select("k", F.col("id").alias("b"))
    return a.join(b, "k").where("a < b").select("a", "b").distinct()


def first_copy_wins(ids: DataFrame, pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, kept): rows in ascending id, each dropped if it is similar to a kept earlier one.

    ``ids``: id; ``pairs``: a < b. A row without undecided or kept earlier neighbours is kept; one with a kept earlier neighbour is dropped; this repeats
    until all are decided. Rounds are written tables, so a lost executor costs a round; their number is the longest chain of similar rows.
    """
    state = staged(ids.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")), "copies")
    links = staged(pairs.select("a", "b"), "links")
    for _ in range(most_rounds):
        before = links.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a")
        seen = before.groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce(F.col("ka"), F.lit(False))).alias("any_kept"), F.max(F.col("ka").isNull()).alias("any_open"))
        now = state.join(seen, "id", "left")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("any_kept", F.lit(False)), False).when(~F.coalesce("any_open", F.lit(False)), True)
        state = staged(now.select("id", decided.alias("kept")), "copies")
        if state.where("kept IS NULL").isEmpty():
            return state
    raise RuntimeError("undecided rows are left")


def cross_chunk_duplicates(chunks: DataFrame, k: int = 8, least: int = 20, percent: int = 90) -> DataFrame:
    """Chunks (doc, id, text; ids in reading order) with at least ``least`` distinct k-grams, of which ``percent`` stand earlier in
    another document: (id, n, earlier). One pass: every earlier chunk owns its grams."""
    grams = chunks.select("doc", "id", F.explode(F.array_distinct(T.ngrams(T.words(F.col("text")), k))).alias("g"))
    first = grams.groupBy("g").agg(F.min_by("doc", "id").alias("owner"))
    counted = grams.join(first, "g").groupBy("id").agg(F.count("*").alias("n"), F.sum((F.col("owner") != F.col("doc")).cast("long")).alias("earlier"))
    return counted.where((F.col("n") >= least) & (100 * F.col("earlier") >= percent * F.col("n")))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order, unlike ``dropDuplicates``, which keeps any."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
