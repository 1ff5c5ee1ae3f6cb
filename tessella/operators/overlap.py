"""N-gram overlap between texts: look-up, coverage, longest runs, leave-one-out, bins and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.storage import staged

#: Different n-grams at most that are sent to every executor, 8 bytes each; beyond that both sides are shuffled.
BROADCAST_GRAMS = 4_000_000


def hashed_grams(text: Column, n: int) -> Column:
    """The n-grams of a text's words as 64-bit hashes, each of the hashes of its words: what is shuffled and joined is 8 bytes a gram, and no gram is put
    together as a string."""

    def grams(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (n - 1))
        return F.when(F.size(h) >= n, F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    return T.let(F.transform(T.words(text), lambda w: F.xxhash64(w)), grams)


def positioned_grams(rows: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """(id, pos, g): every n-gram of words, hashed, with its place, repeats included."""
    return rows.select(F.col(ident).alias("id"), F.posexplode(hashed_grams(F.col(text), n)).alias("pos", "g"))


def gram_index(rows: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """(g, docs): in how many texts each n-gram stands."""
    return positioned_grams(rows, ident, text, n).select("id", "g").distinct().groupBy("g").agg(F.count("*").alias("docs"))


def among(grams: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of ``grams`` whose g stands in ``reference``. The different grams of ``reference`` are counted first: few are broadcast, so the
    other side, however large, isn't shuffled."""
    few = staged(reference.select("g").distinct(), "reference-grams")
    return grams.join(F.broadcast(few) if few.count() <= BROADCAST_GRAMS else few, "g", "left_semi")


def covered_tokens(rows: DataFrame, reference: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """(id, tokens, grams, hits, covered, longest): how far n-grams that also stand in ``reference`` (g) cover each text.

    A word is covered if a hit n-gram includes it; longest is the longest covered stretch. Hits become intervals of words; intervals
    that touch are merged by a running maximum of their ends, so nothing is exploded to words. Texts shorter than n have no grams and no cover.
    """
    base = rows.select(F.col(ident).alias("id"), F.size(T.words(F.col(text))).alias("tokens"))
    grams = positioned_grams(rows, ident, text, n)
    hits = among(grams, reference).select("id", "pos")
    order = Window.partitionBy("id").orderBy("pos")
    fresh = F.coalesce((F.col("pos") > F.lag("pos").over(order) + n).cast("int"), F.lit(1))
    runs = hits.withColumn("run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "run").agg(F.count("*").alias("hits"), (F.max("pos") + n - F.min("pos")).alias("size"))
    per = runs.groupBy("id").agg(F.sum("hits").alias("hits"), F.sum("size").alias("covered"), F.max("size").alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = base.join(per, "id", "left")
    return out.select("id", F.col("tokens").cast("long").alias("tokens"), F.greatest(F.lit(0), F.col("tokens") - (n - 1)).cast("long").alias("grams"), zero("hits"), zero("covered"), zero("longest"))


def coverage_bin(share: Column) -> Column:
    """[0, .01), [.01, .05), [.05, .2), [.2, 1]; the last is closed."""
    return F.when(share < 0.01, "0-1%").when(share < 0.05, "1-5%").when(share < 0.2, "5-20%").otherwise("20-100%")


def shared_elsewhere(rows: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """(id, share): the share of a text's n-grams, repeats counted, that another text has too. Grams are shuffled once, by themselves: both
    counts and their join stay in that partitioning; what goes on to the ids is summed up first."""
    grams = positioned_grams(rows, ident, text, n).select("id", "g").repartition("g")
    per = grams.groupBy("g", "id").agg(F.count("*").alias("c"))
    both = per.join(per.groupBy("g").agg(F.count("*").alias("docs")), "g")
    sums = both.groupBy("id").agg(F.sum(F.when(F.col("docs") > 1, F.col("c")).otherwise(0)).alias("shared"), F.sum("c").alias("all"))
    return sums.select("id", (F.col("shared") / F.col("all")).alias("share"))


def shared_gram_counts(queries: DataFrame, reference: DataFrame, q_id: str, r_id: str, text: str, n: int) -> DataFrame:
    """(q, r, common, nq): distinct n-grams that a query text shares with each reference text, and how many it has."""
    q = queries.select(F.col(q_id).alias("q"), F.explode(F.array_distinct(hashed_grams(F.col(text), n))).alias("g"))
    r = reference.select(F.col(r_id).alias("r"), F.explode(F.array_distinct(hashed_grams(F.col(text), n))).alias("g"))
    sizes = q.groupBy("q").agg(F.count("*").alias("nq"))
    return q.join(r, "g").groupBy("q", "r").agg(F.count("*").alias("common")).join(sizes, "q")


def copied_from(questions: DataFrame, held: DataFrame, n: int = 4) -> DataFrame:
    """(q, r): the first held-out question (least r) that shares more than half of its own distinct n-grams with question q; if either has fewer words, whole
    word lists are compared. Both: (id, text). Two equi-joins, on grams and on whole word lists, instead of a comparison of all pairs."""
    grams = lambda d, name: d.select(F.col("id").alias(name), F.array_distinct(T.ngrams(T.words(F.col("text")), n)).alias("gs"))
    q, r = grams(questions, "q"), grams(held, "r").withColumn("nr", F.size("gs"))
    long_ = q.select("q", F.explode("gs").alias("g")).join(r.select("r", "nr", F.explode("gs").alias("g")), "g")
    long_ = long_.groupBy("q", "r", "nr").agg(F.count("*").alias("c")).where(2 * F.col("c") > F.col("nr")).select("q", "r")
    whole = lambda d, name: d.select(F.col("id").alias(name), F.array_join(T.words(F.col("text")), " ").alias("w"), (F.size(T.words(F.col("text"))) < n).alias(f"s{name}"))
    short = whole(questions, "q").join(whole(held, "r"), "w").where("(sq OR sr) AND w <> ''").select("q", "r")
    return long_.unionByName(short).groupBy("q").agg(F.min("r").alias("r"))


def buffer_guard(chunks: DataFrame, unseen: DataFrame, reserved: DataFrame, near: int = 1) -> DataFrame:
    """(chunk_id, allowed, why): chunks (chunk_id, doc, page) that may be used. ``unseen``: (doc, page) of held-out sources; ``reserved``: chunk_id.

    The first reason against a chunk: reserved, unseen_hash (its key's coin), buffer (within ``near`` pages of a held-out source). Pages around
    a source are listed on the small side, so the guard is an equi-join.
    """
    around = unseen.select(F.col("doc").alias("_d"), F.explode(F.sequence(F.col("page") - near, F.col("page") + near)).alias("_p")).distinct().withColumn("near", F.lit(True))
    out = chunks.join(around, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")), "left")
    out = out.join(reserved.select(F.col("chunk_id").alias("_c")).distinct().withColumn("held", F.lit(True)), F.col("chunk_id") == F.col("_c"), "left")
    why = F.when(F.col("held"), "eval_chunk").when(~T.even_byte(F.col("chunk_id")), "unseen_hash").when(F.col("near"), "buffer")
    return out.select("chunk_id", why.isNull().alias("allowed"), why.alias("why"))
