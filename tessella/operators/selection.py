"""Splits, quotas, caps, orders and packing. Every choice is by a stable hash or a stated order, never by a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def hash_order(*parts: Column) -> Column:
    """A fixed shuffle: the SHA-256 of a key as hex, which sorts like its number."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def top_by_hash(rows: DataFrame, key: str, n: int, *strata: str) -> DataFrame:
    """The ``n`` rows of each stratum with the smallest hashes of ``key``; a larger pool never drops a row for one with a larger hash."""
    w = Window.partitionBy(*strata).orderBy(hash_order(F.col(key).cast("string")), key)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stratified_split(docs: DataFrame, ident: str, stratum: str, share: float = 0.05, pinned: DataFrame | None = None) -> DataFrame:
    """Add ``split``: in each stratum max(1, round-half-even(share of all its rows)) rows go to ``val``, smallest hash first; the rest, and all
    ``pinned`` ids, to ``train``."""
    rows = docs.withColumn("_pin", F.lit(False))
    if pinned is not None:
        marks = pinned.select(F.col(ident).alias("_p")).distinct()
        rows = docs.join(marks, F.col(ident) == F.col("_p"), "left").withColumn("_pin", F.col("_p").isNotNull()).drop("_p")
    n = F.count("*").over(Window.partitionBy(stratum))
    rank = F.row_number().over(Window.partitionBy(stratum, "_pin").orderBy(hash_order(F.col(ident).cast("string")), ident))
    want = F.greatest(F.lit(1), F.bround(n * share, 0))
    rows = rows.withColumns({"_n": want, "_rank": rank})
    return rows.withColumn("split", F.when(~F.col("_pin") & (F.col("_rank") <= F.col("_n")), "val").otherwise("train")).drop("_n", "_rank", "_pin")


def take_groups(groups: DataFrame, size: str, want: Column, order: list[Column], *strata: str) -> DataFrame:
    """Whole groups in order until their sizes reach ``want``; the one that crosses is taken."""
    w = Window.partitionBy(*strata).orderBy(*order).rowsBetween(*UP_TO_HERE)
    return groups.withColumn("_cum", F.sum(size).over(w)).where(F.col("_cum") - F.col(size) < want).drop("_cum")


def quotas(weights: DataFrame, n: int, tie: list[Column]) -> DataFrame:
    """Largest-remainder apportionment: add ``quota`` to rows with ``weight``; equal remainders by ``tie``."""
    all_ = Window.partitionBy(F.lit(0))
    exact = F.lit(n) * F.col("weight") / F.sum("weight").over(all_)
    w = weights.withColumn("_x", exact).withColumn("_f", F.floor("_x"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("_x") - F.col("_f"), 9).desc(), *tie))
    left = F.lit(n) - F.sum("_f").over(all_)
    return w.withColumn("quota", (F.col("_f") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_x", "_f")


def round_robin(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first row of each group in group order, then the second, until ``n``."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", group).limit(n)


def interleave(rows: DataFrame, half: str, order: list[Column]) -> DataFrame:
    """``place``: rows of the two halves in turn, then the longer rest."""
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(half).orderBy(*order)))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_rn", half))).drop("_rn")


def capped(rows: DataFrame, group: str, cap: int | Column, order: list[Column], exempt: Column | None = None) -> DataFrame:
    """At most ``cap`` rows of each group in order; exempt rows pass and don't count."""
    free = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    rows = rows.withColumn("_free", free)
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_free").orderBy(*order)))
    return rows.where(F.col("_free") | (F.col("_rn") <= cap)).drop("_free", "_rn")


def budgeted(rows: DataFrame, group: str, order: list[str], cost: str, budget: int, columns: list[str]) -> DataFrame:
    """Rows in order while their costs fit the group's budget; a row that does not fit is skipped and later ones may still fit.

    What is accepted depends on what was accepted before, so each group is folded: an ``aggregate`` over its rows in order, inside the JVM. A group is
    gathered as (order, cost, id) structs, without its wide columns, and joined back.
    """
    first = columns[0]
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(cost).alias("_cost"), F.col(first).alias("_id")))).alias("xs"))
    none = F.array().cast(rows.select(F.array(first)).schema[0].dataType)
    start = F.struct(F.lit(0).cast("long").alias("used"), none.alias("ids"))
    fold = F.aggregate(
        "xs",
        start,
        lambda s, x: F.when(s["used"] + x["_cost"] <= budget, F.struct((s["used"] + x["_cost"]).cast("long").alias("used"), F.concat(s["ids"], F.array(x["_id"])).alias("ids"))).otherwise(s),
    )
    taken = g.select(F.explode(fold["ids"]).alias("_id"))
    return rows.join(taken, F.col(first) == F.col("_id"), "left_semi").select(*columns)


def prefix_sums(rows: DataFrame, order: str, size: str, parts: int = 64) -> DataFrame:
    """Add ``before``: the sum of ``size`` over all rows with a smaller ``order`` (a number). Two levels instead of one unpartitioned window: ranges of the order
    are summed, the few range sums are added up, and rows are summed within their range."""
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return rows.withColumn("before", F.lit(0).cast("long"))
    width = max(1, -(-(hi - lo + 1) // parts))
    cut = rows.withColumn("_part", F.floor((F.col(order) - F.lit(lo)) / width).cast("int"))
    sums = cut.groupBy("_part").agg(F.sum(size).alias("_s"))
    ahead = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range: at most ``parts``.
    return cut.withColumn("_own", own).join(F.broadcast(ahead), F.col("_part") == F.col("_p")).withColumn("before", (F.col("_ahead") + F.col("_own")).cast("long")).drop("_part", "_p", "_ahead", "_own")


def prefix_take(rows: DataFrame, order: str, size: str, target: int) -> DataFrame:
    """Rows in order until their sizes reach ``target``; the crossing row is included."""
    return prefix_sums(rows, order, size).where(F.col("before") < target)


def packed_windows(docs: DataFrame, order: str, n_tokens: str, length: int, separators: int = 2) -> DataFrame:
    """(window, doc, tokens): how many tokens of each document lie in each full window of ``length`` over all documents laid end to end, each with
    ``separators`` more tokens. The last partial window is dropped. Positions are arithmetic; tokens are never materialised."""
    sized = docs.withColumn("_n", (F.col(n_tokens) + separators).cast("long"))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    rows = prefix_sums(sized, order, "_n")
    w = rows.withColumn("window", F.explode(F.sequence(F.floor(F.col("before") / length), F.floor((F.col("before") + F.col("_n") - 1) / length))))
    tokens = F.least(F.col("before") + F.col("_n"), (F.col("window") + 1) * length) - F.greatest("before", F.col("window") * length)
    return w.where(F.col("window") < total // length).select("window", F.col(order).alias("doc"), tokens.cast("long").alias("tokens"))


def greedy_chunks(docs: DataFrame, ident: str, text: str, most: int) -> DataFrame:
    """(id, chunk, words, text): sentences gathered until the next would exceed ``most`` words; a longer sentence is cut into runs of ``most`` words.
    The state of the cut points is folded along each document by ``aggregate`` in the JVM."""
    pieces = F.flatten(
        F.transform(
            T.sentences(F.col(text)),
            lambda s: T.let(T.tokens(s), lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / most)), lambda i: F.array_join(F.slice(w, (i * most + 1).cast("int"), most), " "))),
        )
    )
    pieces = F.filter(pieces, lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        k = F.size(T.tokens(p))
        full = (s["n"] > 0) & (s["n"] + k > most)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full | (s["n"] == 0), p).otherwise(F.concat_ws(" ", s["now"], p)).alias("now"), F.when(full, k).otherwise(s["n"] + k).alias("n"))

    folded = F.aggregate(pieces, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
    out = docs.select(F.col(ident).alias("id"), F.posexplode(folded).alias("chunk", "text"))
    return out.select("id", "chunk", F.size(T.tokens(F.col("text"))).alias("words"), "text")


def evenly_spaced(n: int, k: int) -> Column:
    """Array of ``k`` places of 0 to n - 1, first and last included, rounded half-even, distinct."""
    k = min(n, k)
    if k <= 1:
        return F.array(*[F.lit(0).cast("long")] * k)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * F.lit(float(n - 1)) / (k - 1)).cast("long")))


def capped_take(rows: DataFrame, ident: str, group: str, cap: int, n: int) -> DataFrame:
    """``n`` rows in hash order of which no group has more than ``cap``."""
    order = [hash_order(F.col(ident).cast("string")), F.col(ident)]
    return capped(rows, group, cap, order).orderBy(*order).limit(n)


def priority_take(rows: DataFrame, ident: str, first: Column, n: int) -> DataFrame:
    """``n`` rows: those for which ``first`` holds before the others, each kind in hash order."""
    return rows.orderBy(F.coalesce(first, F.lit(False)).desc(), hash_order(F.col(ident).cast("string")), F.col(ident)).limit(n)
