"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, staged

#: Rows that one bucket of keys should hold; the share of one task in a source of any size.
BUCKET_ROWS = 20_000


def quality_weight(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: texts with many words of ordinary length weigh most. Null and empty texts weigh 0."""
    mean = F.try_divide(F.length(text), size)
    return F.coalesce(size / (size + 20) * F.exp(-F.abs(mean - 6) / 6), F.lit(0.0))


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """The target of each source: its weight's share of all sizes, at most ``cap`` times its own size.

    ``sources``: source, size; one row a source. What is cut off at a cap is shared by weight among the others until none is
    above, which is one water level: with sources in order of cap over weight, those before the first that the level does not
    reach stop at their caps, the others get weight times level. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    s = sources.withColumn("_i", n)
    s = s.withColumn("_weight", F.element_at(F.lit([float(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(float(cap)) * F.col("size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_i")
    before, all_ = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    free = F.sum("size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("_weight").over(all_) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", free / left)
    s = s.withColumn("_above", F.col("_weight") * F.col("_level") >= F.col("_cap"))
    s = s.withColumn("_place", F.row_number().over(by_ratio))
    s = s.withColumn("_water", F.min(F.when(~F.col("_above"), F.struct("_place", "_level"))).over(all_)["_level"])
    target = F.when(F.col("_above") | F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_water")))
    return s.select("source", F.col("size").alias("source_size"), target.cast("double").alias("target"))


def _narrow(docs: DataFrame, seed: int, quality: Column | None) -> DataFrame:
    """Add ``_size``, and ``_key``: -ln(u) / weight, where u comes from a hash of the id, the text and ``seed``."""
    text = F.col("text")
    rows = docs.withColumn("_size", n_words(text))
    q = F.coalesce(quality if quality is not None else quality_weight(text, F.col("_size")), F.lit(0.0))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return rows.withColumn("_key", -F.ln(u) / F.greatest(q, F.lit(1e-9)))


def _few(table: DataFrame, most: int = 20_000) -> DataFrame:
    """Send a table with one row a source to every executor if it is small, counted first; else leave the join to AQE."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


#: Bins of keys to an octave: a key's hump, whatever its scale, fills some hundred of them.
OCTAVE = 64


def _ends(sums: DataFrame, by: str, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the rest of each source ends among sums in the order of ``by``.

    ``sums``: source, ``by``, w (size), n (rows), most (largest key); ``rest``: _s, _rest (what is left to take). Returns (_s, _c, _n, _rest) of the
    one lot a source in which it ends, _rest being what is left when the lot begins, and (source, cut) of the lots that are taken whole.
    """
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("w").over(upto)).join(rest, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("_rest") > 0)
    begin = F.col("_upto") - F.col("w")
    ends = sums.where((F.col("_upto") > F.col("_rest")) & (begin < F.col("_rest")))
    whole = sums.where(F.col("_upto") <= F.col("_rest")).groupBy("source").agg(F.max("most").alias("cut"))
    return ends.select("_s", F.col(by).alias("_c"), F.col("n").alias("_n"), (F.col("_rest") - begin).alias("_rest")), whole


def _sums(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy("source", by).agg(F.sum("_size").alias("w"), F.count("*").alias("n"), F.max("_key").alias("most"))


def mix_plan(rows: DataFrame, weights: Sequence[float], cap: float, bucket_rows: int) -> DataFrame:
    """One row a source: source, source_size, target, epochs, and cut, the largest key that is taken once more (or null).

    ``rows``: source, _size, _key, read several times. No source is ever sorted as a whole: keys are dealt into bins of equal width on a log
    scale, so that weights of any scale spread alike; the bin in which the rest ends is dealt into buckets of about ``bucket_rows`` rows; and of the bucket in which
    it ends the different keys are sorted. Sums of bins and buckets are prefix-summed within the source. Equal rows, of any number, have one key.
    """
    per = staged(rows.groupBy("source").agg(F.sum("_size").alias("size")), "mix-sources")
    sources = per.count()
    plan = targets(per, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = staged(plan.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "mix-targets", sources)
    rest = plan.select(F.col("source").alias("_s"), "_rest")
    place = F.log2(F.greatest(F.col("_key"), F.lit(1e-300))) * OCTAVE
    binned = rows.withColumn("_b", F.floor(place))
    ends, whole = _ends(_sums(binned, "_b"), "_b", rest)
    ends = _few(staged(ends, "mix-ends", sources))
    at_end = binned.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    buckets = F.ceil(F.col("_n") / bucket_rows)
    at_end = at_end.select("source", "_size", "_key", F.least(buckets - 1, F.floor((place - F.col("_b")) * buckets)).cast("long").alias("_d"))
    inner, more = _ends(_sums(at_end, "_d"), "_d", ends.select("_s", "_rest"))
    last = at_end.join(_few(inner), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_d") == F.col("_c")))
    last = last.groupBy("source", "_key").agg(F.sum("_size").alias("_own"), F.first("_rest").alias("_rest"))
    last = last.withColumn("_through", F.sum("_own").over(Window.partitionBy("source").orderBy("_key")))
    over, under = F.col("_through") - F.col("_rest"), F.col("_rest") - (F.col("_through") - F.col("_own"))
    taken = last.where((over <= 0) | ((under > 0) & (over < under))).groupBy("source").agg(F.max("_key").alias("cut"))
    cuts = taken.unionByName(whole).unionByName(more).groupBy("source").agg(F.max("cut").alias("cut")).withColumnRenamed("source", "_s")
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    return staged(plan.select("source", "source_size", "target", "epochs", "cut"), "mix-plan", sources)


def _copies() -> Column:
    return F.col("epochs") + F.when(F.col("_key") <= F.col("cut"), 1).otherwise(0)


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 11, bucket_rows: int = BUCKET_ROWS, quality: Column | None = None
) -> DataFrame:
    """How many times each document is taken: doc_id, source, size, source_size, target, copies, taken.

    Sizes are words. A source with target T and size S is repeated T // S times whole; what is left of T is filled by a weighted
    random order without replacement: each document has the key -ln(u) / weight, with u from a hash of its id, text and
    ``seed``, and the documents with the smallest keys are taken until their sizes reach the remainder (the document at the end
    is taken if that comes nearer). The weight is the quality of the document; 0 or null puts it last.

    A source may hold any share of the rows (see ``mix_plan``). Sizes and keys are computed once and written, without the texts, to
    the shared folder; what a document gets depends on its own key and its source's row of the plan. Reruns agree. Equal rows
    have equal keys and counts. Null text: size 0, taken 0. A null source is a source of its own, last in order; empty tables give
    no rows. Columns of other names are not used.
    """
    rows = staged(_narrow(docs.select("doc_id", "source", "text"), seed, quality).select("doc_id", "source", "_size", "_key"), "mix")
    plan = _few(mix_plan(rows, weights, cap, bucket_rows).withColumnRenamed("source", "_s"))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", _copies().alias("copies"), (_copies() * F.col("_size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 11, bucket_rows: int = BUCKET_ROWS, quality: Column | None = None
) -> DataFrame:
    """The mixed documents: each row as often as ``mix`` takes it, with the columns of ``docs``, whatever their names. The texts are not shuffled:
    a row's key is computed where it lies and compared with its source's cut."""
    weight = [] if quality is None else [quality.alias("_q")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *weight)
    packed = packed.select("_row", "_row.doc_id", "_row.source", "_row.text", *["_q"] * len(weight))
    keyed = _narrow(packed, seed, F.col("_q") if weight else None)
    plan = mix_plan(staged(keyed.select("source", "_size", "_key"), "mix"), weights, cap, bucket_rows).select(F.col("source").alias("_s"), "epochs", "cut")
    out = keyed.join(_few(plan), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_copies", _copies().cast("int"))
    out = out.where(F.col("_copies") > 0).select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select("_row.*")
