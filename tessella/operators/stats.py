"""Statistics over result tables: resampling, intervals, rank measures, percentiles of several definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.storage import staged

#: Items of a bootstrap at most that are sent to every executor, 8 bytes each.
BROADCAST_ITEMS = 8_000_000
#: Picks of a bootstrap that a task forms, about.
PICKS_EACH = 4_000_000


def median_upper(values: Column) -> Column:
    """The upper of the two middle values, for an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def percentile_floor(values: Column, p: float) -> Column:
    """``xs[min(n - 1, int(p n))]`` of an array."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), (F.least(n - 1, F.floor(n * p)) + 1).cast("int"))


def percentile_low(values: Column, p: float) -> Column:
    """``xs[int(p (n - 1))]`` of an array."""
    return F.element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * p) + 1).cast("int"))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of a share k of n; (0, 0) for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / F.nullif(n, F.lit(0))
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.coalesce(F.round(mid - half, 6), F.lit(0.0)).alias("low"), F.coalesce(F.round(mid + half, 6), F.lit(0.0)).alias("high"))


def auroc(rows: DataFrame, score: str, label: str, by: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties one half, from counts of each score: (positives, negatives, auroc).

    Rows are first added up by score, so the running sums are over distinct scores; ``by`` gives one row for each of its values.
    """
    keys = [by] if by else []
    c = rows.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    a = c.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"))
    return a.select(*keys, "positives", "negatives", F.round(F.try_divide(F.col("u"), F.col("positives") * F.col("negatives")), 6).alias("auroc"))


def ordinal_correlation(rows: DataFrame, x: str, y: str, order: str, *groups: str) -> DataFrame:
    """Correlation of ordinal ranks: ties are ranked by ``order``, not averaged. One row for each group."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*groups).orderBy(c, order))
    return rows.withColumns({"_x": rank(x), "_y": rank(y)}).groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.corr("_x", "_y"), 6).alias("rho"))


def bootstrap_index(draw: Column, slot: Column, n: Column) -> Column:
    """Which of n items a draw takes at a slot: from a hash, so that any engine gives the same draws."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), slot.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("long")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``i`` from 0 without gaps in the order of a column, nulls last. Rows are dealt by ranges of it and numbered within each, so no task gets all."""
    by = F.col(order).asc_nulls_last()
    ranged = staged(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return out.withColumn("i", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1).drop("_part", "_before")


def paired_bootstrap(items: DataFrame, draws: int) -> DataFrame:
    """(n, mean, low, high) of the paired differences of items (i from 0 without gaps, d): the 2.5th and 97.5th order statistics of the means of
    ``draws`` resamples. Picks are formed in the tasks by a hash and summed up there; the items go to them in blocks, 8 bytes each. More than
    ``BROADCAST_ITEMS`` are joined on the index instead, and all picks are shuffled."""
    spark = items.sparkSession
    n, mean = items.agg(F.count("*"), F.avg("d")).first()
    picks = spark.range(0, n * draws, 1, max(spark.sparkContext.defaultParallelism, n * draws // PICKS_EACH))
    each = F.lit(max(n, 1)).cast("long")
    draw = F.floor((F.col("id") - F.col("id") % each) / each)  # exact below 2^53 picks
    picks = picks.select(draw.alias("draw"), bootstrap_index(draw, F.col("id") % each, each).alias("i"))
    if n <= BROADCAST_ITEMS:
        row = F.array_sort(F.collect_list(F.struct("i", "d")))
        blocks = items.groupBy(F.shiftright("i", 12).alias("block")).agg(F.transform(row, lambda x: x["d"]).alias("ds"))
        picks = picks.withColumn("block", F.shiftright("i", 12)).join(F.broadcast(blocks), "block")
        picks = picks.select("draw", F.get("ds", F.col("i").bitwiseAND(F.lit(4095).cast("long")).cast("int")).alias("d"))
    else:
        picks = picks.join(items.select("i", "d").hint("merge"), "i")
    m = F.round("m", 9)
    means = picks.groupBy("draw").agg(F.avg("d").alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list(F.struct(m.isNull().alias("none"), m.alias("m")))).alias("ms"))  # one number a draw, nulls last
    low, high = int(draws * 0.025), int(draws * 0.975) - 1
    end = lambda at: F.round(F.get("ms", F.lit(at))["m"], 6)
    return ordered.select(F.lit(n).cast("long").alias("n"), F.round(F.lit(mean).cast("double"), 6).alias("mean"), end(low).alias("low"), end(high).alias("high"))


def ratio_bootstrap(groups: DataFrame, draws: int) -> DataFrame:
    """Like ``paired_bootstrap`` for a ratio of sums: groups (i, num, den) are drawn whole."""
    n = groups.count()
    slots = groups.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    picked = slots.withColumn("i", bootstrap_index(F.col("draw"), F.col("slot"), F.lit(n)))
    ratios = picked.join(groups, "i").groupBy("draw").agg((F.sum("num") / F.sum("den")).alias("m"))
    low, high = int(draws * 0.025), int(draws * 0.975) - 1
    ms = ratios.agg(F.array_sort(F.collect_list(F.round("m", 9))).alias("ms"))
    return ms.select(F.round(F.element_at("ms", low + 1), 6).alias("low"), F.round(F.element_at("ms", high + 1), 6).alias("high"))


def noise_floor(a: Column, b: Column, p: Column, n: Column) -> Column:
    """The larger of the gap between two seeds and the binomial standard error."""
    return F.round(F.greatest(F.abs(a - b), F.sqrt(p * (1 - p) / n)), 6)


def moving_average(rows: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """Trailing mean of ``k`` rows; the first rows average what there is."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(k - 1), 0)
    return rows.withColumn("average", F.round(F.avg(value).over(w), 6))


def runs_since_reset(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """``streak``: how many rows in a row, up to this one, fulfil ``hit``."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    rows = rows.withColumn("_island", F.sum(1 - F.col("_hit")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("streak", F.sum("_hit").over(Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("_hit", "_island")


def flat_best(rows: DataFrame, key: str, order: str, value: str, patience: int = 2) -> DataFrame:
    """``since_best``: rows since the running best, and ``stop``: at least ``patience`` of them. The first of equal bests counts."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = rows.withColumn("_n", n).withColumn("_at", F.max_by(F.col("_n"), F.struct(F.col(value), -F.col("_n"))).over(w))
    return rows.withColumn("since_best", (F.col("_n") - F.col("_at")).cast("long")).withColumn("stop", F.col("since_best") >= patience).drop("_n", "_at")
