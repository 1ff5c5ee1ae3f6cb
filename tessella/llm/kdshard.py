"""K-d tree partitioning of rows into shards of near-equal bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import session_of, staged

#: Bins of one histogram pass; what a pass sends to the driver is at most this many rows a node.
BINS = 1024
#: Ties of a dimension are cut by copy group, then by row, then by the row's place in the staged table.
TIES = ("_t1", "_t2", "_t3")
RANGE = float(1 << 53)
#: Rows that one task numbers.
SLOT_ROWS = 100_000


@dataclass
class Node:
    leaves: int
    first: int
    box: list[tuple[float, float]]
    number: int = 0
    dim: int = 0
    cut: tuple[float, ...] | None = None
    children: list[Node] = field(default_factory=list)


def common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that all strings between the smallest and the largest share."""
    a, b = (low or "").encode("utf-8", "surrogatepass"), (high or "").encode("utf-8", "surrogatepass")
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def text_code(c: Column, skip: int = 0) -> Column:
    """A number that grows with the code point order of a string's six bytes after the first ``skip``, which all share; -1 for null."""
    first = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, 6)), 12, "0")
    return F.when(c.isNull(), F.lit(-1.0)).otherwise(F.conv(first, 16, 10).cast("double"))


def _unit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11).cast("double")


def kd_shards(
    rows: DataFrame, shards: int, weight: str, dims: dict[str, Column], copies: Column, ident: Column, tolerance: float = 0.002
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard) to ``rows``.

    A node that must hold k leaves is split at the weighted quantile that gives its children the bytes of k // 2 and k - k // 2
    leaves (the weighted median where k is even), along the dimension in which its box is widest against the whole. The quantiles
    of all nodes of a level are found together by histograms that are summed where the rows lie: a pass brings at most
    ``BINS`` sums a node to the driver, and the bin that holds the cut is refined until it is within ``tolerance`` of a
    leaf's bytes or holds one value. Rows that are equal in the dimension are ordered by ``copies`` (equal texts stay
    side by side, so a group is cut only where a leaf must end), then by ``ident``, then by their place in the staged table, so
    a group of any size can be split. No row moves until the last step, which numbers the slots.

    ``rows`` should be narrow: it is written once to the shared folder and read in each pass. Null weights count as 0, null
    dimensions come first. With no rows there are no rows; with fewer rows than shards, some shards stay empty. Extra columns are
    kept; names that begin with ``_d`` or ``_t`` are reserved.
    """
    names = [f"_d{i}" for i in range(len(dims))]
    table = rows.withColumns(
        {n: F.coalesce(c.cast("double"), F.lit(-1.0)) for n, c in zip(names, dims.values(), strict=True)}
        | {"_t1": _unit(F.xxhash64(copies)), "_t2": _unit(F.xxhash64(ident, copies)), "_t3": _unit(F.xxhash64(F.monotonically_increasing_id())), "_w": F.coalesce(F.col(weight), F.lit(0)).cast("long")}
    )
    table = staged(table, "kd")
    spark = session_of(rows)
    bounds = table.agg(F.sum("_w"), F.count("*"), *[f(n) for n in names for f in (F.min, F.max)]).first()
    total = bounds[0] or 0
    whole = [(bounds[2 + 2 * i], bounds[3 + 2 * i]) for i in range(len(names))]
    if total == 0:
        whole = [(0.0, 0.0) for _ in names]
    root = Node(shards, 0, whole)
    level, leaves_bytes = [root], total / shards
    keyed = table.withColumn("_node", F.lit(0))
    while any(n.leaves > 1 for n in level):
        open_ = [n for n in level if n.leaves > 1]
        for n in open_:
            span = [(hi - lo) / (whole[i][1] - whole[i][0] or 1) for i, (lo, hi) in enumerate(n.box)]
            n.dim = max(range(len(span)), key=lambda i: (span[i], -i))
        _cuts(spark, keyed, open_, names, leaves_bytes * tolerance)
        below: list[Node] = []
        for n in level:
            if n.leaves == 1:
                n.children = [Node(1, n.first, n.box)]
            else:
                left, (lo, hi) = n.leaves // 2, n.box[n.dim]
                at = min(max(n.cut[0], lo), hi)
                boxes = [[*n.box], [*n.box]]
                boxes[0][n.dim], boxes[1][n.dim] = (lo, at), (at, hi)
                n.children = [Node(left, n.first, boxes[0]), Node(n.leaves - left, n.first + left, boxes[1])]
            for c in n.children:
                c.number = len(below)
                below.append(c)
        keyed = keyed.withColumn("_node", _step(level, names))
        level = below
    first = F.lit([n.first for n in level])
    keyed = keyed.withColumn("shard", F.element_at(first, F.col("_node") + 1)).drop("_node", *names, "_w")
    return _slots(keyed, max(64, -(-bounds[1] // (shards * SLOT_ROWS)))).drop(*TIES)


def _step(level: list[Node], names: list[str]) -> Column:
    """The child's number for a row of each node."""
    at = F.col("_node") + 1
    pick = lambda values: F.element_at(F.lit(values), at)
    cuts = [n.cut or (0.0,) * 4 for n in level]
    value = F.element_at(F.array(*names), pick([n.dim + 1 for n in level]))
    less = F.struct(value.alias("a"), *TIES) < F.struct(*[pick([c[k] for c in cuts]).alias(x) for k, x in enumerate(("a", *TIES))])
    left = pick([n.children[0].number for n in level])
    right = pick([n.children[-1].number for n in level])
    return F.when(less, left).otherwise(right)


def _cuts(spark, keyed: DataFrame, nodes: list[Node], names: list[str], slack: float) -> None:
    """Find the cut of each node: the first key, as (value, three ties), that belongs to the right child."""
    infinite = float("inf")
    state = {n.number: {"node": n, "phase": 0, "eq": [], "lo": n.box[n.dim][0], "hi": n.box[n.dim][1], "left": 0.0, "goal": None} for n in nodes}
    while state:
        params = spark.createDataFrame(
            [(k, s["node"].dim + 1, s["phase"], float(s["lo"]), float(max(s["hi"] - s["lo"], 1e-300)), *[float(s["eq"][j]) if j < len(s["eq"]) else None for j in range(3)]) for k, s in state.items()],
            "_n int, _dim int, _phase int, _lo double, _span double, _e0 double, _e1 double, _e2 double",
        )
        value = F.element_at(F.array(*names), F.col("_dim"))
        keys = F.array(value, *TIES)
        inside = F.lit(True)
        for j in range(3):
            inside = inside & (F.col(f"_e{j}").isNull() | (F.element_at(keys, j + 1) == F.col(f"_e{j}")))
        x = F.element_at(keys, F.col("_phase") + 1)
        b = ((F.col("_x") - F.col("_lo")) / F.col("_span") * BINS).cast("double")
        found = keyed.join(F.broadcast(params), F.col("_node") == F.col("_n")).where(inside).withColumn("_x", x)
        # Rows below or above the range that is being refined fall into bins -1 and BINS + 1.
        found = found.withColumn("_b", F.when(b < 0, -1).when(b > BINS, BINS + 1).otherwise(F.floor(b)).cast("int"))
        sums = found.groupBy("_n", "_b").agg(F.sum("_w"), F.count("*"), F.min("_x"), F.max("_x")).collect()
        per: dict[int, list] = {}
        for r in sums:
            per.setdefault(r[0], []).append(tuple(r)[1:])
        for k in list(state):
            s, bins = state[k], sorted(per.get(k, []))
            n = s["node"]
            mass = sum(x[1] for x in bins)
            if s["goal"] is None:
                s["goal"] = mass * (n.leaves // 2) / n.leaves
            pad = (-infinite,) * 4
            if not bins:
                n.cut = (*s["eq"], *pad)[:4]
                del state[k]
                continue
            run = s["left"]
            for i, (_, w, rows, low, high) in enumerate(bins):
                if run + w >= s["goal"] or i == len(bins) - 1:
                    break
                run += w
            before, after = s["goal"] - run, run + w - s["goal"]
            last = rows == 1 or (low == high and s["phase"] == 3)
            if before <= slack or after <= slack or last:
                if before <= after:
                    n.cut = (*s["eq"], low, *pad)[:4]
                elif i + 1 < len(bins):
                    n.cut = (*s["eq"], bins[i + 1][3], *pad)[:4]
                else:  # the right child begins after all rows of this range
                    n.cut = (*s["eq"], high, *((infinite,) * 4))[:4]
                del state[k]
            elif low == high:
                s |= {"phase": s["phase"] + 1, "eq": [*s["eq"], low], "left": run, "lo": 0.0, "hi": RANGE}
            else:
                # Ranges below count again in bin -1 of the next pass, so what lies left is summed from the start of the phase.
                s |= {"lo": low, "hi": high}
    for n in nodes:
        n.cut = tuple(float(x) for x in n.cut)


def _slots(df: DataFrame, ways: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps; a shard is numbered in ``ways`` parts side by side, by hashes of the rows: the order
    does not depend on files, and rows that change places are equal in all that it knows."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(*TIES[:2]), F.lit(ways)).cast("int"))
    parts = df.groupBy("shard", "_part").agg(F.count("*").alias("_n"))  # at most shards x ways rows
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_part").orderBy(*TIES)
    df = df.withColumn("_row", F.row_number().over(own))
    df = df.join(F.broadcast(parts), (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return df.withColumn("slot", (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_part", "_s", "_p", "_before", "_row")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) for every document.

    Size is the UTF-8 bytes of the text (null: none) plus 16; shards get near-equal sizes. The dimensions of the tree are
    doc_id, size, language and source (by six bytes after what all names share). text_crc32 of a null text is that of an empty one. Null ids and
    repeated rows are sharded as rows of their own. Reruns agree, but for rows that are equal in text and id.
    """
    text = F.col("text")
    ends = docs.agg(*[f(c) for c in ("lang", "source") for f in (F.min, F.max)]).first()
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_code(F.col("lang"), common_prefix(ends[0], ends[1])).alias("_lang"),
        text_code(F.col("source"), common_prefix(ends[2], ends[3])).alias("_source"),
    )
    dims = {"id": F.col("doc_id"), "size": F.col("size"), "lang": F.col("_lang"), "source": F.col("_source")}
    out = kd_shards(narrow, shards, "size", dims, F.struct("text_crc32", "size"), F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
