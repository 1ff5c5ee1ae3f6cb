"""MinHash near-duplicates with tensored banding, exact confirmation and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import session_of, small_batches, staged, tidy
from .words import Vocabulary, mix64, shingles

#: Sub-keys of each of the two collections, and min-hashes of a sub-key. A table key is a pair of sub-keys, one of each
#: collection: SIDE * SIDE tables of 2 * ROWS min-hashes each, from 2 * SIDE * ROWS min-hashes instead of SIDE * SIDE * 2 * ROWS.
SIDE, ROWS = 16, 4
HASHES = 2 * SIDE * ROWS
#: Deviations below the expected number of equal min-hashes at which a pair is no longer confirmed on its full sets.
DEVIATIONS = 6.0

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def miss_probability(similarity: float) -> float:
    """How likely a pair of that similarity shares no table key: neither collection may lack an equal sub-key."""
    some = 1 - (1 - similarity**ROWS) ** SIDE
    return 1 - some * some


def signature(sets: np.ndarray) -> np.ndarray:
    """``HASHES`` min-hashes of a set of 64-bit hashes."""
    h = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        x = h[i : i + 1024, None] ^ _XOR
        x *= _MUL
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def sub_keys(sig: np.ndarray) -> np.ndarray:
    """The 2 * ``SIDE`` sub-keys of a signature, as signed 64-bit integers."""
    parts = sig.reshape(2 * SIDE, ROWS).astype(np.uint64)
    h = np.arange(1, 2 * SIDE + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return h.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (shingles), h1 and h2 (a 128-bit hash of the shingle set), sig (one byte of each min-hash), subs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            n, h1, h2, sig, subs = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(words_of(text), k, vocabulary)
                n.append(len(s))
                if not len(s):
                    for col in (h1, h2, sig, subs):
                        col.append(None)
                    continue
                d = blake2b(s.tobytes(), digest_size=16).digest()
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                m = signature(s)
                sig.append(m.astype(np.uint8).tobytes())
                subs.append(sub_keys(m))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip((n, h1, h2, sig, subs), kinds, strict=True))], ["doc_id", "n", "h1", "h2", "sig", "subs"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, sig binary, subs array<long>")


def _live_keys(classes: DataFrame) -> DataFrame:
    """(key, o1, o2, v, n, c) of the table keys that have more than one member; c is their number.

    A key is a pair of sub-keys, so it is shared only if both sub-keys are: classes whose sub-keys are all their own, which is most of a corpus,
    are out before any pair is formed. o1 and o2 are other sub-keys of the class, by which the members of a key are ordered: like texts agree on
    them too and stand side by side.
    """
    around = F.transform("subs", lambda s, i: F.struct(i.alias("t"), s.alias("s"), F.element_at("subs", (i + 1) % (2 * SIDE) + 1).alias("o")))
    subs = classes.select("v", "n", F.explode(around).alias("x")).select("v", "n", "x.*")
    shared = subs.groupBy("t", "s").agg(F.count("*").alias("c")).where("c > 1").select(F.col("t").alias("_t"), F.col("s").alias("_s"))
    live = subs.join(shared, (F.col("t") == F.col("_t")) & (F.col("s") == F.col("_s")), "left_semi")
    # At most 2 * SIDE sub-keys a class.
    side = lambda first: F.collect_list(F.when((F.col("t") < SIDE) == F.lit(first), F.struct("t", "s", "o")))
    per = live.groupBy("v", "n").agg(side(True).alias("a"), side(False).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    pairs = per.select("v", "n", F.explode("a").alias("a"), "b").select("v", "n", "a", F.explode("b").alias("b"))
    keys = staged(pairs.select(F.xxhash64("a.t", "a.s", "b.t", "b.s").alias("key"), F.col("a.o").alias("o1"), F.col("b.o").alias("o2"), "v", "n"), "near-pairs-of-subs")
    # Counts are combined before they move, and the join on a hot key is split where it is skewed.
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("_k"), "c")
    return keys.join(counts, F.col("key") == F.col("_k")).drop("_k")


#: Members of a key that one task orders; those of a larger key are dealt into lots.
LOT = 100_000


def _neighbours(keys: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each member of a key with the one before it, if their sizes allow the similarity. A hot key is dealt into lots
    of about ``LOT`` members, each ordered by itself, and the first of its lots are ordered in turn. At most two pairs a member, however large
    the key's group is; ``_unjoined`` compares what these leave apart."""
    keys = keys.withColumn("lot", F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / LOT)).cast("int"))

    def beside(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("m", F.lag(F.struct("v", "n")).over(Window.partitionBy(*by).orderBy("o1", "o2", "v")))

    near = beside(keys, "key", "lot")
    leaders = near.where((F.col("c") > LOT) & F.col("m").isNull()).select("key", "o1", "o2", "v", "n")
    pairs = near.select("v", "n", "m").unionByName(beside(leaders, "key").select("v", "n", "m")).where("m IS NOT NULL")
    sized = 100 * F.least(F.col("n"), F.col("m.n")) >= percent * F.greatest(F.col("n"), F.col("m.n"))
    return pairs.where(sized).select(F.least("v", "m.v").alias("a"), F.greatest("v", "m.v").alias("b")).distinct()


def _least_equal(similarity: float) -> int:
    """How many one-byte min-hashes of a pair of that similarity agree at least."""
    p = similarity + (1 - similarity) / 256
    return int(HASHES * p - DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5)


def _plausible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose one-byte min-hashes agree often enough; the others are far below the similarity."""
    least = _least_equal(similarity)
    sig = classes.select("v", "sig")
    both = pairs.join(sig.select(F.col("v").alias("a"), F.col("sig").alias("_sa")), "a").join(sig.select(F.col("v").alias("b"), F.col("sig").alias("_sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("_sa", "_sb"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    return both.select("a", "b", "_sa", "_sb").mapInArrow(tidy(run), "a long, b long")


#: Members of a key that meet in one block at most come from two parts of about this size.
KEY_BLOCK = 1024


def _deal(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """Deal the members (v, label) of each group into blocks (lo, hi), so that every two members of different labels meet in one.

    Groups with one label go. Of a large group the members of its commonest label need not meet each other: all others are dealt into parts, every
    two of which meet, and each of these meets every part of the commonest label. So a member is copied as often as the group has parts
    outside its commonest label, and a block holds two parts. ``part`` tells the members of a block apart; groups of one block have one part.
    """
    per = rows.groupBy(*by, "label").agg(F.count("*").alias("n"))
    group = [F.col(c).alias(f"_{c}") for c in by]
    per = per.groupBy(*by).agg(F.sum("n").alias("_all"), F.max(F.struct("n", "label")).alias("_most"), F.count("*").alias("_labels")).where("_labels > 1")
    per = per.select(*group, F.col("_most.label").alias("_major"), (F.col("_all") > block).alias("_large"), "_all", F.col("_most.n").alias("_m"))
    per = per.withColumn("_p", F.when(F.col("_large"), F.ceil((F.col("_all") - F.col("_m")) / block)).otherwise(1).cast("int"))
    per = per.withColumn("_q", F.when(F.col("_large"), F.ceil(F.col("_m") / block)).otherwise(0).cast("int"))
    match = [F.col(c) == F.col(f"_{c}") for c in by]
    on = match[0] if len(match) == 1 else match[0] & match[1]
    rows = rows.join(per, on)
    major = F.col("_large") & (F.col("label") == F.col("_major"))
    h = F.xxhash64("v")
    rows = rows.withColumn("part", F.when(major, F.col("_p") + F.pmod(h, F.col("_q"))).otherwise(F.pmod(h, F.col("_p"))).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(major, F.col("_p")).otherwise(F.col("_p") + F.col("_q")) - 1)))
    rows = rows.withColumns({"lo": F.least("part", "_o"), "hi": F.greatest("part", "_o")})
    return rows.drop(*[f"_{c}" for c in by], "_major", "_large", "_all", "_m", "_p", "_q", "_o")


def _unjoined(keys: DataFrame, clusters: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): plausible pairs among the members of a key that no cluster holds together yet, as many as join them.

    With these every two members of a key whose sizes and min-hashes allow the similarity end in one cluster. Keys whose members are all of one cluster
    need nothing. In each other key one cluster has the most members; the others are apart. Those apart meet that whole cluster, once however many
    keys they share with it, and they meet each other, key by key; keys with the same members apart count once. The members of a large key are dealt into
    overlapping bands of sizes, two of which hold any pair that the sizes allow, and all groups into bounded blocks. So a large group of near copies, which
    share all their keys, is listed once, not once a key, and the work grows with the number of those apart.
    """
    rows = keys.select("key", "v", "n", (F.col("c") > KEY_BLOCK).alias("_wide")).distinct().join(clusters, "v", "left").withColumn("label", F.coalesce("label", "v"))
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("l")).where("l > 1")
    most = most.select(F.col("key").alias("_k"), F.col("m.label").alias("major"))
    apart = rows.join(most, (F.col("key") == F.col("_k")) & (F.col("label") != F.col("major")))
    # A little wider than the ratio of sizes, so that rounding can't part two sizes by two bands.
    width = max(math.log(100 / percent), 1e-3) * (1 + 1e-6)
    band = F.floor(F.ln("n") / width).cast("int")
    bands = F.explode(F.when(F.col("_wide"), F.array(band, band + 1)).otherwise(F.array(F.lit(-1))))
    apart = staged(apart.select("key", bands.alias("band"), "v", "n", "label", "major"), "near-apart")
    sigs = classes.select("v", "n", "sig")

    # Those apart with the clusters that have the most members of a key.
    outer = apart.select("major", "v", "label").distinct()
    wanted = outer.select("major").distinct()
    inner = clusters.join(wanted, F.col("label") == F.col("major"), "left_semi").select(F.col("label").alias("major"), "v", "label")
    alone = wanted.join(clusters.select("v"), F.col("major") == F.col("v"), "left_anti").select("major", F.col("major").alias("v"), F.col("major").alias("label"))
    both = inner.unionByName(alone).withColumn("part", F.lit(0)).unionByName(outer.withColumn("part", F.lit(1)))
    parts = lambda side: F.ceil(F.count(F.when(F.col("part") == side, 1)) / KEY_BLOCK).cast("int")
    per = both.groupBy("major").agg(parts(0).alias("_q"), parts(1).alias("_p")).withColumnRenamed("major", "_major")
    both = both.join(per, F.col("major") == F.col("_major"))
    own, other = F.when(F.col("part") == 0, F.col("_q")).otherwise(F.col("_p")), F.when(F.col("part") == 0, F.col("_p")).otherwise(F.col("_q"))
    both = both.withColumns({"_own": F.pmod(F.xxhash64("v"), own).cast("int"), "_o": F.explode(F.sequence(F.lit(0), other - 1))})
    first = F.col("part") == 0
    both = both.select(F.col("major").alias("key"), F.lit(0).alias("band"), F.when(first, F.col("_own")).otherwise(F.col("_o")).alias("lo"), F.when(first, F.col("_o")).otherwise(F.col("_own")).alias("hi"), "part", "v", "label")
    found = _plausible_in_blocks(both.join(sigs, "v"), percent)

    # Those apart with each other; the least key of each set of members, by their number and two sums of hashes.
    sums = [F.sum(F.xxhash64(F.lit(i), "v").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    groups = apart.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("label").alias("_l"), F.max("label").alias("_m"), *sums).where("_l <> _m")
    groups = groups.groupBy("c", "s1", "s2").agg(F.min(F.struct("key", "band")).alias("g")).select("g.*")
    among = apart.join(groups, ["key", "band"], "left_semi").select("key", "band", "v", "label")
    return found.unionByName(_plausible_in_blocks(_deal(among, ["key", "band"], KEY_BLOCK).join(sigs, "v"), percent)).distinct()


def _plausible_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``joins`` for each block (key, band, lo, hi) of rows with part, v, n, label and sig."""
    rows = rows.select("key", "band", "lo", "hi", "part", "v", "n", "label", "sig")
    rows = rows.repartition("key", "band", "lo", "hi").sortWithinPartitions("key", "band", "lo", "hi", "v")
    least = _least_equal(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, []

        def close() -> pa.RecordBatch:
            found = joins(members, percent, least) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for key, band, lo, hi, *member in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if (key, band, lo, hi) != now:
                    yield close()
                    now, members = (key, band, lo, hi), []
                members.append(member)
        yield close()

    return rows.mapInArrow(tidy(run), "a long, b long")


def joins(members: list[list], percent: int, least: int) -> list[tuple[int, int]]:
    """(a, b), a < b: pairs that join the labels of the members (part, v, n, label, sig) whose sizes and min-hashes allow the similarity.

    Of members of two parts only pairs across are compared: the others meet where each part meets itself.
    """
    members = sorted(members, key=lambda m: m[2])
    part, n, label = (np.array([m[i] for m in members], np.int64) for i in (0, 2, 3))
    sig = np.frombuffer(b"".join([m[4] for m in members]), np.uint8).reshape(-1, HASHES)
    stop = np.searchsorted(percent * n, 100 * n, "right")
    across = bool((part != part[0]).any())
    out = []
    for i in range(len(members)):
        j = np.arange(i + 1, stop[i])
        j = j[(label[j] != label[i]) & (part[j] != part[i])] if across else j[label[j] != label[i]]
        if not len(j):
            continue
        for x in j[np.count_nonzero(sig[j] == sig[i], axis=1) >= least]:
            if label[x] != label[i]:
                out.append((min(members[i][1], members[x][1]), max(members[i][1], members[x][1])))
                label[label == label[x]] = label[i]
    return out


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(i, j) pairs that join the sets into their components: i is the first of its component, j each other one.

    Two sets are linked if 100 * intersection >= ``percent`` * union. All intersections are counted by products of a 0-1 matrix of
    the elements that two sets or more have, some columns at a time.
    """
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    number = np.cumsum(times > 1) - 1
    column = number[column]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for low in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        m = np.zeros((len(sets), min(width, int((times > 1).sum()) - low)), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        common += m @ m.T
    similar = 100.0 * common >= percent * (n[:, None] + n[None, :] - common.astype(np.float64))
    out, new = [], np.ones(len(sets), bool)
    for i in range(len(sets)):
        if not new[i]:
            continue
        new[i] = False
        front = np.array([i])
        while len(front):
            found = np.flatnonzero(similar[front].any(axis=0) & new)
            new[found] = False
            out += [(i, int(j)) for j in found]
            front = found
    return out


#: What a part of a cluster holds at most, in sets and in bytes of their hashes.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20


def _linked_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the members (v, set) of each block (cluster, lo, hi) into components of confirmed links: at most one a member."""
    rows = rows.select("cluster", "lo", "hi", "v", "set").repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def close() -> pa.RecordBatch:
            found = linked(sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            for cluster, lo, hi, v, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (cluster, lo, hi) != now:
                    yield close()
                    now, ids, sets = (cluster, lo, hi), [], []
                ids.append(v)
                sets.append(np.frombuffer(data, np.uint64))
        yield close()

    return rows.mapInArrow(tidy(run), "a long, b long")


def _in_parts(rows: DataFrame, percent: int) -> DataFrame:
    """Links among the members of each cluster that fall into one part; a cluster has as many parts as its sets or bytes ask for."""
    per = rows.groupBy("cluster").agg(F.count("*").alias("_n"), F.sum(F.octet_length("set").cast("long")).alias("_b")).where("_n > 1")
    parts = F.greatest(F.ceil(F.col("_n") / BLOCK_SETS), F.ceil(F.col("_b") / BLOCK_BYTES))
    rows = rows.join(per.select(F.col("cluster").alias("_c"), parts.alias("_parts")), F.col("cluster") == F.col("_c"))
    return _linked_blocks(rows.withColumn("lo", F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int")).withColumn("hi", F.col("lo")), percent)


def _confirmed(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the members of each cluster (v, label) into components of confirmed links.

    A small cluster's sets (v, set) meet in one block. A large cluster is dealt into parts, each linked by itself, then the first members of what was
    found so, in parts again; near copies are mostly one component by then. What is left apart is compared in full: all members outside the
    largest component with all others (``_deal``). So no two members of different components are left uncompared, a block is bounded whatever the
    cluster's size, and the work is that of the members outside the largest component times all members.
    """
    rows = staged(clusters.withColumnRenamed("label", "cluster").join(sets, "v").select("cluster", "v", "set"), "near-members")
    links = staged(_in_parts(rows, percent), "near-links")
    per = rows.groupBy("cluster").agg(F.count("*").alias("_n"), F.sum(F.octet_length("set").cast("long")).alias("_b"))
    large = per.where((F.col("_n") > BLOCK_SETS) | (F.col("_b") > BLOCK_BYTES)).select("cluster")
    if large.isEmpty():
        return links
    rows = rows.join(large, "cluster", "left_semi")
    label = lambda: components(links, links.count()).select("v", "label")
    leaders = rows.join(label(), "v", "left").where("label IS NULL OR label = v").select("cluster", "v", "set")
    links = staged(links.unionByName(_in_parts(leaders, percent)), "near-links")
    rows = staged(rows.join(label(), "v", "left").withColumn("label", F.coalesce("label", "v")), "near-members")
    wide = rows.agg(F.max(F.octet_length("set"))).first()[0] or 8
    # A part stays within both bounds whatever its sets are like.
    dealt = _deal(rows, ["cluster"], max(1, min(BLOCK_SETS, BLOCK_BYTES // wide)))
    return links.unionByName(_linked_blocks(dealt, percent))


def _small(table: DataFrame, most: int = 200_000) -> bool:
    return table.limit(most + 1).count() <= most


def components(links: DataFrame, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of ``links`` (a, b) reaches. Vertices without links have no row.

    Large and small stars in turn until nothing changes: each vertex sends its larger, then its smaller neighbours to the least it knows. Every
    round is a written table of no more rows than the one before; minima are combined before they move, and joins on a vertex with many links are split where
    they are skewed. A round more than halves the distances, so there are few. ``rows``: how many links there are at most, where that is known.
    """

    def written(edges: DataFrame, rows: int | None) -> tuple[DataFrame, tuple]:
        seen = Observation()
        hashes = F.sum(F.xxhash64("u", "w").cast("decimal(20,0)")).alias("h")
        out = staged(edges.distinct().observe(seen, F.count("*").alias("n"), hashes), "cc", rows)
        return out, (seen.get["n"], seen.get["h"])

    edges, now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")), rows)
    for _ in range(most_rounds):
        before, both = now, edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("w")).alias("m"))
        large = both.join(least, "u").where(F.col("w") > F.col("u")).select(F.col("w").alias("u"), F.col("m").alias("w"))
        large = staged(large.where("u <> w").distinct(), "cc", now[0])
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").where(F.col("w") > F.col("m")).select(F.col("w").alias("u"), F.col("m").alias("w"))
        edges, now = written(small.unionByName(least.select("u", F.col("m").alias("w"))).where("u <> w"), 2 * now[0])
        if now == before:
            return staged(edges.select(F.col("u").alias("v"), F.col("w").alias("label")).unionByName(edges.select(F.col("w").alias("v"), F.col("w").alias("label"))).distinct(), "cc", 2 * now[0])
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if their sets of ``k``-word shingles (A-Z lower-cased, words between white space; a text with fewer words is
    one shingle) have 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id that links reach, kept is
    doc_id = component_id.

    Equal sets are one class, found by a 128-bit hash, so copies in any number cost one row. Tensored banding gives each class its table keys: two
    collections of ``SIDE`` sub-keys, every pair of sub-keys a key. The members of a key are ordered by further min-hashes, and each is held against the
    one before it; pairs whose min-hashes agree too seldom go, and what the others join are clusters. Members of a key in different clusters are then
    compared by their min-hashes, in bounded blocks (``_unjoined``), and plausible pairs join their clusters. In each cluster the full sets of whole
    texts are compared, in bounded blocks (``_confirmed``), and only confirmed links count; so a large group of near copies forms no table of pairs. Two texts at the
    limit of 0.85 share no key with probability ``miss_probability(0.85)``, about 1.5e-5, and less above.

    Null and empty texts have no shingles and link with nothing, each its own component. Rows that repeat a doc_id are one vertex if
    linked by the id, so they share a component if any links; rows with null ids get component_id null and kept true, and link nothing. Empty tables
    give no rows. Other columns are not used.
    """
    small_batches(session_of(docs))
    rows = staged(_sign(docs, k), "near-signed")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL")
    # One row a class: its least doc_id is its vertex.
    named = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("v"), F.count("*").alias("copies"))
    first = Window.partitionBy("doc_id", "h1", "h2").orderBy("n")
    classes = sets.join(named.select(F.col("v").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"])
    classes = classes.withColumn("_i", F.row_number().over(first)).where("_i = 1").select(F.col("doc_id").alias("v"), "h1", "h2", "n", "sig", "subs")
    classes = staged(classes, "near-classes")
    keys = staged(_live_keys(classes), "near-keys")
    clusters = components(_plausible(_neighbours(keys, percent), classes, percent / 100))
    more = staged(_unjoined(keys, clusters, classes, percent), "near-more")
    if more.count():
        both = clusters.select(F.col("v").alias("a"), F.col("label").alias("b")).unionByName(more)
        clusters = components(both, both.count())
    links = _confirmed(clusters, _sets_of(docs, classes, clusters, k), percent)
    labels = components(links.unionByName(_same_id(sets, named)))

    classed = rows.join(named.where("copies > 1").select("h1", "h2", F.col("v").alias("_c")), ["h1", "h2"], "left")
    vertex = F.coalesce("_c", "doc_id")
    out = classed.withColumn("_vertex", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), vertex)).join(labels.select(F.col("v").alias("_vertex"), "label"), "_vertex", "left")
    component = F.coalesce("label", "_vertex", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def _same_id(sets: DataFrame, named: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id though their texts differ."""
    twice = sets.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    rows = sets.join(twice, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct().join(named.select("h1", "h2", "v"), ["h1", "h2"])
    return rows.where("doc_id <> v").select(F.col("v").alias("a"), F.col("doc_id").alias("b"))


def _sets_of(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(v, set) of the classes that stand in a cluster, made anew from one text of each; the other texts are not touched."""
    own = staged(classes.select("v", "h1", "h2").join(clusters.select("v"), "v", "left_semi"), "near-own", clusters.count())
    needed = own.select(F.col("v").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(needed) if _small(needed) else needed, "doc_id", "left_semi")
    # Rows that repeat an id may have other texts: those with the class's own set are taken.
    made = _sets(texts, k).join(own.withColumnRenamed("v", "_v"), ["h1", "h2"]).where(F.col("doc_id") == F.col("_v"))
    return made.select("doc_id", "set").groupBy(F.col("doc_id").alias("v")).agg(F.first("set").alias("set"))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            h1, h2, data = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(words_of(text), k, vocabulary)
                d = blake2b(s.tobytes(), digest_size=16).digest()
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "h1", "h2", "set"])

    return texts.mapInArrow(tidy(run), "doc_id long, h1 long, h2 long, set binary")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays, that with the smallest doc_id (of rows that repeat it,
    one). Documents without shingles all stay, as do rows with null ids. Columns as given."""
    verdict = near_duplicates(docs, k, percent)
    gone = staged(verdict.where("NOT kept").select("doc_id").distinct(), "near-gone")
    rest = docs.join(F.broadcast(gone) if _small(gone) else gone, "doc_id", "left_anti")
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
