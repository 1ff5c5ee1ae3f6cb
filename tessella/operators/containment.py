"""Which short texts stand in which long ones, character for character, without a comparison of all pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.overlap import among
from tessella.storage import staged

#: Bits of the bitmap for each hash in it, and bits in all at most (128 MB): beyond that more places pass it in vain, none is lost.
BITS_EACH, MOST_BITS = 64, 1 << 30
#: Bits of a slice of the bitmap, which one task puts together.
SLICE = 1 << 23
#: Bytes of text that are hashed at a time in Python.
BYTES_AT_ONCE = 1 << 20
#: Bytes at most of what stands before and after a question's inner words that its key takes in.
EDGE = 8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Sums:
    """Prefix sums from which any run of a list is hashed at once, whatever its length."""

    def __init__(self, items: np.ndarray):
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(items), base, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items.astype(np.uint64) * powers(_BASE)[:-1])])
        self.back = powers(_INVERSE)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


class _Texts:
    """The words (runs of a-z and 0-9) of lower-case texts, all in one row, and hashes of runs of them."""

    def __init__(self, texts: pa.Array):
        size = np.asarray(pc.binary_length(texts), np.int64)
        data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
        self.to = np.cumsum(size)  # of each text's bytes
        self.since = self.to - size
        inside = _IN_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.to], edge[self.since] = True, True
        before, after = np.concatenate([[False], inside]) & ~edge, np.concatenate([inside, [False]]) & ~edge
        self.start = np.flatnonzero(inside & ~before[:-1])  # of each word, in bytes
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.bytes = _Sums(data)
        self.words = _Sums(self.bytes.hashes(self.start, self.end))
        self.row = np.searchsorted(self.to, self.start, "right")  # of each word
        self.first = np.searchsorted(self.row, np.arange(len(size)), "left")  # word of each text
        self.count = np.searchsorted(self.row, np.arange(len(size)), "right") - self.first
        self.last = (self.first + self.count)[self.row]  # for each word, where its text's words end

    def runs(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.words.hashes(at, at + n)

    def keys(self, at: np.ndarray, n: np.ndarray | int, before: np.ndarray | int, after: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of words, with all that stands between them and so many bytes at either side, and whether their text has those."""
        row, start, end = self.row[at], self.start[at], self.end[at + n - 1]
        ok = (start - before >= self.since[row]) & (end + after <= self.to[row])
        low, high = np.where(ok, start - before, start), np.where(ok, end + after, end)
        return _mixed(self.runs(at, n) + np.uint64(3) * self.bytes.hashes(low, high)), ok


def _lots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lots = np.cumsum(np.asarray(pc.binary_length(b.column("t")), np.int64)) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), b.num_rows]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


ASKED = "t string, key long, inner long, anchor long, n long, size long, before long, after long"


def _asked(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Texts of enough words. The inner words are those that can't be part of longer ones: ``inner`` is the hash of all, ``anchor`` that of the first n, the
    largest power of two, and ``key`` has what stands between them and up to EDGE bytes at either side as well."""
    for b in _lots(batches):
        x = _Texts(b.column("t"))
        rows = np.flatnonzero(x.count >= least)
        at, size = x.first[rows], x.count[rows]
        cut = (x.start[at] == x.since[rows]).astype(np.int64)
        size = size - cut - (x.end[at + size - 1] == x.to[rows])
        at = at + cut
        n = np.int64(1) << np.floor(np.log2(size)).astype(np.int64)
        before, after = np.minimum(x.start[at] - x.since[rows], EDGE), np.minimum(x.to[rows] - x.end[at + size - 1], EDGE)
        hashes = [h.view(np.int64) for h in (x.keys(at, size, before, after)[0], x.runs(at, size), x.runs(at, n))]
        columns = [b.column("t").take(pa.array(rows)), *map(pa.array, [*hashes, n, size, before, after])]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ASKED.split(", ")])


def _bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A bit for each hash (g): its lowest bits are the place. Slices are put together by tasks, the driver gets them one partition at a time."""
    each = min(bits, SLICE)

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            place = np.asarray(b.column("place"), np.int64)
            for k in np.unique(place // each).tolist():
                found = out.setdefault(k, np.zeros(each // 8, np.uint8))
                x = place[place // each == k] % each
                np.bitwise_or.at(found, x >> 3, np.left_shift(1, x & 7).astype(np.uint8))
        for k, found in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["k", "found"])

    place = F.col("g").bitwiseAND(F.lit(bits - 1).cast("long"))
    rows = hashes.select(place.alias("place")).withColumn("k", F.floor(F.col("place") / each)).repartition(max(1, bits // each // 8), "k")
    out = bytearray(bits // 8)
    for k, found in rows.mapInArrow(slices, "k long, found binary").toLocalIterator():
        out[k * each // 8 : (k + 1) * each // 8] = found
    return bytes(out)


def contained_in(questions: DataFrame, prompts: DataFrame, least: int = 4) -> DataFrame:
    """(q, p): for each question (q, t) of ``least`` words or more, three at least, that stands in a prompt (p, t), the least such p. Texts are in lower case.

    A question's first and last word may be parts of longer words in a prompt, the words between can't: these, what stands between them and up to EDGE bytes at either
    side, as one hash, are what questions and prompts are joined by, and texts are compared for the pairs found. A prompt's places that no
    question fits are left out by a bitmap of all hashes before anything is shuffled: first by a question's first 1, 2, 4, 8 … inner words,
    then, where those fit, by the numbers of words that questions have, then by the bytes beside them. Equal questions are looked up once.
    """
    if least < 3:
        raise ValueError("without inner words there is nothing to join by")
    spark = questions.sparkSession
    asked = questions.select("t").where("t IS NOT NULL").distinct()
    asked = staged(asked.mapInArrow(lambda batches: _asked(batches, least), ASKED), "asked")
    shapes: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for n, size, before, after in asked.select("n", "size", "before", "after").distinct().collect():  # bounded by the numbers of words that questions have
        shapes.setdefault(n, {}).setdefault(size, []).append((before, after))
    bits = min(MOST_BITS, max(1 << 16, 1 << (3 * BITS_EACH * asked.count()).bit_length()))
    known = spark.sparkContext.broadcast(_bitmap(asked.select(F.explode(F.array("key", "inner", "anchor")).alias("g")), bits))

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = np.frombuffer(known.value, np.uint8), np.uint64(bits - 1)

        def passes(g: np.ndarray) -> np.ndarray:
            x = g & mask
            return (bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for b in _lots(batches):
            x = _Texts(b.column("t"))
            keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for n, sizes in shapes.items():
                at = np.flatnonzero(np.arange(n, len(x.start) + n) <= x.last)
                at = at[passes(x.runs(at, n))]
                for size, edges in sizes.items():
                    here = at[at + size <= x.last[at]]
                    here = here[passes(x.runs(here, size))]
                    for before, after in edges if len(here) else ():
                        key, ok = x.keys(here, size, before, after)
                        ok &= passes(key)
                        keys.append(key[ok])
                        rows.append(x.row[here[ok]])
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column("ph").take(row), b.column("p").take(row)], ["key", "ph", "p"])

    held = prompts.where("t IS NOT NULL").select("p", "t", F.xxhash64("t").alias("ph"))
    found = held.mapInArrow(places, "key long, ph long, p long").groupBy("key", "ph").agg(F.min("p").alias("p"))  # before the join, which can split a hot key
    pairs = staged(found.join(asked.select("key"), "key", "left_semi"), "pairs")
    texts = among(held.select(F.col("ph").alias("g"), F.col("t").alias("pt")), pairs.select(F.col("ph").alias("g"))).distinct().withColumnRenamed("g", "ph")
    least_p = pairs.join(asked.select("key", "t"), "key").join(texts, "ph").where(F.contains("pt", "t")).groupBy("t").agg(F.min("p").alias("p"))
    return questions.join(least_p, "t").groupBy("q").agg(F.min("p").alias("p"))
