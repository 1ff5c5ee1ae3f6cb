"""Benchmark decontamination by pigeonhole edit matching: exact pieces find, Myers' bit-parallel distance decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import open_fs, scratch, session_of, small_batches, staged, tidy

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 15
#: Items that go to the executors at once hold so many bytes at most; larger benchmarks are searched block by block.
BLOCK_BYTES = 8 << 20
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, every run of characters that are neither letters nor digits one space, trimmed."""
    return _GAPS.sub(" ", (text or "").lower()).strip(" ")


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return length // chars_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of near-equal length: with that many edits at most, one piece is intact."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(n)]


class Pattern:
    """An item for Myers' algorithm: bit masks of its characters; Python integers hold patterns of any length."""

    def __init__(self, text: str) -> None:
        self.text, self.m = text, len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str, most: int) -> int:
        """The least edit distance of the pattern to any substring of ``text``; more than ``most`` is given as most + 1."""
        full, high = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, best, get = full, 0, self.m, self.m, self.masks.get
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (~(xh | pv) & full), pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                best = min(best, score)
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | (~(xv | ph) & full), ph & xv
        return min(best, most + 1)


class Matcher:
    """Finds items in texts. ``items``: (id, normal form between spaces), each form once."""

    def __init__(self, items: list[tuple[object, str]], chars_per_edit: int) -> None:
        import ahocorasick

        self.patterns, self.edits = [Pattern(t) for _, t in items], [budget(len(t), chars_per_edit) for _, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.edits[i]):
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> dict[int, int]:
        """{item: least distance} of the items that stand in ``text`` within their budgets, at whole words."""
        best: dict[int, int] = {}
        if not self.any:
            return best
        text = f" {text} "
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                p, k = self.patterns[i], self.edits[i]
                start = end - size + 1 - offset
                if best.get(i) == 0:
                    continue
                if text.startswith(p.text, max(start, 0)) and start >= 0:
                    best[i] = 0
                    continue
                # Windows of starts that differ by less than the budget cover each other.
                lot = (i, start // (k + 1))
                if k == 0 or lot in tried:
                    continue
                tried.add(lot)
                low = lot[1] * (k + 1)
                d = p.distance(text[max(0, low - k) : max(0, low + p.m + 3 * k + 1)], k)
                if d <= k and d < best.get(i, k + 1):
                    best[i] = d
        return best


ITEMS = "ids array<long>, form string, block int"


def item_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[str, int]:
    """Write the items to the shared folder, in blocks of about ``block_bytes`` by running sums; (path, number of blocks).

    An item is a normal form with the ids that have it, so equal items are searched once. Each block is a folder ``block=n`` that a task reads by itself.
    """
    spark = session_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [normal(t) for t in b.column(1).to_pylist()]
            rows = pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([f" {f} " if f else None for f in forms], pa.string())], ["id", "form"])
            yield rows.filter(pa.array([bool(f) for f in forms], pa.bool_()))

    forms = benchmark.select("item_id", "text").mapInArrow(tidy(run), "id long, form string")
    # Null ids count as an id of their own; the array is as long as an item has ids.
    forms = staged(forms.distinct().groupBy("form").agg(F.collect_list(F.struct("id")).alias("i")).select(F.col("i.id").alias("ids"), "form"), "items")
    lot = F.pmod(F.xxhash64("form"), F.lit(1024))
    lots = forms.groupBy(lot.alias("lot")).agg(F.sum(F.octet_length("form").cast("long") + 64).alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    block = lots.select(F.col("lot").alias("_lot"), F.floor((upto - 1) / block_bytes).cast("int").alias("block"))
    last = block.agg(F.max("block")).first()[0]
    path = scratch(spark, "item-blocks")
    forms.join(F.broadcast(block), lot == F.col("_lot")).select("ids", "form", "block").write.partitionBy("block").parquet(path)
    return path, 0 if last is None else last + 1


_matchers: dict[tuple[str, int, int], tuple[list[list[int | None]], Matcher]] = {}


def matcher_of(path: str, block: int, chars_per_edit: int) -> tuple[list[list[int | None]], Matcher]:
    """(ids of each item, matcher) of a block, read from the shared folder. A Python worker keeps the last one for its next tasks."""
    key = (path, block, chars_per_edit)
    if key not in _matchers:
        import pyarrow.dataset as ds

        _matchers.clear()
        fs, base = open_fs(f"{path}/block={block}")
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("form", pa.string())])
        rows = ds.dataset(base, schema=schema, filesystem=fs, format="parquet").to_table()
        items = sorted(zip(rows["form"].to_pylist(), rows["ids"].to_pylist(), strict=True), key=lambda r: r[0])
        _matchers[key] = [ids for _, ids in items], Matcher([(None, form) for form, _ in items], chars_per_edit)
    return _matchers[key]


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """Test items found in documents: doc_id, item_id, distance (edits of the best place), one row a pair of ids.

    Texts and items are compared in normal form (``normal``). An item of n characters may differ by n // ``chars_per_edit`` edits
    from a stretch of the text. It is cut into one piece more than that, so at least one piece stands in the stretch unchanged: all pieces of all items are
    searched at once by an automaton, and each place where one is found is decided by Myers' distance over the stretch it implies. No
    pair within the budget is missed.

    The documents are read where they lie, whole, and only what is found is shuffled: of rows that repeat a doc_id or an item_id the least distance
    counts, whatever partitions they stand in. Items lie in the shared folder in blocks of ``block_bytes`` and are searched block by
    block, whatever the size of the benchmark; a worker holds one block, the driver none. Null or empty texts match nothing; items without letters or digits
    are left out; items too short for an edit must match exactly, as whole words. Null ids are reported as null. Empty tables give no rows.

    With ``keep``, the documents without any match are returned instead, as they are, with all their columns.
    """
    small_batches(session_of(docs))
    path, n = item_blocks(benchmark, block_bytes)
    if keep:
        for block in range(n):
            docs = _clean(docs, path, block, chars_per_edit)
        return docs
    found = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("distance")).where("false")
    for block in range(n):
        found = found.unionByName(_search(docs, path, block, chars_per_edit))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _search(docs: DataFrame, path: str, block: int, chars_per_edit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32())
        for b in batches:
            ids, matcher = matcher_of(path, block, chars_per_edit)
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc_id, i, d) for item, d in matcher.find(normal(text)).items() for i in ids[item]]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, item_id long, distance int")


def _clean(docs: DataFrame, path: str, block: int, chars_per_edit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, matcher = matcher_of(path, block, chars_per_edit)
            yield b.filter(pa.array([not matcher.find(normal(t)) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
