"""Quality rules as a short-circuit cascade: the order of the rules comes from measured cost and rejections."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, session_of, small_batches, tidy
from .words import Vocabulary, mixed

SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Features:
    """What the rules ask of one text. Each value is computed when a rule first asks for it."""

    def __init__(self, text: str | None, vocabulary: Vocabulary) -> None:
        self.text, self.vocabulary = text or "", vocabulary

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """(lines with a word, those among them that are equal to an earlier line)."""
        full = [x for x in self.text.split("\n") if x.strip(SPACES)]
        return len(full), len(full) - len(set(full))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of five words that stands twice or more in the text."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        ids = self.vocabulary.hashes(self.words)
        grams = mixed(ids, WINDOW)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(self.n_words + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(step, at, 1)
        np.add.at(step, at + WINDOW, -1)
        return int((np.cumsum(step)[:-1] > 0).sum())


#: Rules by name: true rejects the text. The first two are the base; bounds of the others leave ordinary prose alone.
RULES: dict[str, Callable[[Features], bool]] = {
    "few_words": lambda f: f.n_words < 10,
    "repeated_words": lambda f: 100 * f.n_repeat_words > 20 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > 3 * f.n_words,
    "word_length": lambda f: not 2.5 * f.n_words <= f.word_chars <= 12 * f.n_words,
    "repeated_lines": lambda f: f.lines[0] >= 4 and 2 * f.lines[1] > f.lines[0],
    "capitals": lambda f: 2 * f.n_upper > max(f.word_chars, 1),
}
BASE = ("few_words", "repeated_words")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        yield b, b.column("text").to_pylist()


def measure(docs: DataFrame, rules: dict[str, Callable] = RULES, sample: int = 2000, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of each rule, each run alone, on a random sample of about ``sample`` texts."""
    small_batches(session_of(docs))
    total = docs.count()
    few = docs.select("text").sample(fraction=min(1.0, sample / max(total, 1)), seed=seed)

    def run(batches):
        vocabulary, spent, hit, n = Vocabulary(), dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for _, texts in _texts(batches):
            n += len(texts)
            for text in texts:
                for name, rule in rules.items():
                    began = time.perf_counter()
                    hit[name] += bool(rule(Features(text, vocabulary)))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(rules), "s": [spent[r] for r in rules], "hit": [hit[r] for r in rules], "n": [n] * len(rules)})

    got = few.mapInArrow(tidy(run), "rule string, s double, hit long, n long").groupBy("rule").agg(F.sum("s"), F.sum("hit"), F.sum("n")).collect()
    return [(r, s / max(n, 1), hit / max(n, 1)) for r, s, hit, n in got]


def cascade_order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Most rejections per second first; that order has the least expected cost for independent rules. Ties by name."""
    return [r for r, s, share in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[1], m[0]))]


def first_failing(f: Features, order: list[str], rules: dict[str, Callable] = RULES) -> str | None:
    """The first rule of ``order`` that rejects the text; rules after it are not run."""
    return next((name for name in order if rules[name](f)), None)


def keep_good(docs: DataFrame, order: list[str] | None = None, rules: dict[str, Callable] = RULES) -> DataFrame:
    """The documents that no rule rejects, as they are: the cascade of ``judge`` with all columns kept, whatever their names."""
    small_batches(session_of(docs))
    order = order or cascade_order(measure(docs, rules)) or list(rules)

    def run(batches):
        vocabulary = Vocabulary()
        for b, texts in _texts(batches):
            yield b.filter(pa.array([first_failing(Features(t, vocabulary), order, rules) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def judge(docs: DataFrame, order: list[str] | None = None, digest: bool = False, rules: dict[str, Callable] = RULES) -> DataFrame:
    """Add ``kept`` and ``rejected_by`` to the documents; with ``digest``, return doc_id and the counts of the base instead.

    The order of the cascade is measured on a sample unless it is given. Which rules reject a text does not depend on the order, so
    ``kept`` is the same for any order; only ``rejected_by`` names the first in it. One pass over whole texts without a
    shuffle: no key or group can be hot. Null texts count as empty, and are rejected as such. Null ids and repeated rows are judged each. Empty tables
    give no rows. Columns named ``kept`` or ``rejected_by`` in the input are replaced.
    """
    spark = session_of(docs)
    small_batches(spark)
    order = order or cascade_order(measure(docs, rules)) or list(rules)
    if digest:
        docs = docs.select("doc_id", "text")
        schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    else:
        docs = docs.drop("kept", "rejected_by")
        schema = docs.withColumns({"kept": F.lit(True).cast("boolean"), "rejected_by": F.lit(None).cast("string")}).schema

    def run(batches):
        vocabulary = Vocabulary()
        for b, texts in _texts(batches):
            features = [Features(t, vocabulary) for t in texts]
            first = [first_failing(f, order, rules) for f in features]
            if digest:
                failed = [any(RULES[r](f) for r in BASE) for f in features]
                cols = [b.column("doc_id").cast(pa.int64())]
                for get in (lambda f: f.n_words, lambda f: f.word_chars, lambda f: f.n_symbols, lambda f: f.lines[1], lambda f: f.n_repeat_words):
                    cols.append(pa.array(map(get, features), pa.int64()))
                cols += [pa.array(failed, pa.bool_()), pa.array([r is None and not x for r, x in zip(first, failed, strict=True)], pa.bool_()), pa.array(first, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r is None for r in first], pa.bool_()), pa.array(first, pa.string())], [*b.schema.names, "kept", "rejected_by"])

    return docs.mapInArrow(tidy(run), schema)
