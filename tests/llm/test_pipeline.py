"""The pipeline's stages against brute force, one after the other, and on edge cases."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from tessella.llm import decontam, mixing, quality, tokens
from tessella.llm.words import Vocabulary

from .test_operators import EDGES, SCHEMA, brute_components


def keeps(text):
    f = quality.Features(text, Vocabulary())
    return not any(rule(f) for rule in quality.RULES.values())


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "token-ID output"]


def test_each_stage_does_its_whole_job(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    good = P.keep_good(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    assert ids == {i for i, r in rows.items() if keeps(r.text)} and 0.7 * len(rows) < len(ids) < len(rows)

    first = P.keep_first(spark, good, sf_dir).cache()
    assert first.columns == docs.columns
    want = {i for i, _, _, own in brute_components([(i, rows[i].text) for i in sorted(ids)], 5, 80) if own}
    assert {r.doc_id for r in first.collect()} == want and len(want) < len(ids)

    clean = P.keep_clean(spark, first, sf_dir).cache()
    items = [decontam.Pattern(f" {decontam.normal(r.text)} ") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # Every item against the whole text, without any pieces.
    dirty = {i for i in want if any(p.distance(f" {decontam.normal(rows[i].text)} ", decontam.budget(p.m)) <= decontam.budget(p.m) for p in items)}
    assert {r.doc_id for r in clean.collect()} == want - dirty and dirty

    mix = P.mixed(spark, clean, sf_dir).cache()
    assert mix.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    counts = Counter(r.doc_id for r in mix.select("doc_id").collect())
    assert counts == Counter({i: n for i, n in copies.items() if n}) and max(counts.values()) <= 3

    got = Counter(map(tuple, P.to_tokens(spark, mix, sf_dir).collect()))
    t, start, out = Tokenizer.from_file(tokens.vocabulary_path()), 0, Counter()
    for i in sorted(counts.elements()):
        x = [*t.encode(rows[i].text, add_special_tokens=False).ids, 0]
        out[(i, start, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes()))] += 1
        start += len(x)
    assert got == out


@pytest.mark.parametrize("rows", [EDGES, []], ids=["edges", "empty"])
def test_stages_on_edge_cases(spark, sf_dir, rows):
    docs = spark.createDataFrame([(i, t, la, s, None, "x", 1, "y", 2) for i, t, la, s in rows], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        n = out.count()
        assert n <= 3 * len(rows) and (name == "token-ID output" or out.columns == docs.columns)
    assert P.keep_clean(spark, docs, sf_dir).count() == len(rows)
    assert P.keep_first(spark, docs, sf_dir).where("text IS NULL OR doc_id IS NULL").count() == sum(t is None or i is None for i, t, _, _ in rows)
