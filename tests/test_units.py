"""Operators against small sequential versions, boundary rows and invariants."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import containment, dedup, links, overlap, pii, quality, scoring, selection, stats, strict
from tessella.plans import catalog, corpus_queries
from tessella.sources import io
from tessella.streaming import events as ev


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


# --- quality ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("para", "rule"),
    [
        ("abcdef 1234", None),
        ("abc 123456", "alpha_ratio"),
        ("ab cd ef", "word_length"),
        ("abc def", None),
        ("a" * 13, "word_length"),
        ("a" * 12, None),
        ("word " * 19 + "x... y... z___", None),
        ("word " * 5 + "more | than", None),
        ("word word word word | |", "symbol_ratio"),
        ("see pp. three and more of it\nplain words in a line here\nplain words in a line here\nplain words in a line here", None),
        ("see pp. three and more of it\nplain words in a line here\nplain words in a line here", "reference_list"),
        ("one two three four five six\nshort line\nshort line", None),
        ("one two three four five six\nshort line here\nshort line", "short_lines"),
        ("one two three four five six\nshort line here", None),
        ("éàü éàü", None),
    ],
)
def test_paragraph_rules(spark, para, rule):
    assert one(spark, quality.paragraph_rule(F.col("p")), p=para) == rule


def test_document_rules_round_half_even(spark):
    rule = lambda n, r: one(spark, quality.document_rule(F.lit(n), F.lit(r), 10))
    assert [rule(9, 0.9), rule(10, 0.6994), rule(10, 0.6996), rule(10, 0.7)] == ["min_words", "dictionary", None, None]


def test_dictionary_knows_stems_of_two_letters_and_more(spark):
    docs = spark.createDataFrame([(1, "walking walked walks a é"), (2, ""), (3, "zzz walkings")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.ratio) for r in quality.dictionary_ratio(docs, spark.createDataFrame([("walk",), ("a",)], "word string")).collect()}
    assert got == {1: (4, 0.75), 2: (0, 0.0), 3: (2, 0.0)}


def test_running_lines_need_more_than_the_share(spark):
    rows = [("d", p, i, t) for p in range(10) for i, t in enumerate([f"Chapter {p}" if p < 4 else "top " + "abcdefghij"[p], "body " + "abcdefghij"[p], f"foot {p}"])]
    got = quality.running_lines(spark.createDataFrame(rows, "doc string, page int, pos int, line string")).collect()
    assert Counter(r.line[:4] for r in got) == {"foot": 10, "Chap": 4}
    assert quality.running_lines(spark.createDataFrame([r for r in rows if r[1] < 4], "doc string, page int, pos int, line string")).count() == 0


def test_chat_limits(spark):
    def turns(i, roles, text):
        return [(i, k, r, text) for k, r in enumerate(roles)]

    rows = turns(1, ["user", "assistant"], "hello") + turns(2, ["assistant", "user"], "hello") + turns(3, ["user", "assistant", "user"], "hello") + turns(4, ["user", "assistant"], "x" * 3000) + turns(5, ["user", "assistant"], "x" * 3001)
    rows += turns(6, ["user", "assistant"], "a" * 19 + "é") + turns(7, ["user", "assistant"], "a" * 18 + "éé") + turns(8, ["user", "assistant"], "")
    got = {r.conv_id for r in quality.chat_eligible(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {1, 4, 6}


# --- duplicates ---------------------------------------------------------------------------------------------------------


def jaccard_pairs(rows, k, percent):
    s = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", t.lower())
        if len(w) >= k:
            s[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])}


def near_rows(n=60, seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(4, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [50, 80])
def test_similar_pairs_are_exact(spark, percent):
    rows = near_rows()
    got = {(r.a, r.b) for r in dedup.similar_pairs(spark.createDataFrame(rows, "id long, text string"), percent=percent).collect()}
    assert got == jaccard_pairs(rows, 5, percent) and len(got) > 20


def test_first_copy_wins_is_the_sequential_result(spark):
    rng = random.Random(4)
    ids = list(range(40))
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(60)})
    kept = []
    for i in ids:
        if not any((a, i) in set(pairs) for a in kept):
            kept.append(i)
    df = dedup.first_copy_wins(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r.id for r in df.where("kept").collect()) == kept


def test_bands_find_most_pairs(spark):
    rows = near_rows(seed=3)
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = jaccard_pairs(rows, 5, 95)
    found = {(r.a, r.b) for r in dedup.banded_candidates(df, "id", "text").collect()}
    assert len(pairs & found) >= 0.95 * len(pairs)


def test_cross_chunk(spark):
    t = " ".join(f"a{i}" for i in range(40))
    rows = [("d", 1, t), ("d", 2, t), ("e", 3, t), ("f", 4, "few words only"), ("g", 5, t + " " + " ".join(f"b{i}" for i in range(60)))]
    got = {r.id for r in dedup.cross_chunk_duplicates(spark.createDataFrame(rows, "doc string, id int, text string")).collect()}
    assert got == {3}


# --- personal data and links --------------------------------------------------------------------------------------------

PII = [
    "mail Jo.Do+x@sub.example.COM now",
    "call (743) 555-3824, 743.555.3824 or 743-555-3824!",
    "743 555 3824 and 1743-555-38245 no",
    "ssn 123-45-6789 and 123-45-67890",
    "a@b.co c@d.org",
    "x.743-555-3824",
    "743-555-3824@mail.com",
]


def test_pii_equals_python(spark):
    df = spark.createDataFrame([(t,) for t in PII], "t string").select("t", pii.scrub(F.col("t")).alias("s"))
    for r in df.collect():
        text, counts = r.t, {}
        for kind, pattern in pii.PATTERNS:
            text, counts[kind] = re.subn(pattern, f"[{kind}]", text)
        assert (r.s.text, r.s.email, r.s.phone, r.s.id) == (text, counts["EMAIL"], counts["PHONE"], counts["ID"])


def test_contexts(spark):
    assert one(spark, pii.contexts(F.col("t"), "EMAIL", 4), t="before a@b.co after") == ["ore a@b.co aft"]


def test_new_links(spark):
    rows = [("u1", "s1", 1), ("u1", "s1", 2), ("u2", "s1", 3), ("u3", "s3", 4), ("k", "s4", 5)]
    known = spark.createDataFrame([("k", "x")], "href string, slug string")
    assert [r.href for r in links.new_links(spark.createDataFrame(rows, "href string, slug string, ord int"), known).collect()] in (["u1", "u3"], ["u3", "u1"])


# --- text ---------------------------------------------------------------------------------------------------------------


def test_ngrams_boundaries(spark):
    g = lambda w, n: one(spark, T.ngrams(F.lit(w) if w else T.empty_strings(), n))
    assert g([], 2) == [] and g(["a"], 2) == [] and g(["a", "b"], 2) == ["a b"] and g(["a", "b", "c"], 2) == ["a b", "b c"]
    assert one(spark, T.ngrams_or_whole(F.lit(["a"]), 3)) == ["a"]


def test_text_functions(spark):
    assert one(spark, T.first_number(F.col("t")), t="FEMA P-361") == 361.0
    assert one(spark, T.first_number(F.col("t")), t="-1,200.5e1 x") == -12005.0
    assert one(spark, T.first_number(F.col("t")), t="none") is None
    assert one(spark, T.slug(F.col("a"), F.col("b")), a="Pub!", b="The_File (2)") == "pub-the-file-2"
    assert one(spark, T.join_broken_lines(F.col("t")), t="a bro-\nken line\nnext") == "a broken line next"
    assert one(spark, T.sentences(F.col("t")), t="One. Two; three") == ["One.", "Two;", "three"]
    assert one(spark, T.tokens(F.col("t")), t=" a b  c ") == ["a", "b", "c"]
    assert one(spark, T.content_words(F.col("t")), t="The 5.10 of beams") == ["5.10", "beams"]
    assert tuple(one(spark, T.chunk_parts(F.col("t")), t="doc-1:p12:c3")) == ("doc-1", 12, 3)
    assert one(spark, T.h01(F.col("t")), t="x") == pytest.approx(int.from_bytes(__import__("hashlib").sha256(b"x").digest()[:8], "big") / 2**64)


# --- overlap ------------------------------------------------------------------------------------------------------------


def test_coverage(spark):
    n = 3
    rows = [(1, "a b c x y d e f"), (2, "a b"), (3, "q a b c d"), (4, "")]
    ref = overlap.positioned_grams(spark.createDataFrame([(9, "a b c d e f")], "id int, text string"), "id", "text", n)
    got = {r.id: tuple(r)[1:] for r in overlap.covered_tokens(spark.createDataFrame(rows, "id int, text string"), ref, "id", "text", n).collect()}
    assert got == {1: (8, 6, 2, 6, 3), 2: (2, 0, 0, 0, 0), 3: (5, 3, 2, 4, 4), 4: (0, 0, 0, 0, 0)}


def test_rule1_boundary(spark):
    held = spark.createDataFrame([(1, "a b c d e f"), (2, "x y"), (3, "z")], "id int, text string")  # three 4-grams
    q = spark.createDataFrame([(10, "a b c d"), (11, "a b c d e"), (12, "X y"), (13, "x y w"), (14, "")], "id int, text string")
    assert {(r.q, r.r) for r in overlap.copied_from(q, held).collect()} == {(11, 1), (12, 2)}


# --- selection ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "val"), [(1, 1), (10, 1), (30, 2), (50, 2), (70, 4)])
def test_split_rounds_half_even(spark, n, val):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    assert selection.stratified_split(df, "doc_id", "source").where("split = 'val'").count() == val


def test_split_is_stable(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("source"))
    a, b = (sorted(r.doc_id for r in selection.stratified_split(df.repartition(k), "doc_id", "source").where("split = 'val'").collect()) for k in (1, 37))
    assert a == b


def test_quotas_add_up_and_ties(spark):
    df = spark.createDataFrame([("b", 1, 0), ("a", 1, 1), ("c", 1, 2)], "name string, weight int, ord int")
    by = lambda *tie: {r.name: r.quota for r in selection.quotas(df, 4, [F.col(c) for c in tie]).collect()}
    assert by("ord") == {"b": 2, "a": 1, "c": 1} and by("name") == {"a": 2, "b": 1, "c": 1}


def test_budget_skips_and_goes_on(spark):
    rows = [("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 4, 1), ("h", 5, 9), ("h", 6, 4)]
    got = selection.budgeted(spark.createDataFrame(rows, "g string, id int, cost int"), "g", ["id"], "cost", 4, ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 6]


def test_greedy_chunks_equal_a_sequential_version(spark, sf_dir):
    def split(text, most):
        pieces = []
        for s in re.split(r"(?<=[.;:])\s+", re.sub(r"\s+", " ", text).strip(" ")):
            w = s.split()
            pieces += [w[i : i + most] for i in range(0, len(w), most)]
        out, now = [], []
        for p in pieces:
            if now and len(now) + len(p) > most:
                out.append(now)
                now = []
            now = now + p
        return [" ".join(x) for x in [*out, now] if x]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000")
    got = defaultdict(list)
    for r in selection.greedy_chunks(docs, "doc_id", "text", 40).orderBy("id", "chunk").collect():
        got[r.id].append(r.text)
    assert all(got[r.doc_id] == split(r.text, 40) for r in docs.collect())


def test_packing_identities(spark):
    sizes = [5, 1, 0, 30, 7, 9]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long")
    got = selection.packed_windows(df, "doc_id", "n", 8).collect()
    flat = [i for i, n in enumerate(sizes) for _ in range(n + 2)]
    want = Counter((k // 8, d) for k, d in enumerate(flat[: len(flat) // 8 * 8]))
    assert {(r.window, r.doc): r.tokens for r in got} == dict(want)


def test_prefix_sums(spark):
    rows = [(i * 3, i % 5) for i in range(300)]
    got = {r.o: r.before for r in selection.prefix_sums(spark.createDataFrame(rows, "o long, s long").repartition(7), "o", "s").collect()}
    run = 0
    for o, s in rows:
        assert got[o] == run
        run += s
    assert selection.prefix_sums(spark.createDataFrame([], "o long, s long"), "o", "s").count() == 0


# --- scores and statistics ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("answer", "gold", "kind", "why"),
    [
        ("Rule 12.3.4", "Rule 12.3.4", "identifier", None),
        ("7.1.2.9", "7.1.2", "identifier", "phrase"),
        ("Bridge Code section 7.1.2", "7.1.2", "identifier", None),
        ("B 52", "B52", "identifier", None),
        ("TM 5-820-1", "TM 5-820-4", "identifier", "phrase"),
        ("2,500 kg", "2500 kg", "value", None),
        ("2,500 kilograms\nbecause it is", "2500 kg", "value", None),
        ("-4 °", "4 °", "value", "missing_number"),
        ("1-3/4 inches", "1.75 in", "value", None),
        ("3/4 in", "0.75 in", "value", None),
        ("seven days", "7", "number", None),
        ("1901", "1902", "value", "missing_number"),
        ("either 3 or 4 m", "3 m", "value", "two_candidates"),
        ("3-4 m", "3 m", "value", "two_candidates"),
        ("3 m", "3 km", "value", "unit"),
        ("3 m and 8 m", "3 m", "value", "conflict"),
        ("3 m at 20 %", "3 m", "value", None),
        ("12", "12:1", "other", None),
        ("50 mm", "50 mm (2 in.)", "value", None),
        ("moment arm, lever", "lever", "term", "two_candidates"),
        ("rocks", "rock", "term", None),
        ("loose rock", "rock", "term", None),
        ("rock", "loose rock slope", "term", "phrase"),
        ("the lever", "lever (arm)", "term", None),
        ("a/b ratio", "a/b ratio", "term", None),
        (None, "x", "term", "phrase"),
        ("x", None, "term", "phrase"),
    ],
)
def test_strict(answer, gold, kind, why):
    assert strict.finding(answer, gold, kind) == why


def test_percentiles_of_small_samples(spark):
    for xs in ([1.0], [1.0, 2.0], [4.0, 1.0, 3.0, 2.0]):
        s, n = sorted(xs), len(xs)
        a = F.lit(xs)
        got = spark.range(1).select(stats.median_upper(a), stats.percentile_floor(a, 0.9), stats.percentile_low(a, 0.9)).first()
        assert tuple(got) == (s[n // 2], s[min(n - 1, int(0.9 * n))], s[int(0.9 * (n - 1))])


def test_wilson_of_nothing(spark):
    assert tuple(one(spark, stats.wilson(F.lit(0), F.lit(0)))) == (0.0, 0.0)


def test_auroc_ties(spark):
    rows = [(1, 0), (1, 1), (2, 1), (0, 0)]
    r = stats.auroc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first()
    assert r.auroc == (1 + 0.5 + 1 + 1) / 4


def test_gate_and_scores(spark):
    rows = [("a", 0.5, 1.0), ("a", None, 1.0), ("b", 2.0, 1.0), ("b", None, 1.0), ("c", 0.0, 1.0)]
    got = {r.run: r.verdict for r in scoring.quality_gate(spark.createDataFrame(rows, "run string, delta double, floor double")).collect()}
    assert got == {"a": "incomplete", "b": "fails", "c": "passes"}


# --- sources ------------------------------------------------------------------------------------------------------------


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n\"x\""), (2, None)], "id long, t string")
    assert io.write_jsonl(df, f"{tmp_path}/j") == 2
    assert sorted(map(tuple, io.read_jsonl(spark, f"{tmp_path}/j", "id long, t string, more int").collect())) == [(1, "é\n\"x\"", None), (2, None, None)]
    assert io.read_jsonl(spark, f"{tmp_path}/none", "id long").count() == 0
    io.write_csv(df.select(F.col("id").cast("string").alias("id"), "t"), f"{tmp_path}/c")
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/c", ["id", "t", "gone"]).collect())) == [("1", "é\n\"x\"", ""), ("2", "", "")]
    (tmp_path / "ids.txt").write_text("a b\n\nb  c\n")
    assert sorted(r.id for r in io.read_ids(spark, f"{tmp_path}/ids.txt").collect()) == ["a", "b", "c"]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 rest")
    r = io.read_blobs(spark, f"{tmp_path}/x.pdf", b"%PDF-").first()
    assert r.ok and r.bytes == 13


def test_manifest_does_not_depend_on_order(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    a, b, c = (io.manifest(x).first() for x in (df, df.repartition(7).orderBy(F.desc("id")), df.where("id > 0")))
    assert a == b and a != c


def test_newest_guard_and_blocks(spark):
    files = spark.createDataFrame([("k", 1, "old", False), ("k", 3, "chat", True), ("k", 2, "new", False)], "k string, t int, v string, chat boolean")
    assert [r.v for r in io.newest(files, "k", "t", "v", F.col("chat")).collect()] == ["new"]
    t = spark.createDataFrame([("r", "v1", 1.0)], "run string, tag string, m double")
    assert io.guarded_append(t, t, "tag").count() == 2
    with pytest.raises(ValueError):
        io.guarded_append(t, t.withColumn("tag", F.lit("v2")), "tag")
    assert io.replace_block("a <b> x <e> z", "<b>", "<e>", "new") == "a <b>\nnew\n<e> z"
    with pytest.raises(ValueError):
        io.replace_block("<b> <b> <e>", "<b>", "<e>", "x")


# --- streams ------------------------------------------------------------------------------------------------------------


def test_stream_monitor_equals_batch(spark, sf_dir):
    a = {tuple(r) for r in catalog.QUERIES["stream_monitor"](spark, sf_dir).collect()}
    b = {tuple(r) for r in ev.monitor_batch(ev.batch_events(spark, f"{sf_dir}/events.parquet")).collect()}
    assert a == b


def test_flagship(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert {r.split for r in rows} == {"train", "val"} and all(r.docs > 0 for r in rows)


def test_lines_are_collapsed(spark, sf_dir):
    lines = corpus_queries.line_texts(spark, sf_dir)
    assert lines.count() == lines.select("text").distinct().count()


def test_distractors_are_of_other_documents(spark, sf_dir):
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    rows = [(r.id, r.other) for r in catalog.QUERIES["distractor_chunks"](spark, sf_dir).collect()]
    assert len(rows) == len(docs) and all(o is None or docs[o] != docs[i] for i, o in rows)


# --- containment --------------------------------------------------------------------------------------------------------


def test_contained_in_equals_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["a", "be", "cat", "dog", "é", "x1", "on", "the", "sat", "mat"]
    prompts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "-", ", "]) for _ in range(rng.randrange(60)))) for i in range(80)]
    prompts += [(900 + i, t) for i, (_, t) in enumerate(prompts[:20])] + [(None, "one of no number at all"), (990, None), (991, "")]
    questions = [(i, rng.choice(prompts)[1] or "") for i in range(300)]
    cut = lambda t: t[(a := rng.randrange(len(t) + 1)) : a + rng.randrange(1, 90)]
    questions = [(i, cut(t)) for i, t in questions] + [(301, None), (302, ""), (303, "of no number at"), (304, "ne of no number"), (304, "never seen in any prompt")]
    words = lambda t: len(re.findall("[a-z0-9]+", t or ""))
    want = {}
    for q, t in questions:
        held = [p for p, x in prompts if words(t) >= 4 and t in (x or "")]
        if held:
            want[q] = min((p for p in held if p is not None), default=None)
    got = containment.contained_in(spark.createDataFrame(questions, "q long, t string").repartition(3), spark.createDataFrame(prompts, "p long, t string").repartition(3)).collect()
    assert {r.q: r.p for r in got} == want and len(got) == len(want) > 100


def shuffled_bytes(spark) -> int:
    """What all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_question_in_prompt_shuffles_less_than_its_input(spark, tmp_path):
    """Texts don't go with each of their runs of words, and runs that no question has aren't shuffled."""
    text = lambda start, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substring(F.sha2((F.col("id") * 1000 + start + i).cast("string"), 256), 1, 9)), " ")
    c = spark.range(800).select((F.col("id") + 1).alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), text(0, 300).alias("text"))
    c = c.unionByName(spark.range(60).select((F.col("id") + 1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), text(20, 9).alias("text")))
    c.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    before, limit = shuffled_bytes(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")  # as for more questions than fit a broadcast
    try:
        got = catalog.QUERIES["question_in_prompt"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(limit)
    assert sorted(map(tuple, got)) == [(1000 * i, 1000 * i + 1) for i in range(1, 61)]
    assert 0 < shuffled_bytes(spark) - before < sum(p.stat().st_size for p in (tmp_path / "conversations.parquet").glob("*.parquet")) / 2


def test_question_in_prompt_has_the_white_space_and_case_of_its_sql(spark, tmp_path):
    import duckdb

    texts = [("user", "HE cat  sat on ma"), ("assistant", "so the cat sat\ton\nmat."), ("user", "no\u00a0break space between words"), ("assistant", "no break space between words"), ("user", "\u00a0 ends in no break space \u2003"),
             ("assistant", "it ends in no break spaces"), ("user", "ΑΣ one two three four ΟΔΟΣ"), ("assistant", "ασ one two three four οδοσ"), ("user", "İ is one dotted letter"), ("assistant", "i is one dotted letter"), ("user", "vertical\u000btab is no space here"), ("assistant", "vertical tab is no space here")]
    spark.createDataFrame([(i, 0, r, t) for i, (r, t) in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE_SQL["question_in_prompt"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["question_in_prompt"](spark, str(tmp_path)).collect())) == want and len(want) == 4


# --- paired bootstrap ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["plain", "nulls", "empty", "all_null"])
def test_paired_bootstrap_equals_its_sql(spark, tmp_path, kind):
    """More items than a block has, a mean that ends in a five at the seventh place, null ids and values, no rows at all."""
    import duckdb

    n = {"plain": 8192, "nulls": 6, "empty": 0, "all_null": 3}[kind]
    rows = [(7 * i % n if kind == "plain" or i else None, int(i % 128 == 0) if kind == "plain" else None if kind == "all_null" or i % 3 else i % 2, 0) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{tmp_path}/labels.parquet/*.parquet')")
    assert list(map(tuple, catalog.QUERIES["paired_bootstrap"](spark, str(tmp_path)).collect())) == con.execute(catalog.ORACLE_SQL["paired_bootstrap"]).fetchall()


def test_paired_bootstrap_neither_sends_nor_shuffles_picks(spark, monkeypatch):
    items = spark.range(30_000).select(F.col("id").alias("i"), (F.col("id") % 3 - 1).cast("double").alias("d"))
    before = shuffled_bytes(spark)
    df = stats.paired_bootstrap(items, 50)
    got = df.collect()
    assert shuffled_bytes(spark) - before < 16 * 30_000  # an index and a value for each item, but none of its picks
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and len(plan) < 30_000  # no array of slots, which the driver would hold and print
    monkeypatch.setattr(stats, "BROADCAST_ITEMS", 10)
    assert stats.paired_bootstrap(items, 50).collect() == got
