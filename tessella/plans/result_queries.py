"""Queries that score answers, compare runs and sum up results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import scoring, stats, strict

from .corpus_queries import docs_
from .registry import query, table, values

ANSWERS = """SELECT * FROM (VALUES (1, 'The plastic moment', 'plastic moment', 'exact'), (2, 'about 1,200 psi', '1200', 'numeric'), (3, '10', '10:1', 'exact'), (4, '', 'x', 'exact'), (5, 'Grade 50', 'G', 'exact'), (6, '0', '0', 'numeric'),
 (7, 'complete-joint-penetration weld', 'complete joint penetration', 'exact'), (8, 'FEMA P-361', '361', 'numeric'), (9, '103', '100', 'numeric'), (10, '101.9', '100', 'numeric'), (11, 'none given', '5', 'numeric'), (12, 'x', '', 'exact'), (13, '2.9e4 ksi', '29000', 'numeric')) AS t(id, answer, gold, kind)"""


def answers(spark):
    return values(spark, ANSWERS)


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false), (6, true), (7, true), (8, true), (9, false), (10, false), (11, false), (12, false), (13, false)) t(id, ok)")
def exact_match(spark, sf_dir):
    """Equal or contained in answer form; expected verdicts in the oracle."""
    return answers(spark).select("id", scoring.exact_match(F.col("answer"), F.col("gold")).alias("ok"))


@query("SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, false), (5, false), (6, true), (7, false), (8, true), (9, false), (10, true), (11, false), (12, false), (13, true)) t(id, ok)")
def numeric_match(spark, sf_dir):
    """First numbers within 2%."""
    return answers(spark).select("id", scoring.numeric_match(F.col("answer"), F.col("gold")).alias("ok"))


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, false), (6, true), (7, true), (8, true), (9, false), (10, true), (11, false), (12, false), (13, true)) t(id, ok)")
def qa_correct(spark, sf_dir):
    """By value for numeric golds and ratios to one, else by text."""
    return answers(spark).select("id", scoring.qa_correct(F.col("answer"), F.col("gold"), F.col("kind")).alias("ok"))


CITED = """SELECT * FROM (VALUES (1, 'as in [a:p1:c0] and [ b:p2:c1 ]', array('a:p1:c0', 'b:p2:c1')), (2, 'as in [z:p1:c0]', array('a:p1:c0')), (3, 'nothing', array('a:p1:c0')), (4, '[a:p1:c0] [a:p1:c0]', array('a:p1:c0'))) AS t(id, answer, given)"""


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true)) t(id, ok)")
def citations_valid(spark, sf_dir):
    """Some citation, and none that was not given."""
    return values(spark, CITED).select("id", scoring.citations_valid(F.col("answer"), F.col("given")).alias("ok"))


KINDS = """SELECT * FROM (VALUES (1, 'which page shows it?', 'page 12', 'exact'), (2, 'What is the limit?', '12 ft', 'numeric'), (3, 'which document?', 'FEMA P-361', 'numeric'), (4, 'which clause?', '5.4.2.3', 'exact'), (5, 'name the method', 'beam analogy', 'exact'), (6, 'what ratio?', '10:1', 'exact'),
 (7, 'range?', '10 to 12', 'exact'), (8, 'Which equation applies?', 'B-28', 'exact'), (9, 'describe', 'one two three four five six', 'exact'), (10, 'how many pages', '300', 'numeric')) AS t(id, q, a, t)"""


@query("""SELECT * FROM (VALUES (1, 'locator_answer', 'other'), (2, NULL, 'number'), (3, NULL, 'identifier'), (4, NULL, 'identifier'), (5, NULL, 'term'), (6, NULL, 'number'), (7, NULL, 'other'), (8, 'locator_equation_number', 'other'), (9, NULL, 'other'), (10, 'locator_ask', 'number')) t(id, locator, kind)""")
def answer_kind(spark, sf_dir):
    """Locators and kinds of answers."""
    return values(spark, KINDS).select("id", scoring.locator(F.col("q"), F.col("a")).alias("locator"), scoring.answer_kind(F.col("a"), F.col("t")).alias("kind"))


GOLDS = """SELECT * FROM (VALUES (1, 'beam analogy', 'The beam analogy is used.'), (2, '50 percent', 'limit is 50.0 units'), (3, 'check the weld then grind the toe and paint both sides twice', 'grind the weld toe, check it, and paint sides'), (4, '', 'x'), (5, '7 ft', 'at 7 m'), (6, '1,200 psi', 'a strength of 1200 psi')) AS t(id, gold, passage)"""


@query("SELECT * FROM (VALUES (1, true, 0), (2, true, 0), (3, true, 0), (4, false, 0), (5, false, 0), (6, true, 0)) t(id, present, ungrounded)")
def gold_present(spark, sf_dir):
    """Whether passages state an answer, and numbers they don't have."""
    return values(spark, GOLDS).select("id", scoring.gold_present(F.col("gold"), F.col("passage")).alias("present"), F.size(scoring.ungrounded_numbers(F.col("gold"), F.col("passage"))).alias("ungrounded"))


IN_PASSAGE = "SELECT * FROM (VALUES (1, 'Stirrups', 'each stirrup is bent'), (2, 'Reduced Beam Section (RBS)', 'the RBS connection'), (3, 'gas', 'gasket'), (4, 'web', 'cobweb'), (5, 'c++', 'in c++ only')) AS t(id, term, passage)"


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, true)) t(id, ok)")
def term_in_passage(spark, sf_dir):
    """Terms as whole tokens, plural aside."""
    return values(spark, IN_PASSAGE).select("id", scoring.term_in_passage(F.col("term"), F.col("passage")).alias("ok"))


STRICT = """SELECT * FROM (VALUES (1, '10 ft', '10 ft', 'value'), (2, '800 ksi', '800 psi', 'value'), (3, '10 to 15 ft', '10 ft', 'value'), (4, 'Section', 'Section 17.8.2', 'identifier'), (5, 'Article 17.8.2', 'Section 17.8.2', 'identifier'), (6, 'Level III operations', 'Level III', 'term'), (7, 'cripple wall, shear wall', 'shear wall', 'term'),
 (8, '1996', '2010', 'value'), (9, '8x19', '8 x 19', 'value'), (10, 'ten', '10', 'number'), (11, '10', '10:1', 'other'), (12, '100 mm', '100 mm (4 in.)', 'value'), (13, 'EM', 'EM 1110-2-2400', 'identifier'), (14, '5 ft and 9 ft', '5 ft', 'value'), (15, '', 'x', 'term')) AS t(id, answer, gold, kind)"""


@query("SELECT * FROM (VALUES (1, NULL), (2, 'unit'), (3, 'two_candidates'), (4, 'phrase'), (5, NULL), (6, NULL), (7, 'two_candidates'), (8, 'missing_number'), (9, NULL), (10, NULL), (11, NULL), (12, NULL), (13, 'phrase'), (14, 'conflict'), (15, 'phrase')) t(id, reason)")
def strict_check(spark, sf_dir):
    """Reasons of the strict check; expected ones in the oracle."""
    return values(spark, STRICT).select("id", strict.strict_reason(F.col("answer"), F.col("gold"), F.col("kind")).alias("reason"))


@query("SELECT doc_id, round((CASE WHEN quality = 1 THEN 0.1 ELSE 0 END) + (CASE WHEN quality = 1 AND toxic = 0 THEN 0.9 ELSE 0 END) - 0.1 * least(1.0, greatest(0.0, (doc_id % 300 - 192) / 64.0)), 7) AS reward FROM labels")
def reward(spark, sf_dir):
    """Rewards of format, correctness and length; labels stand for verdicts."""
    return table(spark, sf_dir, "labels").select("doc_id", F.round(scoring.reward(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 300), 7).alias("reward"))


GRADES = """SELECT * FROM (VALUES (1, map('clear', 5, 'true', 5), map('vague', false), map('a', true)), (2, map('clear', 9, 'true', 4), map('vague', true), map('a', true)), (3, map('clear', 5, 'true', 5), map('vague', false), map('a', false)), (4, map('clear', 0), map('vague', false), map('a', true))) AS t(id, p, f, h)"""


@query("SELECT * FROM (VALUES (1, 5.0::DOUBLE, true), (2, 3.833333::DOUBLE, false), (3, 5.0::DOUBLE, false), (4, 1.0::DOUBLE, false)) t(id, score, ok)")
def grade(spark, sf_dir):
    """Judge replies: clamped weighted means less penalties."""
    g = scoring.grade(F.col("p"), {"clear": 1.0, "true": 2.0}, F.col("f"), {"vague": 1.0}, F.col("h"))
    return values(spark, GRADES).select("id", g["score"].alias("score"), g["ok"].alias("ok"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN toxic = 1 AND quality = 0 THEN NULL WHEN toxic = 1 THEN 1.0 ELSE 3.0 + quality END::DOUBLE AS score FROM labels")
def effective_score(spark, sf_dir):
    """Floors and nulls of scores."""
    s = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(None)).otherwise(3.0 + F.col("quality"))
    return table(spark, sf_dir, "labels").select("doc_id", scoring.effective_score(F.col("doc_id") % 7 != 0, F.col("toxic") == 0, s).cast("double").alias("score"))


# Events stand for sampled answers: a user is a task, its events are samples, the type is the answer, values above 50 are right.
SAMPLES = "s AS (SELECT user_id AS item, event_id AS ord, event_type AS answer, value > 50 AS correct FROM events)"


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("ord"), F.col("event_type").alias("answer"), (F.col("value") > 50).alias("correct"))


@query(f"WITH {SAMPLES}, p AS (SELECT item, avg(correct::INT) AS m, max(correct::INT) AS b FROM s GROUP BY item) SELECT count(*) AS items, round(avg(m), 6) AS pass_1, round(avg(b), 6) AS pass_k, round(stddev_samp(b) / sqrt(count(*)), 6) AS se FROM p")
def pass_at_k(spark, sf_dir):
    return scoring.pass_at(samples(spark, sf_dir), "item", "correct")


@query(f"WITH {SAMPLES}, c AS (SELECT item, answer, count(*) AS c, min(ord) AS seen FROM s GROUP BY ALL) SELECT item, arg_max(answer, (c, -seen)) AS vote FROM c GROUP BY item")
def majority_vote(spark, sf_dir):
    """The most frequent answer, ties to the earliest."""
    return scoring.majority(samples(spark, sf_dir), "item", "answer", "ord")


@query(f"WITH {SAMPLES}, f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ord) AS i FROM s), k AS (SELECT item, sum(correct::INT)::BIGINT AS right_ FROM f WHERE i <= 8 GROUP BY item HAVING count(*) = 8) SELECT item, right_ FROM k WHERE right_ BETWEEN 1 AND 7")
def difficulty_window(spark, sf_dir):
    """Tasks with some but not all of eight samples right."""
    f = samples(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("item").orderBy("ord"))).where("i <= 8")
    return f.groupBy("item").agg(F.sum(F.col("correct").cast("long")).alias("right_"), F.count("*").alias("n")).where("n = 8 AND right_ BETWEEN 1 AND 7").select("item", "right_")


@query(f"WITH {SAMPLES}, k AS (SELECT item, sum(correct::INT)::BIGINT AS right_ FROM s GROUP BY item) SELECT right_, count(*) AS tasks FROM k GROUP BY right_")
def probe_histogram(spark, sf_dir):
    """How many tasks have how many right samples."""
    k = samples(spark, sf_dir).groupBy("item").agg(F.sum(F.col("correct").cast("long")).alias("right_"))
    return k.groupBy("right_").agg(F.count("*").alias("tasks"))


@query("""WITH v AS (SELECT user_id AS id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord FROM events), w AS (SELECT id, bool_or(event_type = 'error') AS same, sum((event_type IN ('click', 'view'))::INT) AS wa, sum((event_type IN ('purchase', 'signup'))::INT) AS wb FROM v WHERE ord <= 2 GROUP BY id)
  SELECT id, CASE WHEN same THEN 0.5 WHEN wa = 2 THEN 1.0 WHEN wb = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS outcome FROM w""")
def pairwise_outcome(spark, sf_dir):
    """Verdicts in both orders."""
    v = table(spark, sf_dir, "events").withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("ord <= 2")
    t = F.col("event_type")
    return scoring.pairwise_outcome(v.select(F.col("user_id").alias("id"), "ord", F.when(t.isin("click", "view"), "a").when(t.isin("purchase", "signup"), "b").alias("winner"), (t == "error").alias("same")))


SQL_SCORED = "s AS (SELECT user_id AS prompt, event_id AS id, props AS text, (event_id % 40 + 10)::BIGINT AS n_tokens, value / 20.0 AS score, value > 50 AS correct, sha256(user_id || ':' || event_id) AS h FROM events)"


def sql_round(k: int, rest: str) -> str:
    return f"""p{k} AS (SELECT c.prompt, min({{'a': c.h, 'b': r.h, 'c': c.id, 'd': r.id}}) AS p FROM {rest} c JOIN {rest} r ON c.prompt = r.prompt AND c.correct AND c.score - r.score >= 2.0 AND c.text <> r.text AND c.n_tokens <= 1.5 * r.n_tokens GROUP BY c.prompt)"""


@query(f"""WITH {SQL_SCORED}, {sql_round(1, 's')}, s2 AS (SELECT * FROM s WHERE id NOT IN (SELECT p.c FROM p1 UNION ALL SELECT p.d FROM p1)), {sql_round(2, 's2')}
  SELECT prompt, 1 AS round, p.c AS chosen, p.d AS rejected FROM p1 UNION ALL SELECT prompt, 2, p.c, p.d FROM p2""")
def preference_pairs(spark, sf_dir):
    """Two rounds of pairs for each prompt."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt"), F.col("event_id").alias("id"), F.col("props").alias("text"), (F.col("event_id") % 40 + 10).alias("n_tokens"), (F.col("value") / 20.0).alias("score"), (F.col("value") > 50).alias("correct"))
    return scoring.preference_pairs(e)


@query("""WITH v AS (SELECT event_type AS metric, user_id % 3 AS half, avg(value) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL) SELECT metric, round(max(m) FILTER (half = 0), 6) AS seen, round(max(m) FILTER (half = 1), 6) AS unseen, round(max(m) FILTER (half = 2), 6) AS late FROM v GROUP BY metric""")
def kpi_table(spark, sf_dir):
    """Long results turned wide, one row a metric; a metric without items has no row."""
    v = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("half")).agg(F.avg("value").alias("m"))
    side = lambda k, n: F.round(F.max(F.when(F.col("half") == k, F.col("m"))), 6).alias(n)
    return v.groupBy("metric").agg(side(0, "seen"), side(1, "unseen"), side(2, "late"))


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS kept, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS pct FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def rates_by_key(spark, sf_dir):
    """Kept of all, by language, by source and by both."""
    d = table(spark, sf_dir, "labels").join(docs_(spark, sf_dir).select("doc_id", "lang", "source"), "doc_id")
    kept = F.count_if(F.col("quality") == 1)
    return d.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"), kept.alias("kept"), F.round(100.0 * kept / F.count("*"), 6).alias("pct"))


@query("SELECT event_type, avg(CASE WHEN value > 1e9 THEN value END) AS never, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def empty_bucket_mean(spark, sf_dir):
    """A metric without scored items is null, not 0."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.when(F.col("value") > 1e9, F.col("value"))).alias("never"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH l AS (SELECT event_type AS run, user_id % 4 AS line, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE avg(value) - 50 END AS delta FROM events GROUP BY ALL), v AS (SELECT run, bool_or(abs(delta) > 1.5) AS bad, bool_or(delta IS NULL) AS open FROM l GROUP BY run) SELECT run, CASE WHEN coalesce(bad, false) THEN 'fails' WHEN open THEN 'incomplete' ELSE 'passes' END AS verdict FROM v""")
def quality_gate(spark, sf_dir):
    """Runs against their limits."""
    line = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 4).alias("line")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return scoring.quality_gate(line.select("run", F.when(F.col("n") % 5 != 0, F.col("m") - 50).alias("delta"), F.lit(1.5).alias("floor")))


SQL_CURVE = "c AS (SELECT event_type AS run, (event_id // 500)::BIGINT AS step, round(avg(value), 6) AS value, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM events GROUP BY ALL)"


def curve(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.floor(F.col("event_id") / 500).alias("step"))
    return e.agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 6).alias("se"))


@query(f"WITH {SQL_CURVE}, b AS (SELECT run, arg_max({{'v': value, 's': se}}, (value, -step)) AS b FROM c GROUP BY run) SELECT run, min(step) AS step FROM c JOIN b USING (run) WHERE value >= b.v - b.s GROUP BY run")
def checkpoint_pick(spark, sf_dir):
    """The earliest step within one standard error of the best."""
    return scoring.checkpoint_within_error(curve(spark, sf_dir))


# --- statistics ---------------------------------------------------------------------------------------------------------

DRAWS = 200
SQL_INDEX = "('0x' || left(md5(draw || ':' || slot), 8))::BIGINT % n"


@query(f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, (quality - toxic)::DOUBLE AS d FROM labels), c AS (SELECT count(*) AS n FROM d), p AS (SELECT draw, slot, {SQL_INDEX} AS i FROM c, range({DRAWS}) a(draw), range((SELECT n FROM c)) b(slot)),
  m AS (SELECT draw, round(avg(d), 9) AS m FROM p JOIN d USING (i) GROUP BY draw), o AS (SELECT list_sort(list(m)) AS ms FROM m) SELECT (SELECT n FROM c) AS n, (SELECT round(avg(d), 6) FROM d) AS mean, round(ms[6], 6) AS low, round(ms[195], 6) AS high FROM o""")
def paired_bootstrap(spark, sf_dir):
    """Interval of a mean paired difference from 200 resamples."""
    d = stats.numbered(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("d")), "doc_id")
    return stats.paired_bootstrap(d, DRAWS)


@query(f"""WITH g AS (SELECT source, sum(n_chars)::DOUBLE AS num, count(*)::DOUBLE AS den FROM documents GROUP BY source), d AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, num, den FROM g), c AS (SELECT count(*) AS n FROM d), p AS (SELECT draw, slot, {SQL_INDEX} AS i FROM c, range({DRAWS}) a(draw), range((SELECT n FROM c)) b(slot)),
  m AS (SELECT draw, round(sum(num) / sum(den), 9) AS m FROM p JOIN d USING (i) GROUP BY draw), o AS (SELECT list_sort(list(m)) AS ms FROM m) SELECT round(ms[6], 6) AS low, round(ms[195], 6) AS high FROM o""")
def ratio_bootstrap(spark, sf_dir):
    """Interval of a ratio of sums over sources drawn whole."""
    g = docs_(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").cast("double").alias("num"), F.count("*").cast("double").alias("den"))
    return stats.ratio_bootstrap(g.select((F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("i"), "num", "den"), DRAWS)


@query("SELECT event_type, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM events GROUP BY event_type")
def standard_error(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 6).alias("se"))


@query("WITH a AS (SELECT event_type, avg((value > 50)::INT) AS p, count(*) AS n, avg((value > 50)::INT) FILTER (user_id % 2 = 0) AS x, avg((value > 50)::INT) FILTER (user_id % 2 = 1) AS y FROM events GROUP BY event_type) SELECT event_type, round(greatest(abs(x - y), sqrt(p * (1 - p) / n)), 6) AS floor_ FROM a")
def noise_floor(spark, sf_dir):
    """The larger of two seeds' gap and the binomial error."""
    ok = (F.col("value") > 50).cast("double")
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(ok).alias("p"), F.count("*").alias("n"), F.avg(F.when(F.col("user_id") % 2 == 0, ok)).alias("x"), F.avg(F.when(F.col("user_id") % 2 == 1, ok)).alias("y"))
    return a.select("event_type", stats.noise_floor(F.col("x"), F.col("y"), F.col("p"), F.col("n")).alias("floor_"))


@query("""WITH s AS (SELECT source, count(quality) AS n, count(*) FILTER (quality = 1) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source), x AS (SELECT source, n, k, k / nullif(n, 0) AS p, 1.96 * 1.96 AS zz FROM s)
  SELECT source, coalesce(round((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 6), 0.0) AS low, coalesce(round((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 6), 0.0) AS high FROM x""")
def wilson(spark, sf_dir):
    """Intervals of the share of good documents by source."""
    s = docs_(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return s.select("source", stats.wilson(F.col("k"), F.col("n")).alias("w")).select("source", "w.low", "w.high")


@query("""WITH r AS (SELECT d.n_chars, quality, rank() OVER (ORDER BY d.n_chars) + (count(*) OVER (PARTITION BY d.n_chars) - 1) / 2.0 AS rk FROM labels JOIN documents d USING (doc_id)), p AS (SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, sum(rk) FILTER (quality = 1) AS s FROM r)
  SELECT positives, negatives, round((s - positives * (positives + 1) / 2.0) / (positives * negatives), 6) AS auroc FROM p""")
def auroc_labels(spark, sf_dir):
    """How well length tells good documents, against mid-ranks."""
    r = table(spark, sf_dir, "labels").join(docs_(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    return stats.auroc(r, "n_chars", "quality")


@query("""WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS x, row_number() OVER (PARTITION BY lang ORDER BY length(replace(text, 'e', '')), doc_id) AS y FROM documents) SELECT lang, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY lang""")
def spearman(spark, sf_dir):
    """Correlation of ordinal ranks."""
    d = docs_(spark, sf_dir).select("lang", "doc_id", "n_chars", F.length(F.replace("text", F.lit("e"), F.lit(""))).alias("y"))
    return stats.ordinal_correlation(d, "n_chars", "y", "doc_id", "lang")


@query("SELECT lang, round(corr(n_chars, length(replace(text, 'e', ''))), 6) AS r FROM documents GROUP BY lang")
def pearson(spark, sf_dir):
    return docs_(spark, sf_dir).groupBy("lang").agg(F.round(F.corr("n_chars", F.length(F.replace("text", F.lit("e"), F.lit("")))), 6).alias("r"))


@query("""WITH l AS (SELECT event_type, list_sort(list(value)) AS xs, round(quantile_cont(value, 0.9), 6) AS linear, round(median(value), 6) AS med FROM events GROUP BY event_type)
  SELECT event_type, med, xs[len(xs) // 2 + 1] AS upper, xs[least(len(xs) - 1, floor(0.9 * len(xs)))::BIGINT + 1] AS floor_p90, xs[floor(0.9 * (len(xs) - 1))::BIGINT + 1] AS low_p90, linear FROM l""")
def percentile_variants(spark, sf_dir):
    """Four definitions of a percentile and two of a median."""
    x = F.collect_list("value")
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(x.alias("xs"), F.round(F.percentile("value", 0.9), 6).alias("linear"), F.round(F.median("value"), 6).alias("med"))
    xs = F.col("xs")
    return a.select("event_type", "med", stats.median_upper(xs).alias("upper"), stats.percentile_floor(xs, 0.9).alias("floor_p90"), stats.percentile_low(xs, 0.9).alias("low_p90"), "linear")


@query("SELECT user_id % 8 AS level, round(avg((value <= 60 AND event_type <> 'error')::INT), 6) AS goodput, round(sum(value) / count(*), 6) AS throughput FROM events GROUP BY 1")
def goodput(spark, sf_dir):
    """Share of requests within limits, by level."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 8).alias("level")).agg(F.round(F.avg(((F.col("value") <= 60) & (F.col("event_type") != "error")).cast("int")), 6).alias("goodput"), F.round(F.sum("value") / F.count("*"), 6).alias("throughput"))


@query("""WITH g AS (SELECT user_id % 8 AS level, user_id % 2 AS rep, avg(value) AS m FROM events GROUP BY ALL), h AS (SELECT level // 2 AS config, m FROM g) SELECT config, round(avg(m), 6) AS mean, round((max(m) - min(m)) / avg(m), 6) AS spread FROM h GROUP BY config""")
def repeat_spread(spark, sf_dir):
    """Means over repeated configurations and their relative spread."""
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("level")).agg(F.avg("value").alias("m"))
    return g.groupBy(F.floor(F.col("level") / 2).alias("config")).agg(F.round(F.avg("m"), 6).alias("mean"), F.round((F.max("m") - F.min("m")) / F.avg("m"), 6).alias("spread"))


@query("SELECT arg_max(level, (g, -level)) AS level FROM (SELECT user_id % 8 AS level, round(avg(value), 9) AS g FROM events GROUP BY 1)")
def best_config(spark, sf_dir):
    """The configuration with the best mean, ties to the first."""
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("level")).agg(F.round(F.avg("value"), 9).alias("g"))
    return g.agg(F.max_by("level", F.struct("g", -F.col("level"))).alias("level"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def moving_average(spark, sf_dir):
    return stats.moving_average(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 10).drop("value")


@query("""WITH h AS (SELECT user_id, event_id, (value > 40)::INT AS hit FROM events), i AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM h) SELECT user_id, event_id, (sum(hit) OVER (PARTITION BY user_id, isl ORDER BY event_id))::BIGINT AS streak FROM i""")
def run_length_stop(spark, sf_dir):
    """How long a condition has held, at each event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return stats.runs_since_reset(e, "user_id", "event_id", F.col("value") > 40).drop("value")


@query("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY n) AS best FROM n), a AS (SELECT *, max(CASE WHEN value = best AND value > coalesce(prev, value - 1) THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS peak FROM (SELECT *, lag(best) OVER (PARTITION BY user_id ORDER BY n) AS prev FROM b))
  SELECT user_id, event_id, (n - peak)::BIGINT AS since_best, (n - peak) >= 2 AS stop FROM a""")
def flat_best_stop(spark, sf_dir):
    """Events since a user's best value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return stats.flat_best(e, "user_id", "event_id", "value").drop("value")


@query("WITH g AS (SELECT event_type, user_id, max(value) - min(value) AS spread FROM events GROUP BY ALL) SELECT event_type, round(avg((spread < 20)::INT), 6) AS share, count(*) AS n FROM g GROUP BY ROLLUP (event_type)")
def zero_spread(spark, sf_dir):
    """The share of groups with little spread, by kind and over all."""
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg((F.max("value") - F.min("value")).alias("spread"))
    return g.rollup("event_type").agg(F.round(F.avg((F.col("spread") < 20).cast("int")), 6).alias("share"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT source, median(n_chars) AS med FROM documents GROUP BY source) SELECT doc_id, round(n_chars / nullif(med, 0) - 1, 6) AS relative FROM documents JOIN m USING (source)""")
def relative_to_median(spark, sf_dir):
    """Length against the median of the source."""
    d = docs_(spark, sf_dir).select("doc_id", "source", "n_chars")
    m = d.groupBy("source").agg(F.median("n_chars").alias("med"))
    return d.join(m, "source").select("doc_id", F.round(F.col("n_chars") / F.nullif(F.col("med"), F.lit(0.0)) - 1, 6).alias("relative"))


@query("""WITH m AS (SELECT event_type AS run, round(avg(value), 9) AS x, count(*) AS y FROM events GROUP BY 1) SELECT count(*) AS inversions, round(coalesce(max(abs(a.x - b.x)), 0), 6) AS widest FROM m a JOIN m b ON a.run < b.run AND (a.x - b.x) * (a.y - b.y) < 0""")
def rank_inversions(spark, sf_dir):
    """Pairs of runs that two measures order differently (one row a run)."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 9).alias("x"), F.count("*").alias("y"))
    a, b = m.select(*[F.col(c).alias("a" + c) for c in m.columns]), m.select(*[F.col(c).alias("b" + c) for c in m.columns])
    p = a.join(b, (F.col("arun") < F.col("brun")) & ((F.col("ax") - F.col("bx")) * (F.col("ay") - F.col("by")) < 0))
    return p.agg(F.count("*").alias("inversions"), F.round(F.coalesce(F.max(F.abs(F.col("ax") - F.col("bx"))), F.lit(0.0)), 6).alias("widest"))


@query(f"WITH {SQL_CURVE} SELECT round(median(abs(a.value - b.value)), 6) AS mid, round(max(abs(a.value - b.value)), 6) AS most FROM c a JOIN c b ON a.step = b.step AND a.run = 'click' AND b.run = 'view'")
def curve_comparison(spark, sf_dir):
    """Two logs met on their steps."""
    c = curve(spark, sf_dir)
    gap = F.abs(F.col("a") - F.col("b"))
    p = c.where("run = 'click'").select("step", F.col("value").alias("a")).join(c.where("run = 'view'").select("step", F.col("value").alias("b")), "step")
    return p.agg(F.round(F.median(gap), 6).alias("mid"), F.round(F.max(gap), 6).alias("most"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def in_every_run(spark, sf_dir):
    """Items that every run has."""
    e = table(spark, sf_dir, "events")
    k = e.agg(F.count_distinct("event_type")).first()[0]
    return e.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).where(F.col("kinds") == k)


@query("SELECT source, round(exp(sum(n_chars / 1000.0) / sum(n_chars / 10.0)), 6) AS ppl, round(sum(n_chars / 1000.0) / count(*), 6) AS nats FROM documents GROUP BY source")
def perplexity_table(spark, sf_dir):
    """Summed losses and tokens to perplexities (stand-in losses)."""
    return docs_(spark, sf_dir).groupBy("source").agg(F.round(F.exp(F.sum(F.col("n_chars") / 1000.0) / F.sum(F.col("n_chars") / 10.0)), 6).alias("ppl"), F.round(F.sum(F.col("n_chars") / 1000.0) / F.count("*"), 6).alias("nats"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 10")
def top_orders(spark, sf_dir):
    """Top rows of each group on a table of another kind."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w)).where("i <= 10").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT n_name, l_returnflag, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_discount >= 0.05 GROUP BY ALL")
def revenue_by_nation(spark, sf_dir):
    """A star join with pushed-down filter and partial aggregation."""
    li = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_discount")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "l_returnflag").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
