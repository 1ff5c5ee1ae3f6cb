"""Queries for question rules, sampled texts, verdicts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import questions as Q
from tessella.operators import containment, selection, stats

from .corpus_queries import SQL_WORDS, docs_
from .registry import query, table, values

ITEMS = """SELECT * FROM (VALUES (1, '', 'x', 'x'), (2, 'On which page is it?', '12', 'page 12'), (3, 'What does the passage say?', 'yes', 'yes'), (4, 'What is the symbol for shear?', 'V', 'V'), (5, 'How long is it?', '12 ft', 'it is 11 ft long'),
 (6, 'What is required?', 'one two three four five six seven', 'x'), (7, 'How long is it?', '12 ft', 'it is 12 ft long'), (8, 'Is a deep beam stiff?', 'deep beam', 'x'), (9, 'Name the angle', 'θmax', 'x'), (10, 'Which journal?', 'X', 'X')) AS t(id, q, a, p)"""


@query("SELECT * FROM (VALUES (1, 'empty'), (2, 'locator'), (3, 'context_bound'), (4, 'trivia'), (5, 'ungrounded_number'), (6, 'long_answer'), (7, NULL), (8, 'trivia'), (9, 'trivia'), (10, 'trivia')) t(id, rule)")
def closed_book_rules(spark, sf_dir):
    """First failing rule of closed-book questions."""
    return values(spark, ITEMS).select("id", Q.closed_book_rule(F.col("q"), F.col("a"), F.col("p")).alias("rule"))


REBUTTED = """SELECT * FROM (VALUES (1, 'What criteria size edge stiffeners?', 'Plates are thin. There are no criteria specified for sizing edge stiffeners.', false), (2, 'What criteria size edge stiffeners?', 'There is no limit on paint.', false), (3, 'q', 'Smith, J. (2004). Title. Vol. 3', true)) AS t(id, q, p, r)"""


@query("SELECT * FROM (VALUES (1, true, false), (2, false, false), (3, false, true)) t(id, rebutted, refs)")
def premise_rebutted(spark, sf_dir):
    """Premises that the passage denies, and reference lists."""
    return values(spark, REBUTTED).select("id", Q.premise_rebutted(F.col("q"), F.col("p")).alias("rebutted"), Q.reference_list(F.col("p")).alias("refs"))


@query("SELECT page_id FROM pages WHERE NOT (contains(lower(url), '.org') OR contains(lower(url), 'blog.'))")
def hand_rejects(spark, sf_dir):
    """Rows that hold none of a short list of strings."""
    r = values(spark, "SELECT * FROM (VALUES ('.org'), ('blog.')) AS t(part)")
    return Q.reviewed_out(table(spark, sf_dir, "pages").select("page_id", "url"), r, "url").select("page_id")


@query(f"""WITH w AS (SELECT conv_id, turn, text, {SQL_WORDS.format('text')} AS w FROM conversations), g AS (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS g FROM w),
 c AS (SELECT conv_id, turn, g, count(*) AS c FROM g GROUP BY ALL), d AS (SELECT conv_id, turn, count(*) / sum(c) AS d, max(c) AS m FROM c GROUP BY ALL), l AS (SELECT conv_id, turn, count(*) - count(DISTINCT trim(x)) AS r FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM w) WHERE trim(x) <> '' GROUP BY ALL)
 SELECT conv_id, turn, round(d, 6) AS distinct_4, coalesce(m, 0)::INT AS max_4gram, coalesce(r, 0)::INT AS repeated_lines, round(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / nullif(length(text), 0), 6) AS ascii_share FROM w LEFT JOIN d USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn)""")
def text_sanity(spark, sf_dir):
    """Repetition and script of sampled texts."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", Q.sanity(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT event_type AS form, count(DISTINCT user_id) AS tasks FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 5")
def stock_phrases(spark, sf_dir):
    """Answers that stand on many tasks."""
    return Q.stock_phrases(table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("text")))


@query("SELECT l.doc_id AS eid, CASE WHEN l.doc_id % 3 <> 0 THEN l.quality END AS verdict FROM labels l")
def verdict_fingerprints(spark, sf_dir):
    """Verdicts count only for the content they were given to."""
    la = table(spark, sf_dir, "labels")
    r = la.select(F.col("doc_id").alias("eid"), F.sha2(F.concat_ws(":", "doc_id", "quality"), 256).alias("fp"))
    v = la.select(F.col("doc_id").alias("eid"), F.sha2(F.concat_ws(":", "doc_id", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("quality"))), 256).alias("fp"), F.col("quality").alias("verdict"))
    return Q.valid_verdicts(r, v).select("eid", "verdict")


@query(f"""WITH s AS (SELECT conv_id AS prompt, turn AS id, {SQL_WORDS.format('text')} AS w FROM conversations), p AS (SELECT a.prompt, a.id AS i, b.id AS j, a.w AS wa, b.w AS wb FROM s a JOIN s b ON a.prompt = b.prompt AND a.id < b.id),
 x AS (SELECT prompt, i, j, t, count(*) AS c FROM (SELECT prompt, i, j, unnest(wa) AS t FROM p) GROUP BY ALL), y AS (SELECT prompt, i, j, t, count(*) AS c FROM (SELECT prompt, i, j, unnest(wb) AS t FROM p) GROUP BY ALL),
 o AS (SELECT prompt, i, j, sum(least(x.c, y.c)) AS s FROM x JOIN y USING (prompt, i, j, t) GROUP BY ALL) SELECT prompt, min(CASE WHEN greatest(len(wa), len(wb)) > 0 THEN coalesce(s, 0) / greatest(len(wa), len(wb)) ELSE 0 END) > 0.05 AS collapsed FROM p LEFT JOIN o USING (prompt, i, j) GROUP BY prompt""")
def sample_collapse(spark, sf_dir):
    """Prompts whose samples all say the same (here: by a low limit)."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("prompt"), F.col("turn").alias("id"), "text")
    return Q.collapsed(c, 0.05)


@query("SELECT * FROM (VALUES (1, 2), (2, 3), (3, 0), (4, 1)) t(id, at)".replace("at)", "place)"))
def first_divergence(spark, sf_dir):
    """Where two sequences part."""
    v = values(spark, "SELECT * FROM (VALUES (1, array(1, 2, 3), array(1, 2, 4)), (2, array(1, 2, 3), array(1, 2, 3)), (3, array(5), array(6)), (4, array(1), array(1, 2))) AS t(id, a, b)")
    return v.select("id", Q.first_divergence(F.col("a"), F.col("b")).alias("place"))


@query("""WITH c AS (SELECT source AS doc, doc_id // 50 AS page, doc_id AS pos, text FROM documents), p AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY pos) AS t FROM c GROUP BY ALL) SELECT pos, md5(t) AS digest FROM c JOIN p USING (doc, page)""")
def page_widening(spark, sf_dir):
    """Chunks with the whole text of their page."""
    c = docs_(spark, sf_dir).select(F.col("source").alias("doc"), F.floor(F.col("doc_id") / 50).alias("page"), F.col("doc_id").alias("pos"), "text")
    return Q.page_text(c).select("pos", F.md5("page_text").alias("digest"))


@query()
def distractor_chunks(spark, sf_dir):
    """For each document one of another source (any fits; tested by its properties)."""
    return Q.distractors(docs_(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("doc")))


@query("""SELECT CASE WHEN source IN ('src0', 'src1') THEN 'withdrawn' WHEN lang = 'de' THEN 'restricted' ELSE source END AS subset, count(*) AS records, count(*) FILTER (quality = 1) AS good FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def licence_audit(spark, sf_dir):
    """Records by subset, with subsets of one kind taken together."""
    d = table(spark, sf_dir, "labels").join(docs_(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")
    subset = F.when(F.col("source").isin("src0", "src1"), "withdrawn").when(F.col("lang") == "de", "restricted").otherwise(F.col("source"))
    return d.groupBy(subset.alias("subset")).agg(F.count("*").alias("records"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""WITH d AS (SELECT doc_id, lang, sha256(doc_id::VARCHAR) AS h, quality FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY h) AS i, count(*) FILTER (quality = 0) OVER (PARTITION BY lang) AS bad FROM d)
 SELECT doc_id, lang FROM r WHERE (quality = 0 AND i <= 10) OR (quality = 1 AND i <= 40 - least(10, bad))""")
def audit_sample(spark, sf_dir):
    """Ten of one kind in each language, filled to forty with the other, by hash."""
    d = table(spark, sf_dir, "labels").join(docs_(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    bad = F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).over(Window.partitionBy("lang"))
    i = F.row_number().over(Window.partitionBy("lang", "quality").orderBy(selection.hash_order(F.col("doc_id").cast("string"))))
    r = d.withColumns({"bad": bad, "i": i})
    return r.where(((F.col("quality") == 0) & (F.col("i") <= 10)) | ((F.col("quality") == 1) & (F.col("i") <= 40 - F.least(F.lit(10), F.col("bad"))))).select("doc_id", "lang")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, (n > 10 AND avg(value) FILTER (i > n - 10) < avg(value) FILTER (i <= 10) / 3) AS fell FROM e GROUP BY user_id, n""")
def fall_detector(spark, sf_dir):
    """The last ten against a third of the first ten."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumns({"i": F.row_number().over(w.orderBy("event_id")), "n": F.count("*").over(w)})
    last, first = F.avg(F.when(F.col("i") > F.col("n") - 10, F.col("value"))), F.avg(F.when(F.col("i") <= 10, F.col("value")))
    return e.groupBy("user_id", "n").agg(last.alias("l"), first.alias("f")).select("user_id", ((F.col("n") > 10) & (F.col("l") < F.col("f") / 3)).alias("fell"))


@query("""WITH m AS (SELECT event_type AS arm, user_id, avg(value) AS m FROM events GROUP BY ALL), k AS (SELECT user_id FROM m WHERE arm IN ('click', 'view') GROUP BY user_id HAVING count(*) = 2) SELECT arm, round(avg(m), 6) AS mean, count(*) AS items FROM m JOIN k USING (user_id) WHERE arm IN ('click', 'view') GROUP BY arm""")
def arm_gap(spark, sf_dir):
    """Means of two arms over the items both have."""
    m = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").groupBy(F.col("event_type").alias("arm"), "user_id").agg(F.avg("value").alias("m"))
    k = m.groupBy("user_id").agg(F.count("*").alias("c")).where("c = 2").select("user_id")
    return m.join(k, "user_id", "left_semi").groupBy("arm").agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("items"))


@query("""WITH m AS (SELECT event_type AS run, avg(value) AS v, sqrt(var_samp(value) / count(*)) AS se FROM events GROUP BY 1) SELECT a.run, round(a.v - b.v, 6) AS delta, round(greatest(a.se, b.se), 6) AS noise FROM m a JOIN m b ON b.run = 'view' AND a.run <> 'view'""")
def delta_to_reference(spark, sf_dir):
    """Each run's change against a reference run, beside the noise."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("v"), F.sqrt(F.var_samp("value") / F.count("*")).alias("se"))
    ref = m.where("run = 'view'").select(F.lit(1).alias("one"), F.col("v").alias("rv"), F.col("se").alias("rse"))
    return m.where("run <> 'view'").withColumn("one", F.lit(1)).join(ref, "one").select("run", F.round(F.col("v") - F.col("rv"), 6).alias("delta"), F.round(F.greatest("se", "rse"), 6).alias("noise"))


@query("""WITH r AS (SELECT lang, n_chars, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM labels JOIN documents USING (doc_id)), p AS (SELECT lang, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, sum(rk) FILTER (quality = 1) AS s FROM r GROUP BY lang)
 SELECT lang, positives, negatives, round((s - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 6) AS auroc FROM p""")
def judge_benchmark(spark, sf_dir):
    """How well a score tells defects, by stratum."""
    d = table(spark, sf_dir, "labels").join(docs_(spark, sf_dir).select("doc_id", "lang", "n_chars"), "doc_id")
    return stats.auroc(d, "n_chars", "quality", "lang")


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'), p AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant')
 SELECT q.id AS q, min(p.id) AS p FROM q JOIN p ON contains(p.t, q.t) WHERE q.t <> '' AND len({SQL_WORDS.format('q.t')}) >= 4 GROUP BY q.id""")
def question_in_prompt(spark, sf_dir):
    """Questions of four words or more that stand in a prompt: a join on their inner words first, then containment."""
    c = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.sql_squash(F.col("text")).alias("t"))
    return containment.contained_in(c.where("role = 'user'").select(F.col("id").alias("q"), "t"), c.where("role = 'assistant'").select(F.col("id").alias("p"), "t"))


@query("""WITH d AS (SELECT doc_id, source, sha256(doc_id::VARCHAR) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS i FROM documents) SELECT doc_id, source FROM d WHERE i <= 4 ORDER BY h LIMIT 15""")
def capped_take(spark, sf_dir):
    """Fifteen documents by hash, four of a source at most."""
    return selection.capped_take(docs_(spark, sf_dir).select("doc_id", "source"), "doc_id", "source", 4, 15)


@query("SELECT doc_id, toxic FROM labels ORDER BY toxic DESC, sha256(doc_id::VARCHAR) LIMIT 30")
def priority_take(spark, sf_dir):
    """Thirty labelled rows, those of one kind first."""
    return selection.priority_take(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", F.col("toxic") == 1, 30)


@query("""WITH o AS (SELECT doc_id AS id, quality AS verdict FROM labels), n AS (SELECT doc_id AS id, toxic AS verdict FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id + 1000000, 0 FROM labels WHERE quality = 0)
 SELECT id, CASE WHEN n.id IS NULL THEN o.verdict ELSE n.verdict END AS verdict, CASE WHEN n.id IS NOT NULL THEN o.verdict END AS previous FROM o FULL JOIN n USING (id)""")
def verdict_override(spark, sf_dir):
    """New verdicts take the place of old ones, which are kept beside them."""
    la = table(spark, sf_dir, "labels")
    new = la.where("toxic = 1").select(F.col("doc_id").alias("id"), F.col("toxic").alias("verdict"))
    new = new.unionByName(la.where("quality = 0").select((F.col("doc_id") + 1_000_000).alias("id"), F.lit(0).alias("verdict")))
    return Q.overridden(la.select(F.col("doc_id").alias("id"), F.col("quality").alias("verdict")), new)


@query("""SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'error'), 6) AS error FROM events GROUP BY user_id HAVING count(*) FILTER (event_type IN ('click', 'view', 'error')) > 0""")
def result_table(spark, sf_dir):
    """One row a run with a column a metric; runs without any are left out."""
    names = ["click", "view", "error"]
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(names))
    return e.groupBy("user_id").pivot("event_type", names).agg(F.round(F.avg("value"), 6))
