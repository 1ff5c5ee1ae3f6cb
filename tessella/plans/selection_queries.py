"""Queries for splits, quotas, caps, orders, packing and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import dedup, retrieval, selection

from .corpus_queries import SQL_TOKENS, SQL_WORDS, docs_
from .registry import query, table, values

H = "sha256({0}::VARCHAR)"
SQL_N = "(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')))::BIGINT"


def sized(spark, sf_dir):
    return docs_(spark, sf_dir).select("doc_id", "source", "lang", F.regexp_count("text", F.lit(r"[^ \t\n\r\x0b\x0c]+")).cast("long").alias("n"))


@query("SELECT doc_id, round((('0x' || left(sha256(doc_id::VARCHAR), 16))::UBIGINT)::DOUBLE / 18446744073709551616.0, 12) AS h FROM documents")
def stable_hash(spark, sf_dir):
    """Numbers in [0, 1) that stay with their keys."""
    return docs_(spark, sf_dir).select("doc_id", F.round(T.h01(F.col("doc_id").cast("string")), 12).alias("h"))


@query("SELECT doc_id, substr(sha256(doc_id::VARCHAR), 2, 1) IN ('0','2','4','6','8','a','c','e') AS seen, ['plain', 'formal', 'brief'][1 + floor(('0x' || left(sha256(doc_id::VARCHAR), 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * 3)::INT] AS style FROM documents")
def hash_assignments(spark, sf_dir):
    """A fair coin and a choice among three, each by a key's hash."""
    k = F.col("doc_id").cast("string")
    return docs_(spark, sf_dir).select("doc_id", T.even_byte(k).alias("seen"), T.pick(k, ["plain", "formal", "brief"]).alias("style"))


@query(f"SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}) AS i FROM documents) WHERE i <= 5")
def hash_sample_per_source(spark, sf_dir):
    """Five documents of each source by smallest hash."""
    return selection.top_by_hash(docs_(spark, sf_dir).select("source", "doc_id"), "doc_id", 5, "source")


@query(f"SELECT doc_id FROM documents ORDER BY {H.format('doc_id')} LIMIT 20")
def bounded_top_k(spark, sf_dir):
    """The 20 smallest hashes of all (a bounded sample)."""
    return docs_(spark, sf_dir).select("doc_id").orderBy(selection.hash_order(F.col("doc_id").cast("string"))).limit(20)


@query(f"""WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source, doc_id % 10 = 0 ORDER BY {H.format('doc_id')}) AS i FROM documents)
  SELECT source, CASE WHEN doc_id % 10 <> 0 AND i <= greatest(1, round_even(n * 0.05, 0)) THEN 'val' ELSE 'train' END AS split, count(*) AS docs FROM r GROUP BY ALL""")
def stratified_split(spark, sf_dir):
    """5% of each source to val, half-even; every tenth document is pinned to train."""
    d = docs_(spark, sf_dir).select("doc_id", "source")
    s = selection.stratified_split(d, "doc_id", "source", 0.05, d.where("doc_id % 10 = 0"))
    return s.groupBy("source", "split").agg(F.count("*").alias("docs"))


@query(f"""WITH s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}) <= greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.05, 0)) THEN 'val' ELSE 'train' END AS split FROM documents)
  SELECT source, count(*) FILTER (split = 'train') AS train_docs, count(*) FILTER (split = 'val') AS val_docs, sum(CASE WHEN split = 'train' THEN {SQL_N} ELSE 0 END)::BIGINT AS train_words, sum(CASE WHEN split = 'val' THEN {SQL_N} ELSE 0 END)::BIGINT AS val_words FROM s GROUP BY ROLLUP (source)""")
def split_rollup(spark, sf_dir):
    """Documents and words by source and side, with totals."""
    s = selection.stratified_split(sized(spark, sf_dir), "doc_id", "source")
    side = lambda x, v: F.sum(F.when(F.col("split") == x, v).otherwise(0))
    return s.rollup("source").agg(side("train", F.lit(1)).alias("train_docs"), side("val", F.lit(1)).alias("val_docs"), side("train", F.col("n")).alias("train_words"), side("val", F.col("n")).alias("val_words"))


SQL_FIT = f"""g AS (SELECT lang, source, count(*) AS size, {H.format("lang || ':' || source")} AS h FROM documents GROUP BY ALL), w AS (SELECT lang, round_even(count(*) * 0.05, 0) AS want FROM documents GROUP BY lang),
  c AS (SELECT g.*, want, sum(size) OVER (PARTITION BY lang ORDER BY h) AS cum FROM g JOIN w USING (lang))"""


@query(f"WITH {SQL_FIT} SELECT lang, source, size FROM c WHERE cum - size < want")
def grouped_split(spark, sf_dir):
    """Whole sources go to val, in each language, until 5% of its documents are reached."""
    d = docs_(spark, sf_dir)
    g = d.groupBy("lang", "source").agg(F.count("*").alias("size"))
    g = g.withColumn("want", F.bround(F.sum("size").over(Window.partitionBy("lang")) * 0.05, 0))
    return selection.take_groups(g, "size", F.col("want"), [selection.hash_order("lang", "source")], "lang").select("lang", "source", "size")


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {H.format('doc_id')}) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  SELECT lang, CASE WHEN i <= 10 THEN 'judge' WHEN i <= 10 + greatest(1, round_even((n - 10) * 0.05, 0)) THEN 'val' ELSE 'train' END AS part, count(*) AS docs FROM r GROUP BY ALL""")
def three_way_split(spark, sf_dir):
    """Ten documents of each language to judge, 5% of the rest to val."""
    w = Window.partitionBy("lang")
    r = docs_(spark, sf_dir).select("lang", F.row_number().over(w.orderBy(F.sha2(F.col("doc_id").cast("string"), 256))).alias("i"), F.count("*").over(w).alias("n"))
    part = F.when(F.col("i") <= 10, "judge").when(F.col("i") <= 10 + F.greatest(F.lit(1), F.bround((F.col("n") - 10) * 0.05, 0)), "val").otherwise("train")
    return r.groupBy("lang", part.alias("part")).agg(F.count("*").alias("docs"))


def sql_quota(tie: str, n: int = 37) -> str:
    return f"""WITH w AS (SELECT source, count(*) AS weight, min(doc_id) AS ord FROM documents GROUP BY source), x AS (SELECT *, {n} * weight / sum(weight) OVER () AS x FROM w), f AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, {tie}) AS rk FROM x)
      SELECT source, weight, (f + CASE WHEN rk <= {n} - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f"""


def _weights(spark, sf_dir):
    return docs_(spark, sf_dir).groupBy("source").agg(F.count("*").alias("weight"), F.min("doc_id").alias("ord"))


@query(sql_quota("ord"))
def quota_by_order(spark, sf_dir):
    """37 places by largest remainder, equal remainders in input order."""
    return selection.quotas(_weights(spark, sf_dir), 37, [F.col("ord")]).drop("ord")


@query(sql_quota("source"))
def quota_by_name(spark, sf_dir):
    """The same, equal remainders by name."""
    return selection.quotas(_weights(spark, sf_dir), 37, [F.col("source")]).drop("ord")


@query(f"""WITH q AS ({sql_quota('source')}), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}) AS i FROM documents) SELECT doc_id, r.source FROM r JOIN q ON r.source = q.source WHERE i <= quota""")
def quota_sample(spark, sf_dir):
    """Documents of each source up to its quota, smallest hash first."""
    q = quota_by_name(spark, sf_dir).select("source", "quota")
    d = docs_(spark, sf_dir).select("doc_id", "source").withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(selection.hash_order(F.col("doc_id").cast("string")))))
    return d.join(q, "source").where("i <= quota").select("doc_id", "source")


@query(f"""WITH e AS (SELECT conv_id, min(length(text)) AS c, any_value(role) AS r FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, conv_id % 4 AS stratum FROM e),
  w AS (SELECT stratum, count(*) AS weight FROM s WHERE stratum <> 2 GROUP BY stratum), x AS (SELECT *, 15 * weight / sum(weight) OVER () AS x FROM w), q AS (SELECT stratum, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) <= 15 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM x),
  k AS (SELECT conv_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {H.format('conv_id')}) AS i FROM s WHERE stratum <> 2) SELECT conv_id, stratum FROM k JOIN q USING (stratum) WHERE i <= quota""")
def chat_mixture_quota(spark, sf_dir):
    """15 conversations by quota over the strata that are left after one is excluded."""
    s = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("stratum", F.col("conv_id") % 4).where("stratum <> 2")
    q = selection.quotas(s.groupBy("stratum").agg(F.count("*").alias("weight")), 15, [F.col("stratum")])
    k = s.withColumn("i", F.row_number().over(Window.partitionBy("stratum").orderBy(selection.hash_order(F.col("conv_id").cast("string")))))
    return k.join(q, "stratum").where("i <= quota").select("conv_id", "stratum")


@query("SELECT doc_id, lang, turn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 30")
def round_robin(spark, sf_dir):
    """Languages in turn, 30 documents."""
    return selection.round_robin(docs_(spark, sf_dir).select("doc_id", "lang"), "lang", [F.col("doc_id")], 30)


@query("SELECT doc_id, half, row_number() OVER (ORDER BY rn, half) AS place FROM (SELECT doc_id, half, row_number() OVER (PARTITION BY half ORDER BY doc_id) AS rn FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS half FROM documents WHERE lang IN ('en', 'fr')))")
def interleave(spark, sf_dir):
    """Two halves in turn, then the rest of the longer."""
    d = docs_(spark, sf_dir).where("lang IN ('en', 'fr')").select("doc_id", F.when(F.col("lang") == "en", "a").otherwise("b").alias("half"))
    return selection.interleave(d, "half", [F.col("doc_id")])


@query(f"SELECT doc_id FROM (SELECT doc_id, lang = 'es' AS free, row_number() OVER (PARTITION BY source, lang = 'es' ORDER BY {H.format('doc_id')}) AS i FROM documents) WHERE free OR i <= 12")
def per_group_cap(spark, sf_dir):
    """At most 12 of each source; Spanish ones pass and don't count."""
    d = docs_(spark, sf_dir).select("doc_id", "source", "lang")
    return selection.capped(d, "source", 12, [selection.hash_order(F.col("doc_id").cast("string"))], F.col("lang") == "es").select("doc_id")


@query("WITH o AS (SELECT count(*) AS n FROM documents WHERE lang <> 'en') SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE lang = 'en'), o WHERE i <= floor(n * 0.2 / 0.8) UNION ALL SELECT doc_id FROM documents WHERE lang <> 'en'")
def proportion_cap(spark, sf_dir):
    """English ones make up a fifth of the whole at most, first ids first."""
    d = docs_(spark, sf_dir).select("doc_id", "lang")
    others = d.where("lang <> 'en'")
    keep = int(others.count() * 0.2 / 0.8)
    first = selection.prefix_take(d.where("lang = 'en'").withColumn("one", F.lit(1)), "doc_id", "one", keep)
    return first.select("doc_id").unionByName(others.select("doc_id"))


@query(f"SELECT doc_id, n, (cum - n)::BIGINT AS before FROM (SELECT doc_id, {SQL_N} AS n, sum({SQL_N}) OVER (ORDER BY doc_id) AS cum FROM documents) WHERE cum - n < 50000")
def token_prefix_take(spark, sf_dir):
    """Documents in order until 50,000 words; the crossing one is in."""
    return selection.prefix_take(sized(spark, sf_dir).select("doc_id", "n"), "doc_id", "n", 50_000)


@query(f"""WITH d AS (SELECT doc_id, {SQL_N} + 2 AS n FROM documents), p AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS b FROM d), t AS (SELECT sum(n) // 512 AS full_ FROM d),
  x AS (SELECT doc_id, b, n, unnest(range((b // 512)::BIGINT, ((b + n - 1) // 512 + 1)::BIGINT)) AS w FROM p) SELECT w AS "window", doc_id AS doc, (least(b + n, (w + 1) * 512) - greatest(b, w * 512))::BIGINT AS tokens FROM x, t WHERE w < full_""")
def packed_windows(spark, sf_dir):
    """Words of each document in each window of 512."""
    return selection.packed_windows(sized(spark, sf_dir).select("doc_id", "n"), "doc_id", "n", 512)


@query(f"""WITH d AS (SELECT doc_id, {SQL_N} + 2 AS n FROM documents), p AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS b FROM d), t AS (SELECT sum(n) // 512 AS full_ FROM d),
  x AS (SELECT doc_id, b, n, unnest(range((b // 512)::BIGINT, ((b + n - 1) // 512 + 1)::BIGINT)) AS w FROM p), k AS (SELECT w, doc_id, least(b + n, (w + 1) * 512) - greatest(b, w * 512) AS c FROM x, t WHERE w < full_)
  SELECT w AS "window", arg_max(doc_id, (c, -doc_id)) AS doc, (max(c) >= 461) AS clear FROM k GROUP BY w""")
def window_owner(spark, sf_dir):
    """The document with most of each window, and whether it has 90% of it."""
    w = packed_windows(spark, sf_dir)
    return w.groupBy("window").agg(F.max_by("doc", F.struct("tokens", -F.col("doc"))).alias("doc"), (F.max("tokens") >= 461).alias("clear"))


@query("SELECT DISTINCT round_even(i * 999.0 / 24, 0)::BIGINT AS i FROM range(25) r(i)")
def window_sample(spark, sf_dir):
    """25 evenly spaced places of 1,000."""
    return spark.range(1).select(F.explode(selection.evenly_spaced(1000, 25)).alias("i"))


@query()
def greedy_chunks(spark, sf_dir):
    """Sentences packed into chunks of 128 words (a fold; tested against a sequential version)."""
    return selection.greedy_chunks(docs_(spark, sf_dir), "doc_id", "text", 128)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 7")
def budgeted_equal_cost(spark, sf_dir):
    """A budget of 15 for costs of 2: seven of each source."""
    d = docs_(spark, sf_dir).select("doc_id", "source").withColumn("cost", F.lit(2))
    return selection.budgeted(d, "source", ["doc_id"], "cost", 15, ["doc_id"])


@query()
def budgeted_greedy(spark, sf_dir):
    """Costs of 1 to 3 within 12, too dear ones skipped (a fold; tested against a sequential version)."""
    d = docs_(spark, sf_dir).select("doc_id", "source", (F.col("doc_id") % 3 + 1).alias("cost"))
    return selection.budgeted(d, "source", ["doc_id"], "cost", 12, ["doc_id"])


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1) // 4 AS grp, item_id FROM benchmark")
def groups_of_four(spark, sf_dir):
    """Items in groups of four that share a context."""
    return table(spark, sf_dir, "benchmark").select(F.floor((F.row_number().over(Window.orderBy("item_id")) - 1) / 4).alias("grp"), "item_id")


@query("SELECT source, (2 ** round_even(log2(count(*) * 10 / 150.0), 0))::BIGINT AS batch FROM documents GROUP BY source")
def batch_size(spark, sf_dir):
    """Batch sizes as the nearest power of two."""
    return docs_(spark, sf_dir).groupBy("source").agg(F.pow(F.lit(2.0), F.bround(F.log2(F.count("*") * 10 / 150.0), 0)).cast("long").alias("batch"))


@query(f"""WITH d AS (SELECT l.doc_id, toxic, {H.format('l.doc_id')} AS h FROM labels l), n AS (SELECT least(60, count(*)) AS k FROM d WHERE toxic = 1) SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h) AS i FROM d), n WHERE i <= k""")
def balanced_sample(spark, sf_dir):
    """Up to 60 defects by hash and as many clean rows."""
    d = table(spark, sf_dir, "labels")
    k = min(60, d.where("toxic = 1").count())
    return selection.top_by_hash(d.select("doc_id", "toxic"), "doc_id", k, "toxic")


# --- set operations and first or last of each key -------------------------------------------------------------------------


@query("SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def set_union(spark, sf_dir):
    la = table(spark, sf_dir, "labels")
    return la.where("toxic = 1").select("doc_id").union(la.where("quality = 0").select("doc_id")).distinct()


@query("SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 0")
def set_intersect(spark, sf_dir):
    la = table(spark, sf_dir, "labels")
    return la.where("toxic = 1").select("doc_id").intersect(la.where("quality = 0").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir):
    return docs_(spark, sf_dir).select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT d.doc_id AS id, d.text AS body, NULL AS role FROM documents d WHERE n_chars < 100 UNION ALL SELECT conv_id, text, role FROM conversations")
def union_aligned(spark, sf_dir):
    """Rows of two kinds with aligned columns."""
    a = docs_(spark, sf_dir).where("n_chars < 100").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("body"), "role")
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH c AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, {SQL_WORDS.format('a')} AS wa, {SQL_WORDS.format('b')} AS wb FROM c),
  x AS (SELECT conv_id, unnest(wa) AS t FROM w), y AS (SELECT conv_id, unnest(wb) AS t FROM w), xc AS (SELECT conv_id, t, count(*) AS c FROM x GROUP BY ALL), yc AS (SELECT conv_id, t, count(*) AS c FROM y GROUP BY ALL),
  s AS (SELECT conv_id, sum(least(xc.c, yc.c)) AS s FROM xc JOIN yc USING (conv_id, t) GROUP BY conv_id) SELECT conv_id, round(CASE WHEN greatest(len(wa), len(wb)) > 0 THEN coalesce(s, 0) / greatest(len(wa), len(wb)) ELSE 0.0 END, 6) AS overlap FROM w LEFT JOIN s USING (conv_id)""")
def multiset_overlap(spark, sf_dir):
    """Words in common, with counts, of the first and last turn."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    return retrieval.multiset_overlap(c, "a", "b", ["conv_id"])


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents) WHERE i = 1")
def first_by_key(spark, sf_dir):
    """The longest document of each source, ties to the first."""
    return dedup.first_by(docs_(spark, sf_dir).select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")])


@query("SELECT user_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def cache_first_wins(spark, sf_dir):
    from tessella.sources import io

    return io.first_write_wins(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def cache_last_wins(spark, sf_dir):
    from tessella.sources import io

    return io.last_write_wins(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_partial(spark, sf_dir):
    """What an interrupted job has left to do."""
    from tessella.sources import io

    return io.not_done(docs_(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE d.lang = 'en'")
def prediction_join(spark, sf_dir):
    """Labels met with their documents."""
    return table(spark, sf_dir, "labels").join(docs_(spark, sf_dir).where("lang = 'en'").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def keep_ids(spark, sf_dir):
    return docs_(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT count(*) AS shared FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 2 = 1)")
def disjointness(spark, sf_dir):
    """Two id sets must have nothing in common."""
    d = docs_(spark, sf_dir).select("doc_id")
    return d.where("doc_id % 2 = 0").intersect(d.where("doc_id % 2 = 1")).agg(F.count("*").alias("shared"))


@query("SELECT 'sha256:' || sha256(doc_id::VARCHAR) AS doc_id, text FROM documents WHERE lang = 'es'")
def hosted_copy_refill(spark, sf_dir):
    """Texts joined again to a stripped copy by the digests of their ids."""
    from tessella.sources import io

    d = docs_(spark, sf_dir).where("lang = 'es'").select("doc_id", "text")
    return io.fill_text(io.strip_text(d, "doc_id", ["text"], hide_id=True), d, "doc_id", "text")


@query("SELECT '| ' || source || ' | ' || format('{:,}', count(*)) || ' | ' || format('{:,}', sum(n_chars)::BIGINT) || ' |' AS line FROM documents GROUP BY source")
def markdown_rows(spark, sf_dir):
    """A result table as Markdown."""
    from tessella.sources import io

    t = docs_(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return io.render_markdown(t, ["source", "docs", "chars"])


MARKDOWN = "SELECT * FROM VALUES (1, '# results'), (2, '| run | a | b |'), (3, '| --- | ---: | --- |'), (4, '| x | 1 | 2 |'), (5, '| y | 3 |  |'), (6, 'end') AS t(ord, line)"


@query("SELECT * FROM (VALUES ('x', 'run', 'x'), ('x', 'a', '1'), ('x', 'b', '2'), ('y', 'run', 'y'), ('y', 'a', '3'), ('y', 'b', '')) t(\"row\", \"column\", value)")
def markdown_parse(spark, sf_dir):
    """A Markdown table read as data; expected cells in the oracle."""
    from tessella.sources import io

    return io.parse_markdown(values(spark, MARKDOWN), "ord", "line")


# --- retrieval ----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
SQL_CW = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:\\.[0-9]+)?'), lambda w: w NOT IN (" + _STOP + "))"


@query(f"""WITH q AS (SELECT DISTINCT item_id AS q, unnest({SQL_CW.format('text')}) AS term FROM benchmark), b AS (SELECT doc_id AS doc, {SQL_CW.format('text')} AS w FROM documents), m AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM b),
  p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM b) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  s AS (SELECT q, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), m GROUP BY q, doc)
  SELECT q, doc, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def bm25_top(spark, sf_dir):
    """The five best documents for each test item by BM25."""
    b = retrieval.bm25(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), docs_(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), 5)
    return b.select("q", "doc", F.round("score", 4).alias("score"))


@query(f"""WITH t AS (SELECT doc_id, lang, unnest({SQL_WORDS.format('text')}) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE lang <> 'en'),
  a AS (SELECT term, sum(c)::BIGINT AS tf, count(*) AS df FROM (SELECT term, doc_id, count(*) AS c FROM t WHERE lang = 'en' GROUP BY ALL) GROUP BY term HAVING sum(c) >= 20 AND count(*) >= 3 AND length(term) >= 3),
  r AS (SELECT term, count(DISTINCT doc_id) AS rdf FROM t WHERE lang <> 'en' GROUP BY term) SELECT term, tf, df, round(tf * ln(n / (1 + coalesce(rdf, 0))), 6) AS score FROM a LEFT JOIN r USING (term), n ORDER BY score DESC, term DESC LIMIT 25""")
def tfidf_keywords(spark, sf_dir):
    """The 25 words that mark English documents against the others (a report)."""
    d = docs_(spark, sf_dir)
    return retrieval.keywords(d.where("lang = 'en'"), d.where("lang <> 'en'"), 25)


@query(f"""WITH w AS (SELECT role AS grp, {SQL_WORDS.format('text')} AS w FROM conversations), g AS (SELECT grp, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS g FROM w),
  d AS (SELECT grp, count(DISTINCT g) / count(*) AS distinct_n FROM g GROUP BY grp), u AS (SELECT grp, t, count(*) AS c FROM (SELECT grp, unnest(w) AS t FROM w) GROUP BY ALL), e AS (SELECT grp, -sum(c / tot * log2(c / tot)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY grp) AS tot FROM u) GROUP BY grp)
  SELECT grp, count(*) AS texts, round(any_value(distinct_n), 6) AS distinct_n, round(any_value(entropy), 6) AS entropy, round(avg(len(w)), 6) AS mean_words FROM w LEFT JOIN d USING (grp) LEFT JOIN e USING (grp) GROUP BY grp""")
def distinct4_entropy(spark, sf_dir):
    """Diversity of what each role says."""
    return retrieval.diversity(table(spark, sf_dir, "conversations").select(F.col("role").alias("grp"), "text"))


@query(f"""WITH w AS (SELECT source, {SQL_TOKENS.format('text')} AS w FROM documents) SELECT source, round(sum(list_sum(list_transform(w, lambda x: (length(x) + 3) // 4))) / sum(len(w)), 6) AS fertility FROM w GROUP BY source""")
def fertility(spark, sf_dir):
    """Pieces of a word by source, with a stand-in tokenizer of four characters a piece."""
    w = docs_(spark, sf_dir).select("source", T.tokens(F.col("text")).alias("w"))
    pieces = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.floor((F.length(x) + 3) / 4))
    return w.groupBy("source").agg(F.round(F.sum(pieces) / F.sum(F.size("w")), 6).alias("fertility"))
