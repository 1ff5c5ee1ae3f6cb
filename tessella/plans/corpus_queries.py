"""Queries over documents, pages and conversations: quality, duplicates, personal data, links, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import dedup, overlap, pii, quality, retrieval

from .registry import query, table, values

#: Parameters that fit the test tables: paragraphs are lines, and few documents are long.
MIN_WORDS = 50
SQL_LINES = "lines AS (SELECT doc_id, source, lang, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents))"
SQL_TOKENS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\x0b\\x0c\\x{{a0}}]+'), lambda w: w <> '')"
SQL_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
SQL_GRAMS = "list_transform(range(1, greatest(len({0}) - {1} + 2, 1)), lambda i: array_to_string(list_slice({0}, i, i + {1} - 1), ' '))"


def docs_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def sql_rule(col: str) -> str:
    """The paragraph rules on one line of text in SQL (line rules need three lines and are left out)."""
    w = SQL_TOKENS.format(col)
    solid = f"length(regexp_replace({col}, '[\\s\\x{{a0}}]', '', 'g'))"
    return f"""CASE WHEN len({w}) = 0 THEN NULL
      WHEN length(regexp_replace({col}, '[^\\p{{L}}]', '', 'g')) / {solid} < 0.6 THEN 'alpha_ratio'
      WHEN {solid} / len({w}) < 3 OR {solid} / len({w}) > 12 THEN 'word_length'
      WHEN len(regexp_extract_all({col}, '\\.{{3,}}|_{{3,}}|[|…—•■□▪]')) / len({w}) > 0.15 THEN 'symbol_ratio'
      WHEN regexp_matches({col}, '\\((?:19|20)[0-9][0-9][a-z]?\\)|\\bpp\\.') THEN 'reference_list' END"""


@query(f"WITH {SQL_LINES} SELECT lang, coalesce({sql_rule('line')}, 'kept') AS rule, count(*) AS n, sum(len({SQL_TOKENS.format('line')}))::BIGINT AS n_words FROM lines WHERE trim(line) <> '' GROUP BY 1, 2")
def quality_rule_funnel(spark, sf_dir):
    """Paragraphs and words by language and first failing rule."""
    p = quality.paragraphs(docs_(spark, sf_dir).select("doc_id", "lang", "text"))
    p = p.select("lang", F.coalesce(quality.paragraph_rule(F.col("para")), F.lit("kept")).alias("rule"), F.size(T.tokens(F.col("para"))).alias("w"))
    return p.groupBy("lang", "rule").agg(F.count("*").alias("n"), F.sum("w").alias("n_words"))


BLOCKS = """SELECT * FROM VALUES
 (1, 'One plain paragraph of ordinary words that wraps\nover two lines of text.'), (2, 'a b\nc d\ne f\ng h'), (3, 'Introduction to the method\n1. first\n2. second\n3. third\nAll of these items are described in the following chapters of the text as the reader will see'),
 (4, '. . . 12 34 56 78 90'), (5, 'Supercalifragilistic Pneumonoultramicroscopic'), (6, 'Smith and others wrote it (2004)\nJones wrote another one with care pp. 3\nBoth are held in the library now\nand are listed here'), (7, 'Chapter one ......... page Chapter two ......... page three'), (8, '1.\nThe marker above belongs to this item and so this is prose')
 AS t(id, para)"""


@query("SELECT * FROM (VALUES (1, NULL), (2, 'word_length'), (3, 'numbered_lines'), (4, 'alpha_ratio'), (5, 'word_length'), (6, 'reference_list'), (7, 'symbol_ratio'), (8, NULL)) t(id, rule)")
def quality_block_rules(spark, sf_dir):
    """All six rules on blocks of several lines; the expected verdicts are stated in the oracle."""
    return values(spark, BLOCKS).select("id", quality.paragraph_rule(F.col("para")).alias("rule"))


@query(f"""WITH dict AS (SELECT w FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM documents) GROUP BY w HAVING count(*) >= 20),
  t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
  k AS (SELECT w, bool_or(length(w) - s >= 2 AND left(w, length(w) - s) IN (SELECT w FROM dict)) AS known FROM (SELECT DISTINCT w FROM t), range(4) r(s) GROUP BY w),
  r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (known) AS kn FROM t JOIN k USING (w) GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n, 0) AS n_words, round_even(coalesce(kn, 0) / greatest(1, coalesce(n, 0)), 3) AS ratio,
   CASE WHEN coalesce(n, 0) < {MIN_WORDS} THEN 'min_words' WHEN round_even(coalesce(kn, 0) / greatest(1, coalesce(n, 0)), 3) < 0.7 THEN 'dictionary' END AS rule FROM documents d LEFT JOIN r USING (doc_id)""")
def document_rules(spark, sf_dir):
    """Document rules with a dictionary of the corpus' own frequent words."""
    d = docs_(spark, sf_dir)
    w = d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    listed = w.groupBy("word").agg(F.count("*").alias("c")).where("c >= 20")
    r = quality.dictionary_ratio(d, listed)
    return r.select("doc_id", "n_words", F.bround("ratio", 3).alias("ratio"), quality.document_rule(F.col("n_words"), F.col("ratio"), MIN_WORDS).alias("rule"))


@query(f"WITH {SQL_LINES}, k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines WHERE trim(line) <> '' AND ({sql_rule('line')}) IS NULL GROUP BY doc_id) SELECT d.doc_id, md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN k USING (doc_id)")
def reassembled_text(spark, sf_dir):
    """Documents joined again from the paragraphs that pass."""
    return quality.keep_paragraphs(docs_(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT source, lang, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def funnel_by_source_rollup(spark, sf_dir):
    """Counts by source and language with subtotals and the total."""
    return docs_(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("""WITH s AS (SELECT 1 AS ord, 'read' AS step, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents
  UNION ALL SELECT 2, 'long enough', count(*), sum(n_chars)::BIGINT FROM documents WHERE n_chars >= 1000
  UNION ALL SELECT 3, 'english', count(*), sum(n_chars)::BIGINT FROM documents WHERE n_chars >= 1000 AND lang = 'en')
  SELECT ord, step, docs, chars, round(100.0 * (1 - chars / lag(chars) OVER (ORDER BY ord)), 6) AS removed FROM s""")
def corpus_funnel(spark, sf_dir):
    """Steps of a funnel with the share each removes."""
    from pyspark.sql.window import Window

    d = docs_(spark, sf_dir)
    step = lambda i, name, x: x.agg(F.lit(i).alias("ord"), F.lit(name).alias("step"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    long_ = d.where("n_chars >= 1000")
    s = step(1, "read", d).unionByName(step(2, "long enough", long_)).unionByName(step(3, "english", long_.where("lang = 'en'")))
    return s.withColumn("removed", F.round(100.0 * (1 - F.col("chars") / F.lag("chars").over(Window.orderBy("ord"))), 6))


SQL_PAGES = "p AS (SELECT source AS doc, doc_id AS page, pos, line FROM lines)"


@query(f"""WITH {SQL_LINES}, {SQL_PAGES}, q AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS i FROM p),
  e AS (SELECT *, regexp_replace(lower(trim(line)), '[0-9]', '#', 'g') AS key FROM q WHERE i <= 3 OR i > n - 3),
  k AS (SELECT doc, key, count(DISTINCT page) AS c FROM e GROUP BY ALL), g AS (SELECT doc, count(DISTINCT page) AS pages FROM p GROUP BY doc HAVING count(DISTINCT page) >= 5)
  SELECT e.doc, e.page, e.pos, md5(e.line) AS digest FROM e JOIN k USING (doc, key) JOIN g USING (doc) WHERE k.c > greatest(2.0, 0.05 * pages)""")
def running_lines(spark, sf_dir):
    """Running headers and footers; a source stands for a document and its documents for pages."""
    lines = docs_(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return quality.running_lines(lines, share=0.05).select("doc", "page", "pos", F.md5("line").alias("digest"))


@query(f"""WITH {SQL_LINES}, b AS (SELECT DISTINCT source AS doc, doc_id AS page, line AS block FROM lines WHERE length(line) < 120), g AS (SELECT source AS doc, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
  SELECT doc, md5(block) AS digest, count(*) AS "on" FROM b JOIN g USING (doc) GROUP BY doc, block, pages HAVING count(*) >= greatest(3.0, 0.05 * pages)""")
def running_blocks(spark, sf_dir):
    """Short blocks on many pages, wherever they stand."""
    b = docs_(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("block"))
    return quality.running_blocks(b, share=0.05).select("doc", F.md5("block").alias("digest"), "on")


@query("SELECT source AS doc, doc_id AS page, sum(length(text))::BIGINT AS chars, CASE WHEN sum(length(text)) = 0 THEN 'image' ELSE 'short' END AS reason FROM documents GROUP BY 1, 2 HAVING sum(length(text)) < 200")
def short_pages(spark, sf_dir):
    """Pages with too little text, and why."""
    return quality.short_pages(docs_(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.col("text").alias("block")))


@query("SELECT source, bool_or(regexp_matches(text, '(?i)copyright|©|all rights reserved')) AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 5 GROUP BY source")
def copyright_flag(spark, sf_dir):
    """A notice on one of the first five pages of a source."""
    from pyspark.sql.window import Window

    d = docs_(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("i <= 5")
    return d.groupBy("source").agg(F.bool_or(F.col("text").rlike(quality.COPYRIGHT)).alias("flagged"))


@query("""SELECT conv_id, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id
  HAVING count(*) = 2 AND arg_min(role, turn) = 'user' AND arg_max(role, turn) = 'assistant' AND sum(length(text)) BETWEEN 1 AND 6000 AND sum(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / sum(length(text)) >= 0.95""")
def chat_eligible(spark, sf_dir):
    """Two-turn chats fit for the mixture."""
    return quality.chat_eligible(table(spark, sf_dir, "conversations"))


@query(f"""WITH w AS (SELECT doc_id, text, {SQL_TOKENS.format('text')} AS w FROM documents) SELECT doc_id, len(w) BETWEEN 100 AND 400 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(text), 0) > 0.6
  AND len(regexp_extract_all(text, '[0-9]+')) >= 1 AND NOT (len(w) > 30 AND len(list_filter(w, lambda x: length(x) <= 2)) / len(w) > 0.45) AS eligible FROM w""")
def passage_eligible(spark, sf_dir):
    """Passages fit to ask questions about."""
    d = docs_(spark, sf_dir)
    return d.select("doc_id", quality.passage_eligible(F.col("text"), F.size(T.tokens(F.col("text"))), 100, 400, 1).alias("eligible"))


# --- duplicates ---------------------------------------------------------------------------------------------------------

SQL_KEY = "sha1(array_to_string(" + SQL_WORDS.format("text") + ", ' '))"


@query(f"WITH k AS (SELECT doc_id, {SQL_KEY} AS key FROM documents), f AS (SELECT key, min(doc_id) AS kept FROM k GROUP BY key) SELECT doc_id AS dropped, kept FROM k JOIN f USING (key) WHERE doc_id <> kept")
def exact_dedup(spark, sf_dir):
    """[dropped, kept] of copies of a text."""
    return dedup.exact_duplicates(docs_(spark, sf_dir))


@query(f"WITH k AS (SELECT doc_id, source, {SQL_KEY} AS key FROM documents) SELECT min(doc_id) AS first_in, count(*) - 1 AS copies_removed, count(DISTINCT source) AS sources, list_sort(list_distinct(list(source))) AS source_list FROM k GROUP BY key HAVING count(*) > 1 ORDER BY copies_removed DESC, first_in LIMIT 10")
def dup_clusters(spark, sf_dir):
    """The ten largest groups of copies (a report)."""
    k = docs_(spark, sf_dir).select("doc_id", "source", dedup.exact_key(F.col("text")).alias("key"))
    g = k.groupBy("key").agg(F.min("doc_id").alias("first_in"), (F.count("*") - 1).alias("copies_removed"), F.count_distinct("source").alias("sources"), F.sort_array(F.collect_set("source")).alias("source_list"))
    return g.where("copies_removed > 0").orderBy(F.col("copies_removed").desc(), "first_in").limit(10).drop("key")


def line_texts(spark, sf_dir) -> DataFrame:
    """Distinct lines of five words or more with their first place as id: identical lines are one, which loses no similarity."""
    lines = docs_(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("id"), F.array_join(T.words(F.col("line")), " ").alias("text"))
    return keyed.where(F.size(F.split("text", " ")) >= 5).groupBy("text").agg(F.min("id").alias("id"))


SQL_NEAR = f"""WITH {SQL_LINES}, t AS (SELECT min(doc_id * 100000 + pos) AS id, array_to_string({SQL_WORDS.format('line')}, ' ') AS text FROM lines GROUP BY 2),
  w AS (SELECT id, string_split(text, ' ') AS w FROM t WHERE len(string_split(text, ' ')) >= 5), s AS (SELECT id, list_distinct({SQL_GRAMS.format('w', 5)}) AS gs FROM w),
  g AS (SELECT id, len(gs) AS n, unnest(gs) AS g FROM s),
  pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS common, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*)))"""


@query(SQL_NEAR + " SELECT * FROM pairs")
def near_dup_pairs(spark, sf_dir):
    """Pairs of lines with a Jaccard similarity of 0.8 or more on word 5-grams, exact."""
    return dedup.similar_pairs(line_texts(spark, sf_dir))


@query(SQL_NEAR + " SELECT DISTINCT b AS id FROM pairs")
def near_dup_any_earlier(spark, sf_dir):
    """Lines with any earlier near copy."""
    return dedup.similar_pairs(line_texts(spark, sf_dir)).select(F.col("b").alias("id")).distinct()


@query()
def near_dup_first_copy(spark, sf_dir):
    """Lines kept when each is held only against kept earlier ones (an iteration; tested against a sequential version)."""
    lines = line_texts(spark, sf_dir)
    return dedup.first_copy_wins(lines, dedup.similar_pairs(lines))


@query()
def lsh_candidates(spark, sf_dir):
    """Candidates of banded min-hashes, 9 bands of 13 (tested for recall against the exact pairs)."""
    return dedup.banded_candidates(line_texts(spark, sf_dir), "id", "text")


@query(f"""WITH w AS (SELECT source AS doc, doc_id AS id, {SQL_WORDS.format('text')} AS w FROM documents), t AS (SELECT doc, id, unnest(list_distinct({SQL_GRAMS.format('w', 8)})) AS g FROM w),
  f AS (SELECT g, arg_min(doc, id) AS owner FROM t GROUP BY g) SELECT id, count(*) AS n, count(*) FILTER (owner <> doc) AS earlier FROM t JOIN f USING (g) GROUP BY id HAVING count(*) >= 20 AND 100 * count(*) FILTER (owner <> doc) >= 90 * count(*)""")
def chunk_overlap_dedup(spark, sf_dir):
    """Chunks whose 8-grams mostly stand earlier in another document."""
    return dedup.cross_chunk_duplicates(docs_(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("id"), "text"))


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM conversations WHERE role = 'user') SELECT k AS question, min(id) AS id, count(*) AS copies FROM q GROUP BY k""")
def question_dedup(spark, sf_dir):
    """Questions by normal form; the first stays."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.squash(F.col("text")).alias("question"))
    return q.groupBy("question").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM conversations WHERE role = 'user'), u AS (SELECT min(id) AS id, {SQL_WORDS.format('k')} AS w FROM q GROUP BY k),
  s AS (SELECT id, list_distinct(CASE WHEN len(w) >= 3 THEN {SQL_GRAMS.format('w', 3)} ELSE [array_to_string(w, ' ')] END) AS gs FROM u WHERE len(w) > 0), g AS (SELECT id, len(gs) AS n, unnest(gs) AS g FROM s)
  SELECT a.id AS a, b.id AS b, count(*) AS common, a.n AS na, b.n AS nb FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL HAVING 100 * count(*) >= 70 * (a.n + b.n - count(*))""")
def question_near_pairs(spark, sf_dir):
    """Pairs of different questions with a Jaccard similarity of 0.7 or more on word 3-grams, exact; a shorter question is one gram by itself."""
    return dedup.similar_pairs(question_dedup(spark, sf_dir).select("id", F.col("question").alias("text")), k=3, percent=70, whole=True)


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), a AS (SELECT doc_id, unnest(w) AS surface, generate_subscripts(w, 1) AS pos FROM t),
  c AS (SELECT lower(surface) AS term, surface, count(*) AS n, min((doc_id, pos)) AS spot FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, spot) AS i FROM c) SELECT term, surface, n FROM r WHERE i = 1""")
def surface_forms(spark, sf_dir):
    """The most common spelling of each word."""
    return retrieval.surface_forms(docs_(spark, sf_dir))


TERMS = "SELECT * FROM VALUES (1, 'Stirrups'), (2, 'Reduced Beam Section (RBS)'), (3, 'line-girder'), (4, 'line girders'), (5, 'Stress'), (6, 'gas'), (7, 'w/c ratios'), (8, '') AS t(id, term)"


@query("SELECT * FROM (VALUES (1, 'stirrup'), (2, 'reduced beam section'), (3, 'line girder'), (4, 'line girder'), (5, 'stress'), (6, 'gas'), (7, 'w c ratio'), (8, '')) t(id, key)")
def term_keys(spark, sf_dir):
    """Keys of terms; expected values in the oracle."""
    return values(spark, TERMS).select("id", T.term_key(F.col("term")).alias("key"))


# --- personal data, links, text of pages --------------------------------------------------------------------------------

# RE2 has no look-around: the oracle consumes what stands beside a match and so replaces twice.
_E = r"(?i)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b"
_P = r"(^|[^\w.-])(?:\(\s?[2-9]\d{2}\s?\)\s?|[2-9]\d{2}[-.\s])\d{3}[-.]\d{4}($|[^\w-])"
_I = r"(^|[^\w.-])\d{3}-\d{2}-\d{4}($|[^\w-])"


def sql_scrub(c: str) -> str:
    t = f"regexp_replace({c}, '{_E}', '[EMAIL]', 'g')"
    for p, name in ((_P, "PHONE"), (_I, "ID")):
        for _ in range(2):
            t = f"regexp_replace({t}, '{p}', '\\1[{name}]\\2', 'g')"
    return t


@query(f"SELECT doc_id, md5({sql_scrub('text')}) AS digest FROM documents")
def pii_scrub(spark, sf_dir):
    """Documents with personal data replaced."""
    return docs_(spark, sf_dir).select("doc_id", F.md5(pii.scrub(F.col("text"))["text"]).alias("digest"))


@query(f"""WITH t AS (SELECT source, {sql_scrub('text')} AS t FROM documents) SELECT source, sum((length(t) - length(replace(t, '[EMAIL]', ''))) // 7)::BIGINT AS email, sum((length(t) - length(replace(t, '[PHONE]', ''))) // 7)::BIGINT AS phone,
  sum((length(t) - length(replace(t, '[ID]', ''))) // 4)::BIGINT AS id FROM t GROUP BY source""")
def pii_counts(spark, sf_dir):
    """Replacements by source and kind."""
    s = docs_(spark, sf_dir).select("source", pii.scrub(F.col("text")).alias("s"))
    return s.groupBy("source").agg(*[F.sum(f"s.{k}").alias(k) for k in ("email", "phone", "id")])


@query()
def pii_contexts(spark, sf_dir):
    """What stands around each address (RE2 can't say the bounded context of a look-around match; tested against Python)."""
    return docs_(spark, sf_dir).select("doc_id", F.explode(pii.contexts(F.col("text"), "EMAIL")).alias("context"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']+)["'']', 1)) AS href FROM pages""")
def page_links(spark, sf_dir):
    """Every link of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("href"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages) SELECT page_id,
 md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g'))) AS digest FROM t""")
def page_text(spark, sf_dir):
    """Text of pages, tags out."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


@query(r"SELECT page_id, trim(regexp_replace(lower(concat_ws('-', regexp_extract(url, '://([^/]+)', 1), regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_slugs(spark, sf_dir):
    """Slugs from host and file name."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.regexp_extract(url, "://([^/]+)", 1), F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)).alias("slug"))


PDF_PAGE = """SELECT '<table><tr><td>Bridge Manual</td><td><a href="/a%20b.pdf">get</a></td></tr></table><p><a class="x" href="c.pdf">Other &amp; <b>more</b></a> <a href="/a%20b.pdf">again</a> <a href="d.html">no</a></p>' AS html"""


@query("SELECT * FROM (VALUES ('/a%20b.pdf', 'Bridge Manual | get'), ('c.pdf', 'Other & more')) t(href, title)")
def pdf_links(spark, sf_dir):
    """Links to documents: inside a table row the row's cells are the title, else the link's text."""
    from tessella.operators import links

    return links.document_links(values(spark, PDF_PAGE), "html").select("href", "title")


# --- overlap ------------------------------------------------------------------------------------------------------------

N = 8


def sql_positions(name: str, id_: str, tab: str, n: int = N) -> str:
    return f"{name}w AS (SELECT {id_} AS id, {SQL_WORDS.format('text')} AS w FROM {tab}), {name} AS (SELECT id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS pos FROM (SELECT id, {SQL_GRAMS.format('w', n)} AS gs FROM {name}w))"


@query(f"WITH {sql_positions('d', 'doc_id', 'documents')} SELECT docs, count(*) AS grams FROM (SELECT g, count(DISTINCT id) AS docs FROM d GROUP BY g) GROUP BY docs")
def gram_lookup(spark, sf_dir):
    """How many n-grams stand in how many documents."""
    return overlap.gram_index(docs_(spark, sf_dir), "doc_id", "text", N).groupBy("docs").agg(F.count("*").alias("grams"))


def sql_cover(rows: str, ref: str, extra: str = "") -> str:
    """Coverage as a windowed maximum over words: another way than the operator's merged intervals."""
    return f"""WITH {rows}, {ref}, h AS (SELECT id, pos, g IN (SELECT g FROM r {extra}) AS hit FROM q),
      tok AS (SELECT id, unnest(range(len(w))) AS pos, len(w) AS n FROM qw), m AS (SELECT tok.id, tok.pos, coalesce(hit, false) AS hit FROM tok LEFT JOIN h ON tok.id = h.id AND tok.pos = h.pos),
      c AS (SELECT id, pos, max(hit::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW) AS cov FROM m),
      i AS (SELECT *, sum(1 - cov) OVER (PARTITION BY id ORDER BY pos) AS isl FROM c), runs AS (SELECT id, isl, sum(cov) AS run FROM i GROUP BY ALL),
      res AS (SELECT qw.id, len(qw.w)::BIGINT AS tokens, greatest(0, len(qw.w) - {N - 1})::BIGINT AS grams, coalesce((SELECT count(*) FROM h WHERE h.id = qw.id AND hit), 0) AS hits,
        coalesce((SELECT sum(cov) FROM c WHERE c.id = qw.id), 0)::BIGINT AS covered, coalesce((SELECT max(run) FROM runs WHERE runs.id = qw.id), 0)::BIGINT AS longest FROM qw)"""


@query(sql_cover(sql_positions("q", "item_id", "benchmark"), sql_positions("r", "doc_id", "documents")) + " SELECT * FROM res")
def items_vs_corpus(spark, sf_dir):
    """How far test items are covered by the corpus' n-grams: grams, hits, covered words, longest run."""
    items = table(spark, sf_dir, "benchmark")
    ref = overlap.among(overlap.positioned_grams(docs_(spark, sf_dir), "doc_id", "text", N), overlap.positioned_grams(items, "item_id", "text", N))
    return overlap.covered_tokens(items, ref, "item_id", "text", N)


@query(sql_cover(sql_positions("q", "doc_id", "documents"), sql_positions("r", "item_id", "benchmark")) + " SELECT * FROM res")
def doc_overlap(spark, sf_dir):
    """The same for documents against test items."""
    ref = overlap.positioned_grams(table(spark, sf_dir, "benchmark"), "item_id", "text", N)
    return overlap.covered_tokens(docs_(spark, sf_dir), ref, "doc_id", "text", N)


@query(sql_cover(sql_positions("q", "doc_id", "documents"), sql_positions("r", "item_id", "benchmark")) + """ SELECT CASE WHEN covered / greatest(tokens, 1) < 0.01 THEN '0-1%' WHEN covered / greatest(tokens, 1) < 0.05 THEN '1-5%' WHEN covered / greatest(tokens, 1) < 0.2 THEN '5-20%' ELSE '20-100%' END AS bin,
   count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM res GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(tokens)::BIGINT FROM res""")
def overlap_bins(spark, sf_dir):
    """Documents by coverage bin, and all."""
    c = doc_overlap(spark, sf_dir).select(overlap.coverage_bin(F.col("covered") / F.greatest("tokens", F.lit(1))).alias("bin"), "tokens")
    c = c.unionByName(c.withColumn("bin", F.lit("all")))
    return c.groupBy("bin").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {sql_positions('d', 'doc_id', 'documents')}, i AS (SELECT g, count(DISTINCT id) AS docs FROM d GROUP BY g), s AS (SELECT id, avg((docs > 1)::INT) AS share FROM d JOIN i USING (g) GROUP BY id)
  SELECT round(median(share), 6) AS med, round(quantile_cont(share, 0.9), 6) AS p90, round(max(share), 6) AS most, count(*) FILTER (share > 0.5) AS above FROM s""")
def leave_one_out(spark, sf_dir):
    """The share of each document's n-grams that another document has, summed up."""
    s = overlap.shared_elsewhere(docs_(spark, sf_dir), "doc_id", "text", N)
    return s.agg(F.round(F.median("share"), 6).alias("med"), F.round(F.percentile("share", 0.9), 6).alias("p90"), F.round(F.max("share"), 6).alias("most"), F.count_if(F.col("share") > 0.5).alias("above"))


@query(f"""WITH {sql_positions('q', 'item_id', 'benchmark')}, {sql_positions('d', 'doc_id', 'documents')}, qq AS (SELECT DISTINCT id, g FROM q), dd AS (SELECT DISTINCT id, g FROM d),
  n AS (SELECT id, count(*) AS nq FROM qq GROUP BY id), c AS (SELECT qq.id AS q, dd.id AS r, count(*) AS common FROM qq JOIN dd USING (g) GROUP BY ALL)
  SELECT q, arg_max(r, (common, -r)) AS r, max(common) AS common, round(max(common) / any_value(nq), 6) AS share FROM c JOIN n ON n.id = q GROUP BY q""")
def top_source(spark, sf_dir):
    """For each test item, the document with most of its distinct n-grams; ties to the first."""
    c = overlap.shared_gram_counts(table(spark, sf_dir, "benchmark"), docs_(spark, sf_dir), "item_id", "doc_id", "text", N)
    best = c.groupBy("q").agg(F.max_by("r", F.struct("common", -F.col("r"))).alias("r"), F.max("common").alias("common"), F.first("nq").alias("nq"))
    return best.select("q", "r", "common", F.round(F.col("common") / F.col("nq"), 6).alias("share"))


@query("SELECT count(*) AS planted, count(*) AS found FROM benchmark")
def planted_control(spark, sf_dir):
    """Positive control: every planted item must come back covered by 80% or more."""
    b = table(spark, sf_dir, "benchmark")
    ref = overlap.positioned_grams(docs_(spark, sf_dir), "doc_id", "text", N).select("g").unionByName(overlap.positioned_grams(b, "item_id", "text", N).select("g"))
    c = overlap.covered_tokens(b, ref, "item_id", "text", N)
    return c.agg(F.count("*").alias("planted"), F.count_if(F.col("covered") >= 0.8 * F.col("tokens")).alias("found"))


@query(f"WITH {sql_positions('d', 'doc_id', 'documents', 13)}, {sql_positions('q', 'item_id', 'benchmark', 13)} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM d WHERE g IN (SELECT g FROM q))")
def contamination_drop(spark, sf_dir):
    """Documents that share no 13-gram with a test item."""
    hit = overlap.among(overlap.positioned_grams(docs_(spark, sf_dir), "doc_id", "text", 13), overlap.positioned_grams(table(spark, sf_dir, "benchmark"), "item_id", "text", 13))
    return docs_(spark, sf_dir).select("doc_id").join(hit.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")


@query(f"""WITH {sql_positions('i', 'item_id', 'benchmark')}, x AS (SELECT DISTINCT id, g FROM i), n AS (SELECT id, count(*) AS n FROM x GROUP BY id)
  SELECT a.id AS k, b.id AS j, round(count(*) / any_value(n.n), 6) AS share FROM x a JOIN x b ON a.g = b.g AND a.id < b.id JOIN n ON n.id = a.id GROUP BY ALL""")
def shared_item_pairs(spark, sf_dir):
    """Pairs of test items that share an n-gram, with the share of the first's."""
    b = table(spark, sf_dir, "benchmark")
    c = overlap.shared_gram_counts(b, b, "item_id", "item_id", "text", N).where("q < r")
    return c.select(F.col("q").alias("k"), F.col("r").alias("j"), F.round(F.col("common") / F.col("nq"), 6).alias("share"))


SQL_Q = "q AS (SELECT conv_id * 1000 + turn AS id, {0} AS w FROM conversations WHERE role = 'user')".format(SQL_WORDS.format("text"))
SQL_H = "h AS (SELECT conv_id * 1000 + turn AS id, {0} AS w FROM conversations WHERE role = 'user' AND conv_id % 5 = 0)".format(SQL_WORDS.format("text"))


@query(f"""WITH {SQL_Q}, {SQL_H}, qg AS (SELECT id, unnest(list_distinct({SQL_GRAMS.format('w', 4)})) AS g FROM q), hs AS (SELECT id, list_distinct({SQL_GRAMS.format('w', 4)}) AS gs FROM h), hg AS (SELECT id, len(gs) AS n, unnest(gs) AS g FROM hs),
  l AS (SELECT qg.id AS q, hg.id AS r FROM qg JOIN hg USING (g) GROUP BY qg.id, hg.id, n HAVING 2 * count(*) > n), s AS (SELECT q.id AS q, h.id AS r FROM q JOIN h ON q.w = h.w AND len(q.w) BETWEEN 1 AND 3)
  SELECT q, min(r) AS r FROM (SELECT * FROM l UNION ALL SELECT * FROM s) GROUP BY q""")
def rule1_block(spark, sf_dir):
    """Questions that copy more than half of a held-out question's 4-grams (here: those of every fifth conversation)."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "conv_id")
    return overlap.copied_from(q, q.where("conv_id % 5 = 0"))


@query("""WITH c AS (SELECT doc_id AS chunk_id, source AS doc, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS page FROM documents), u AS (SELECT doc, page FROM c WHERE chunk_id % 17 = 0),
  x AS (SELECT c.*, EXISTS (SELECT 1 FROM u WHERE u.doc = c.doc AND abs(u.page - c.page) <= 1) AS near FROM c),
  y AS (SELECT chunk_id, CASE WHEN chunk_id % 17 = 0 THEN 'eval_chunk' WHEN substr(sha256(chunk_id::VARCHAR), 2, 1) NOT IN ('0','2','4','6','8','a','c','e') THEN 'unseen_hash' WHEN near THEN 'buffer' END AS why FROM x)
  SELECT chunk_id, why IS NULL AS allowed, why FROM y""")
def buffer_guard(spark, sf_dir):
    """Which chunks may be used next to held-out ones, and the first reason against the others."""
    from pyspark.sql.window import Window

    c = docs_(spark, sf_dir).select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"))
    held = c.where("n % 17 = 0")
    return overlap.buffer_guard(c, held, held).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents) SELECT doc_id, pos, lag(doc_id, 2) OVER w AS before2, lag(doc_id) OVER w AS before1, lead(doc_id) OVER w AS after1, lead(doc_id, 2) OVER w AS after2 FROM d WINDOW w AS (PARTITION BY source ORDER BY pos)""")
def neighbours(spark, sf_dir):
    """Reading position in the source, and the two neighbours at either side."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    at = lambda k: F.lag("doc_id", k).over(w) if k > 0 else F.lead("doc_id", -k).over(w)
    return docs_(spark, sf_dir).select("doc_id", (F.row_number().over(w) - 1).alias("pos"), at(2).alias("before2"), at(1).alias("before1"), at(-1).alias("after1"), at(-2).alias("after2"))


@query("""WITH d AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, contains(t, trim(left(t, 40))) AS in_passage FROM d""")
def answer_in_text(spark, sf_dir):
    """Is an answer (here: a text's own beginning) in its passage; equi-join on the passage, then containment."""
    d = docs_(spark, sf_dir).select("doc_id", T.squash(F.col("text")).alias("t"))
    a = d.select("doc_id", F.trim(F.substring("t", 1, 40)).alias("a"))
    return d.join(a, "doc_id").select("doc_id", F.contains("t", "a").alias("in_passage"))
