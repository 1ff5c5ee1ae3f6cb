"""Paragraph and document quality rules, boilerplate lines, eligibility of passages and chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T

# Fixed values of the paragraph rules: limits and patterns.
ALPHA, WORD_LENGTH, SHORT_SHARE, NUMBERED_SHARE, SYMBOL_RATIO, REFERENCE_SHARE, SHORT_WORDS = 0.6, (3, 12), 0.4, 0.3, 0.15, 0.25, 6
MARKER_LINE = r"(?m)^([•▪‣◦*–-]|\(?[0-9]+(?:\.[0-9]+)*[.)]?|\(?[a-z][.)])\n"
SYMBOLS = r"\.{3,}|_{3,}|[|…—•■□▪]"
BULLET = r"^\s*(?:[0-9]|[•*‣◦▪■□–-])"
YEAR_OR_PAGES = r"\((?:19|20)[0-9][0-9][a-z]?\)|\bpp\."
COPYRIGHT = r"(?i)copyright|©|all rights reserved"


def paragraphs(docs: DataFrame, delimiter: str = "\n") -> DataFrame:
    """One row a paragraph: the documents' other columns, ``pos`` from 0 and ``para``; blank paragraphs are left out. No shuffle."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(F.split("text", delimiter)).alias("pos", "para")).where(F.trim("para") != "")


def paragraph_rule(para: Column) -> Column:
    """The first rule that a paragraph fails, or null: alpha_ratio, word_length, short_lines, numbered_lines, symbol_ratio,
    reference_list, in this order. A list marker alone on its line counts with the next line. All limits are strict."""
    joined = F.regexp_replace(para, MARKER_LINE, "$1 ")
    parts = F.struct(joined.alias("p"), T.tokens(joined).alias("w"), F.split(joined, "\n").alias("lines"), F.regexp_replace(joined, T.SPACE, "").alias("solid"))
    return T.let(parts, lambda x: _first_failing(x["p"], x["w"], x["lines"], x["solid"]))


def _first_failing(p: Column, w: Column, lines: Column, solid: Column) -> Column:
    n, n_lines = F.size(w), F.size(lines)
    size = lambda line: F.size(T.tokens(line))
    short = lambda line: size(line) < SHORT_WORDS
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    on_short = total(F.transform(F.filter(lines, short), size))
    numbered = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(BULLET)) & short(x)))
    listed = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(YEAR_OR_PAGES))))
    mean = F.length(solid) / F.nullif(n, F.lit(0))
    return (
        F.when(n == 0, F.lit(None))
        .when(letters / F.length(solid) < ALPHA, "alpha_ratio")
        .when((mean < WORD_LENGTH[0]) | (mean > WORD_LENGTH[1]), "word_length")
        .when((n_lines >= 3) & (on_short / n > SHORT_SHARE), "short_lines")
        .when((n_lines >= 3) & (numbered / n_lines > NUMBERED_SHARE), "numbered_lines")
        .when(F.regexp_count(p, F.lit(SYMBOLS)) / n > SYMBOL_RATIO, "symbol_ratio")
        .when(listed / n_lines > REFERENCE_SHARE, "reference_list")
    )


def keep_paragraphs(docs: DataFrame, key: str = "doc_id", delimiter: str = "\n") -> DataFrame:
    """(key, text) of documents from the paragraphs that pass, in order. Done inside the row: documents never leave their partition."""
    kept = F.filter(F.split("text", delimiter), lambda p: (F.trim(p) != "") & paragraph_rule(p).isNull())
    return docs.select(key, F.array_join(kept, delimiter).alias("text"))


def dictionary_ratio(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, ratio): the share of ``[a-z]+`` words of which a start, 0 to 3 letters shorter and of two letters or more, is in
    ``dictionary`` (word). Each distinct word of a document is looked up once; dictionaries of a counted small size go to every executor."""
    listed = dictionary.select(F.col("word").alias("_listed")).distinct()
    listed = F.broadcast(listed) if listed.limit(1_000_001).count() <= 1_000_000 else listed
    found = docs.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    stems = found.select("w").distinct().select("w", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where(F.length("w") - F.col("k") >= 2)
    known = stems.join(listed, F.expr("substring(w, 1, length(w) - k)") == F.col("_listed"), "left_semi").select(F.col("w").alias("_w")).distinct()
    rows = found.join(known, F.col("w") == F.col("_w"), "left").groupBy(key).agg(F.sum("c").alias("n_words"), F.sum(F.when(F.col("_w").isNotNull(), F.col("c")).otherwise(0)).alias("known"))
    out = docs.select(F.col(key).alias("_key")).join(rows, F.col("_key") == F.col(key), "left")
    return out.select(F.col("_key").alias(key), F.coalesce("n_words", F.lit(0)).alias("n_words"), (F.coalesce("known", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("n_words", F.lit(0)))).alias("ratio"))


def document_rule(n_words: Column, ratio: Column, min_words: int, least: float = 0.70) -> Column:
    """min_words, then dictionary (the ratio is rounded half-even to 3 places first), or null."""
    return F.when(n_words < min_words, "min_words").when(F.bround(ratio, 3) < least, "dictionary")


def running_lines(lines: DataFrame, edge: int = 3, share: float = 0.3, least_pages: int = 5) -> DataFrame:
    """Lines (doc, page, pos, line) that are running headers or footers.

    A line's key has digits masked and is lower-cased. It is running if it stands among the first or last ``edge`` lines on more than
    max(2, ``share`` of the document's pages) pages, and is reported only at such places; documents under ``least_pages`` pages have none. A key counts
    once a page.
    """
    page = Window.partitionBy("doc", "page")
    # Position and size of a page are known from its lines' own numbers, so one window over a page suffices.
    placed = lines.withColumns({"n": F.count("*").over(page), "i": F.row_number().over(page.orderBy("pos"))})
    at_edge = placed.where((F.col("i") <= edge) | (F.col("i") > F.col("n") - edge)).withColumn("key", F.regexp_replace(F.lower(F.trim("line")), "[0-9]", "#"))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    keys = at_edge.select("doc", "page", "key").distinct().groupBy("doc", "key").agg(F.count("*").alias("on"))
    running = keys.join(pages, "doc").where(F.col("on") > F.greatest(F.lit(2.0), share * F.col("pages"))).select("doc", "key")
    return at_edge.join(running, ["doc", "key"], "left_semi").select("doc", "page", "pos", "line")


def running_blocks(blocks: DataFrame, longest: int = 120, share: float = 0.3) -> DataFrame:
    """Blocks (doc, page, block) shorter than ``longest`` on at least max(3, ``share`` of the pages) pages, wherever they stand."""
    pages = blocks.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    on = blocks.where(F.length("block") < longest).select("doc", "page", "block").distinct().groupBy("doc", "block").agg(F.count("*").alias("on"))
    return on.join(pages, "doc").where(F.col("on") >= F.greatest(F.lit(3.0), share * F.col("pages"))).select("doc", "block", "on")


def short_pages(blocks: DataFrame, least: int = 200) -> DataFrame:
    """(doc, page, chars, reason): pages with less text than ``least``; ``image`` without any, else ``short``."""
    sums = blocks.groupBy("doc", "page").agg(F.sum(F.length(F.coalesce("block", F.lit("")))).alias("chars"))
    return sums.where(F.col("chars") < least).withColumn("reason", F.when(F.col("chars") == 0, "image").otherwise("short"))


def chat_eligible(turns: DataFrame, most: int = 6000, ascii_share: float = 0.95) -> DataFrame:
    """conv_id of conversations of exactly a user's and then an assistant's turn, of 1 to ``most`` characters, nearly all ASCII."""
    size = F.sum(F.length("text"))
    ascii_ = F.sum(F.length(F.regexp_replace("text", r"[^\x00-\x7F]", "")))
    agg = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("role", "turn").alias("first"), F.max_by("role", "turn").alias("last"), size.alias("chars"), ascii_.alias("ascii"))
    return agg.where("n = 2 AND first = 'user' AND last = 'assistant'").where((F.col("chars") > 0) & (F.col("chars") <= most) & (F.col("ascii") / F.col("chars") >= ascii_share)).select("conv_id", "chars")


def garbled(text: Column) -> Column:
    """More than 30 tokens of which over 45% have one or two characters."""
    w = T.tokens(text)
    return (F.size(w) > 30) & (F.size(F.filter(w, lambda x: F.length(x) <= 2)) / F.size(w) > 0.45)


def passage_eligible(text: Column, n_words: Column, low: int, high: int, numbers: int) -> Column:
    """Length in bounds, over 60% letters, not garbled, and enough numbers; cheap tests first."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.nullif(F.length(text), F.lit(0))
    return n_words.between(low, high) & (letters > 0.6) & (F.regexp_count(text, F.lit("[0-9]+")) >= numbers) & ~garbled(text)
