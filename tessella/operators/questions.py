"""Rules on questions, sampled texts and verdicts: what disqualifies a question, what looks like a hacked reward, which verdict counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T

from . import scoring

# Questions about notation, editions and lists, about a passage itself, and bibliographic ones.
TRIVIA = r"(?i)\b(symbol|denoted|notation|what units?\b|abbreviat\w*|number of pages|colloquial\w*|designated as|stands? for|acronym|known as|publication year)\b"
LIST_QUESTION = r"(?i)\b(name one|one example|what is one|give one|list one|an example of)\b"
PASSAGE_WORDS = r"(?i)\b(passage|this document|the figure|the table|the excerpt)\b"
BIBLIOGRAPHIC = r"(?i)\b(page numbers?|issue of|journal|proceedings|published (?:in|by))\b"
REFERENCE = r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)\s*\.|\b(?:19|20)\d{2}[a-z]?\.\s+[A-Z“\"]|\b(?:Vol|pp|No)\.\s?\d"
REBUTTAL = r"(?i)\b(?:there (?:is|are) no|does not (?:specify|address|provide)|not (?:specified|addressed|provided))\b"


def trivia(question: Column, answer: Column) -> Column:
    """Notation and list questions, bare Greek symbols, and answers whose words all stand in the question."""
    words = T.words(answer)
    spelled_out = (F.size(words) > 0) & (F.size(F.array_except(words, T.words(question))) == 0)
    symbol = answer.rlike("[Ͱ-Ͽ]") & (F.length(F.regexp_replace(answer, r"[\s_{}]", "")) <= 5) & ~answer.rlike("[=.]")
    return question.rlike(TRIVIA) | question.rlike(LIST_QUESTION) | symbol | spelled_out


def closed_book_rule(question: Column, answer: Column, passage: Column) -> Column:
    """The first rule a closed-book question fails, or null."""
    return (
        F.when(F.trim(question) == "", "empty")
        .when(scoring.locator(question, answer).isNotNull(), "locator")
        .when(question.rlike(PASSAGE_WORDS), "context_bound")
        .when(trivia(question, answer) | question.rlike(BIBLIOGRAPHIC), "trivia")
        .when(F.size(scoring.ungrounded_numbers(answer, passage)) > 0, "ungrounded_number")
        .when(F.size(T.tokens(answer)) > 6, "long_answer")
    )


def reference_list(text: Column) -> Column:
    """At least one citation of a reference list for each 100 words."""
    return 100 * F.regexp_count(text, F.lit(REFERENCE)) >= F.greatest(F.lit(1), F.size(T.tokens(text)))


def premise_rebutted(question: Column, passage: Column) -> Column:
    """A sentence says that what is asked for is not there, and shares two content words with the question."""
    long_ = lambda t: F.filter(T.content_words(t), lambda w: F.length(w) > 2)
    return F.exists(T.sentences(passage), lambda s: F.regexp_like(s, F.lit(REBUTTAL)) & (F.size(F.array_intersect(long_(question), long_(s))) >= 2))


def reviewed_out(items: DataFrame, rejects: DataFrame, column: str) -> DataFrame:
    """Items whose ``column`` holds none of the rejected strings (part); the list is small by nature and counted before it is sent out."""
    if rejects.limit(10_001).count() > 10_000:
        raise ValueError("a list of hand-made rejects has at most 10,000 rows")
    return items.join(F.broadcast(rejects.select("part")), F.contains(F.lower(column), F.lower("part")), "left_anti")


def sanity(text: Column) -> Column:
    """Struct of distinct_4, max_4gram (most copies of a word 4-gram), repeated_lines and ascii_share of a text."""
    grams = T.ngrams(T.words(text), 4)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    most = T.let(grams, lambda g: F.coalesce(F.array_max(F.transform(F.array_distinct(g), lambda x: F.size(F.filter(g, lambda y: y == x)))), F.lit(0)))
    distinct = T.let(grams, lambda g: F.round(F.size(F.array_distinct(g)) / F.nullif(F.size(g), F.lit(0)), 6))
    ascii_ = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.nullif(F.length(text), F.lit(0))
    return F.struct(distinct.alias("distinct_4"), most.alias("max_4gram"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("repeated_lines"), F.round(ascii_, 6).alias("ascii_share"))


def stock_phrases(answers: DataFrame, least: int = 5) -> DataFrame:
    """(form, tasks): answers in answer form that stand on ``least`` different tasks or more."""
    form = answers.select("task", T.answer_form(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy("form").agg(F.count_distinct("task").alias("tasks")).where(F.col("tasks") >= least)


def valid_verdicts(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records (eid, fp, …) with the verdict that was given to their present content: the fingerprints must agree."""
    return records.join(verdicts.select("eid", "fp", "verdict"), ["eid", "fp"], "left")


def collapsed(samples: DataFrame, limit: float = 0.9) -> DataFrame:
    """(prompt, collapsed): whether all pairs of a prompt's samples (id, text) overlap by more than ``limit``. Pairs join a prompt's own few samples."""
    from .retrieval import multiset_overlap

    a, b = samples.select("prompt", F.col("id").alias("i"), F.col("text").alias("ta")), samples.select("prompt", F.col("id").alias("j"), F.col("text").alias("tb"))
    pairs = a.join(b, "prompt").where("i < j")
    o = multiset_overlap(pairs, "ta", "tb", ["prompt", "i", "j"])
    return o.groupBy("prompt").agg((F.min("overlap") > limit).alias("collapsed"))


def first_divergence(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays; a longer array diverges where the shorter ends."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def page_text(chunks: DataFrame) -> DataFrame:
    """Chunks (doc, page, pos, text) with the whole text of their page, in reading order."""
    pages = chunks.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("page_text"))
    return chunks.join(pages, ["doc", "page"])


def distractors(chunks: DataFrame) -> DataFrame:
    """(id, other): for each chunk (id, doc) one of another document, the next in hash order; no random generator.

    Chunks are dealt into 256 parts by hash and ordered within each, so no window runs over all rows; the last of a part and those whose next
    neighbour is of their own document look further, up to 8 places.
    """
    h = F.sha2(F.col("id").cast("string"), 256)
    w = Window.partitionBy(F.substring("h", 1, 2)).orderBy("h")
    rows = chunks.withColumn("h", h)
    near = [F.lead(F.struct("id", "doc"), k).over(w) for k in range(1, 9)] + [F.lag(F.struct("id", "doc"), k).over(w) for k in range(1, 9)]
    rows = rows.withColumn("near", F.array(*near))
    return rows.select("id", F.try_element_at(F.filter("near", lambda x: x.isNotNull() & (x["doc"] != F.col("doc"))), F.lit(1))["id"].alias("other"))


def overridden(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, verdict, previous): verdicts (id, verdict), the new one where there is one; previous is the old one that it took the place of. Ids are unique on each side."""
    both = old.select("id", F.col("verdict").alias("_o")).join(new.select("id", F.col("verdict").alias("_n"), F.lit(True).alias("_new")), "id", "full")
    return both.select("id", F.when(F.col("_new"), F.col("_n")).otherwise(F.col("_o")).alias("verdict"), F.when(F.col("_new"), F.col("_o")).alias("previous"))
