"""Answer scoring, verdicts, rewards, preference pairs and best-of-n measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T

# What points into a document's own layout, and what names a document or clause.
LOCATOR_ANSWER = r"(?i)^\s*(p\.|pp\.?|pages?|table|tbl\.?|figure|fig\.?|eq\.?|equation|exhibit|plate)\s*[A-Z]{0,2}-?\d[\w.\-]*\s*$|^\s*\d[\d,]*\s*(pp\.?|pages)\s*$"
LOCATOR_ASK = r"(?i)\b(which|what|on what|on which)\s+(page|table|figure|fig\.?|exhibit)\b|\bwhere in (the|this) (document|manual|report|chapter)\b|\bpage (number|count)\b|\bhow many pages\b"
EQUATION_ASK = r"(?i)\b(which|what)\s+equation\b"
IDENTIFIER = (
    r"(?i)^(EM|ETL|ER|EP|FEMA\s*P?-?|NIST\s*(GCR|TN|SP|NCSTAR)?|NASA-STD|FHWA-|UFC|AASHTO|ACI|AISC|ASCE|ASTM|AWS|ANSI|IBC|IRC)\s*[\w\-./]*\d"
    r"|^(AASHTO\s+LRFD\s+)?(article|art\.|section|sec\.|clause|chapter|appendix|§)\s*[A-Z]?\d[\w.\-]*$|^\d+(\.\d+){2,}[a-z]?$"
)
RATIO = r"^\s*(\d+(?:\.\d+)?)\s*:\s*1\s*$"


def exact_match(answer: Column, gold: Column) -> Column:
    """The answer's first line is the gold answer or holds it as a phrase, both in answer form; an empty gold never matches."""
    a, g = T.answer_form(answer), T.answer_form(gold)
    return F.coalesce((g != "") & ((a == g) | T.holds_phrase(a, g)), F.lit(False))


def numeric_match(answer: Column, gold: Column, tolerance: Column | float = 0.02) -> Column:
    """First number against first number within a relative tolerance; a gold of zero needs a zero. Units are not compared."""
    a, g = T.first_number(answer), T.first_number(gold)
    tol = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return F.coalesce(F.when(g == 0, F.abs(a) < 1e-9).otherwise(F.abs(a - g) / F.abs(F.nullif(g, F.lit(0.0))) <= tol), F.lit(False))


def qa_correct(answer: Column, gold: Column, answer_type: Column, tolerance: Column | float = 0.02) -> Column:
    return F.when((answer_type == "numeric") | gold.rlike(RATIO), numeric_match(answer, gold, tolerance)).otherwise(exact_match(answer, gold))


def locator(question: Column, answer: Column) -> Column:
    """Why an item asks for a place in a document, or null."""
    return (
        F.when(answer.rlike(LOCATOR_ANSWER), "locator_answer")
        .when(question.rlike(LOCATOR_ASK), "locator_ask")
        .when(question.rlike(EQUATION_ASK) & answer.rlike("[0-9]"), "locator_equation_number")
    )


def answer_type(answer: Column) -> Column:
    return F.when(F.regexp_count(answer, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?")) == 1, "numeric").otherwise("exact")


def answer_kind(answer: Column, type_: Column) -> Column:
    """identifier, number, other or term, in this order."""
    a = F.trim(answer)
    return (
        F.when(a.rlike(IDENTIFIER), "identifier")
        .when((type_ == "numeric") | a.rlike(r"^\d+(\.\d+)?\s*:\s*1$"), "number")
        .when(a.rlike(r"\d"), "other")
        .when(F.size(T.tokens(a)) <= 5, "term")
        .otherwise("other")
    )


def citations_valid(answer: Column, given: Column) -> Column:
    """At least one citation, and none that was not given."""
    found = T.citations(answer)
    return (F.size(found) > 0) & (F.size(F.array_except(found, given)) == 0)


def abstained(answer: Column, phrase: str) -> Column:
    return F.contains(F.lower(answer), F.lit(phrase))


def gold_present(gold: Column, passage: Column) -> Column:
    """A short gold (6 words or fewer) stands in the passage as a phrase, or one of its numbers of two digits or more does by value; of a longer one 60% of
    the distinct content words do."""
    form = lambda t: F.array_join(F.regexp_extract_all(F.replace(F.lower(t), F.lit(","), F.lit("")), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0)), " ")
    g, t = form(gold), form(passage)
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    wide = F.filter(numbers(g), lambda n: F.length(F.replace(n, F.lit("."), F.lit(""))) >= 2)
    by_value = F.arrays_overlap(F.transform(wide, lambda n: n.try_cast("double")), F.transform(numbers(t), lambda n: n.try_cast("double")))
    w = F.array_distinct(T.content_words(gold))
    share = F.size(F.array_intersect(w, T.content_words(passage))) / F.nullif(F.size(w), F.lit(0))
    short = F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))) | F.coalesce(by_value, F.lit(False))
    return F.when(g == "", False).when(F.size(F.split(g, " ")) <= 6, short).otherwise(F.coalesce(share >= 0.6, F.lit(False)))


def ungrounded_numbers(answer: Column, passage: Column) -> Column:
    """Numbers of the answer that the passage has nowhere, commas aside."""
    plain = F.replace(passage, F.lit(","), F.lit(""))
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.filter(found, lambda n: ~F.contains(plain, n))


def term_in_passage(term: Column, passage: Column) -> Column:
    """The term, or either part of "Name (ABBR)", stands in the passage as whole tokens, a plural s aside."""
    text = T.squash(passage)
    name, short = F.regexp_extract(term, r"^(.*?)\s*\((.*?)\)\s*$", 1), F.regexp_extract(term, r"^(.*?)\s*\((.*?)\)\s*$", 2)
    forms = F.when(term.rlike(r"^(.*?)\s*\((.*?)\)\s*$"), F.array(name, short)).otherwise(F.array(term))
    forms = F.filter(F.transform(forms, T.squash), lambda v: F.length(v) >= 2)

    def stands(v: Column) -> Column:
        stem = F.when(v.endswith("s") & (F.length(v) > 3), F.substr(v, F.lit(1), F.length(v) - 1)).otherwise(v)
        quoted = F.regexp_replace(stem, r"([^a-z0-9 ])", r"\\$1")
        return F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("s?(?![a-z0-9])")))

    return F.exists(forms, stands)


def reward(formatted: Column, correct: Column, length: Column, free: int = 192, most: int = 256) -> Column:
    """0.1 for the format, 0.9 for a right answer in it, and up to 0.1 off from ``free`` to ``most`` tokens."""
    off = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (length - free) / F.lit(float(most - free)))) * 0.1
    return F.when(formatted, 0.1).otherwise(0.0) + F.when(formatted & correct, 0.9).otherwise(0.0) - off


def grade(principles: Column, weights: dict[str, float], pitfalls: Column, penalties: dict[str, float], hard: Column) -> Column:
    """Struct (score, ok): the weighted mean of principles clamped to 1 to 5, less half the weights of the pitfalls that apply; ok if all
    hard rules hold and the score is 4 or more. Maps of name to value."""
    # greatest and least pass over nulls, so a missing principle is given the lowest mark first.
    clamp = lambda v: F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(v.cast("double"), F.lit(1.0))))
    total = sum(weights.values())
    score = sum((clamp(principles[k]) * w for k, w in weights.items()), F.lit(0.0)) / total
    score = score - sum((F.when(pitfalls[k].cast("boolean"), 0.5 * w).otherwise(0.0) for k, w in penalties.items()), F.lit(0.0))
    ok = F.forall(F.map_values(hard), lambda v: F.coalesce(v, F.lit(False))) & (score >= 4)
    return F.struct(F.round(score, 6).alias("score"), ok.alias("ok"))


def effective_score(rule_ok: Column, hard_ok: Column, score: Column, floor: float = 1.0) -> Column:
    """A failed rule or hard failure gives the floor; a failed call gives null, never the floor."""
    return F.when(~rule_ok, floor).when(score.isNull(), F.lit(None)).when(~F.coalesce(hard_ok, F.lit(True)), floor).otherwise(score)


def majority(samples: DataFrame, item: str, answer: str, order: str) -> DataFrame:
    """(item, vote): the most frequent non-empty answer; of equally frequent ones, that given first."""
    counts = samples.where(F.col(answer) != "").groupBy(item, answer).agg(F.count("*").alias("c"), F.min(order).alias("at"))
    return counts.groupBy(item).agg(F.max_by(answer, F.struct("c", -F.col("at"))).alias("vote"))


def pass_at(samples: DataFrame, item: str, correct: str) -> DataFrame:
    """One row: items, mean share right, share with any right, and its standard error sd / sqrt(n)."""
    per = samples.groupBy(item).agg(F.avg(F.col(correct).cast("double")).alias("mean"), F.max(F.col(correct).cast("double")).alias("best"))
    n = F.count("*")
    return per.agg(n.alias("items"), F.round(F.avg("mean"), 6).alias("pass_1"), F.round(F.avg("best"), 6).alias("pass_k"), F.round(F.stddev_samp("best") / F.sqrt(n), 6).alias("se"))


def pairwise_outcome(verdicts: DataFrame) -> DataFrame:
    """(id, outcome) from verdicts (id, ord, winner, same): 1 or 0 if both orders name the same winner, else 0.5; equal texts 0.5."""
    agg = verdicts.groupBy("id").agg(F.bool_or("same").alias("same"), F.sum(F.when(F.col("winner") == "a", 1).otherwise(0)).alias("wa"), F.sum(F.when(F.col("winner") == "b", 1).otherwise(0)).alias("wb"))
    return agg.select("id", F.when(F.col("same"), 0.5).when(F.col("wa") == 2, 1.0).when(F.col("wb") == 2, 0.0).otherwise(0.5).alias("outcome"))


def preference_pairs(scored: DataFrame, margin: float = 2.0, longest: float = 1.5, most: int = 4096, rounds: int = 2) -> DataFrame:
    """(prompt, round, chosen, rejected): up to ``rounds`` pairs of samples for each prompt.

    ``scored``: prompt, id, text, n_tokens, score, correct. Chosen is the right sample with the smallest hash for which a rejected one exists: that with the
    smallest hash among samples at least ``margin`` lower, of other text, with chosen at most ``longest`` times its length. Both are
    then out and the next round is formed from the rest. Pairs join a prompt's own samples, which are a handful.
    """
    s = scored.where(F.col("n_tokens") <= most).withColumn("h", F.sha2(F.concat_ws(":", F.col("prompt"), F.col("id").cast("string")), 256))
    taken, out = None, None
    for k in range(1, rounds + 1):
        rest = s if taken is None else s.join(taken, ["prompt", "id"], "left_anti")
        c = rest.where("correct").select("prompt", *[F.col(x).alias("c_" + x) for x in ("id", "h", "text", "n_tokens", "score")])
        r = rest.select("prompt", *[F.col(x).alias("r_" + x) for x in ("id", "h", "text", "n_tokens", "score")])
        fit = (F.col("c_score") - F.col("r_score") >= margin) & (F.col("c_text") != F.col("r_text")) & (F.col("c_n_tokens") <= longest * F.col("r_n_tokens"))
        best = c.join(r, "prompt").where(fit).groupBy("prompt").agg(F.min(F.struct("c_h", "r_h", "c_id", "r_id")).alias("p"))
        pairs = best.select("prompt", F.lit(k).alias("round"), F.col("p.c_id").alias("chosen"), F.col("p.r_id").alias("rejected"))
        out = pairs if out is None else out.unionByName(pairs)
        used = pairs.select("prompt", F.explode(F.array("chosen", "rejected")).alias("id"))
        taken = used if taken is None else taken.unionByName(used)
    return out


def quality_gate(lines: DataFrame) -> DataFrame:
    """(run, verdict) of lines (run, delta, floor; delta null if missing): fails if any change exceeds its floor, else incomplete if a line is missing, else passes."""
    agg = lines.groupBy("run").agg(F.bool_or(F.abs("delta") > F.col("floor")).alias("bad"), F.bool_or(F.col("delta").isNull()).alias("open"))
    return agg.select("run", F.when(F.coalesce("bad", F.lit(False)), "fails").when(F.col("open"), "incomplete").otherwise("passes").alias("verdict"))


def checkpoint_within_error(curve: DataFrame) -> DataFrame:
    """(run, step) of curves (run, step, value, se): the earliest step within one standard error of the best value."""
    best = F.max(F.struct("value", -F.col("step"), "se")).over(Window.partitionBy("run"))
    marked = curve.withColumn("b", best)
    return marked.where(F.col("value") >= F.col("b.value") - F.col("b.se")).groupBy("run").agg(F.min("step").alias("step"))
