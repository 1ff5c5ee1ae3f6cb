"""Personal data: replaced in a fixed order, counted on the text as it is by then."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an address, a telephone number and an identity number, in this order.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("EMAIL", r"(?i)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b"),
    ("PHONE", r"(?<![\w.-])(?:\(\s?[2-9]\d{2}\s?\)\s?|[2-9]\d{2}[-.\s])\d{3}[-.]\d{4}(?![\w-])"),
    ("ID", r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
)


def scrub(text: Column) -> Column:
    """Struct (text, email, phone, id): the text with ``[EMAIL]``, ``[PHONE]`` and ``[ID]`` in place of matches, and how many of each."""
    counts = []
    for kind, pattern in PATTERNS:
        counts.append(F.regexp_count(text, F.lit(pattern)).cast("long").alias(kind.lower()))
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return F.struct(text.alias("text"), *counts)


def contexts(text: Column, kind: str, around: int = 40) -> Column:
    """Up to ``around`` characters before and after each match of a kind."""
    pattern = dict(PATTERNS)[kind].removeprefix("(?i)")
    flag = "(?is)" if kind == "EMAIL" else "(?s)"
    return F.regexp_extract_all(text, F.lit(f"{flag}.{{0,{around}}}(?:{pattern}).{{0,{around}}}"), F.lit(0))
