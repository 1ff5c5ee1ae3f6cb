"""Text functions, Column to Column. All are JVM expressions: nothing here starts Python on an executor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the stop list that content words leave out.
STOPWORDS = (
    "a an the of to in on for and or with by as at from is are be was were that this which what when how why where who does do it its "
    "into than then there their these those per under over not no can may shall should must"
).split()

#: White space as Unicode defines it; Java's ``\s`` alone misses the no-break space and the separators.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def content_words(text: Column) -> Column:
    """Words with decimals kept whole and stop words left out; repeats stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda's variable is bound to a result, where a repeated expression is computed at each place
    (and, inside another lambda, for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` neighbours joined by a space, repeats included; empty if there are fewer items."""

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(empty_strings())

    return let(items, grams)


def ngrams_or_whole(items: Column, n: int) -> Column:
    """Like ``ngrams``, but a shorter text is one gram by itself; nothing at all gives none."""
    return F.when(F.size(items) >= n, ngrams(items, n)).when(F.size(items) > 0, F.array(F.array_join(items, " "))).otherwise(empty_strings())


def squash(text: Column) -> Column:
    """Lower case with every run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE + "+", " "))


def sql_squash(text: Column) -> Column:
    """``trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))`` as DuckDB has it: ASCII white space alone is squeezed, all of Unicode's spaces are trimmed, and case is
    that of single characters (Java's depends on the neighbours of a capital sigma, and makes two characters of a dotted capital I)."""
    t = F.regexp_replace(F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3")), r"[\t\n\f\r ]+", " ")
    return F.regexp_replace(t, r"\A\p{Zs}+|\p{Zs}+\z", "")


def first_line(text: Column) -> Column:
    return F.trim(F.element_at(F.split(F.regexp_replace(text, r"^\s+", ""), "\n"), 1))


def answer_form(text: Column) -> Column:
    """The first line in the form in which answers are compared: lower case, hyphens as spaces, without articles and without
    punctuation other than ``.``, ``%`` and ``/``."""
    t = F.regexp_replace(F.lower(first_line(text)), "-", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s.%/]", " ")
    t = F.regexp_replace(t, r"(?U)\b(?:a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def holds_phrase(text: Column, phrase: Column) -> Column:
    """``phrase`` stands in ``text`` with no word character at either side."""
    quoted = F.regexp_replace(phrase, r"([\\.\[\]{}()*+?^$|/%-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")))


def term_key(term: Column) -> Column:
    """Key of a term: lower case, bracketed parts out, hyphens and slashes as spaces, plural s off words of four letters and more."""
    t = F.regexp_replace(F.lower(term), r"\s*\([^)]*\)\s*", " ")
    parts = F.filter(F.split(F.regexp_replace(t, "[-/]", " "), r"\s+"), lambda w: w != "")
    plural = lambda w: w.endswith("s") & (F.length(w) > 3) & ~w.endswith("ss")
    return F.array_join(F.transform(parts, lambda w: F.when(plural(w), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")


def slug(publisher: Column, stem: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", publisher, stem)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_tags(fragment: Column) -> Column:
    """Tags out, the common character references decoded, white space squeezed."""
    t = F.regexp_replace(fragment, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def join_broken_lines(text: Column) -> Column:
    """Words broken by a hyphen at a line's end are made whole; other line ends become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2"), r"[ \t]*\n[ \t]*", " ")


def sentences(text: Column) -> Column:
    """Split after ``.``, ``;`` or ``:`` and white space."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.;:])\s+")


def citations(text: Column) -> Column:
    """Bracketed spans without brackets inside, trimmed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)), lambda c: F.trim(c))


def chunk_parts(chunk_id: Column) -> Column:
    """Document, page and number of a chunk id of the shape ``doc:p<page>:c<number>``."""
    part = lambda i: F.regexp_extract(chunk_id, r"^(.*):p(\d+):c(\d+)$", i)
    return F.struct(part(1).alias("doc"), part(2).try_cast("int").alias("page"), part(3).try_cast("int").alias("number"))


def h01(key: Column) -> Column:
    """A number in [0, 1) from a key: the first 64 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def pick(key: Column, options: list[str]) -> Column:
    return F.element_at(F.lit(options), (F.floor(h01(key) * len(options)) + 1).cast("int"))


def even_byte(key: Column) -> Column:
    """The first byte of the key's SHA-256 is even: a fair coin that stays with the key."""
    return F.substring(F.sha2(key, 256), 2, 1).isin(*"02468ace")


def first_number(text: Column) -> Column:
    """The first number of the first line as a double: thousands commas out, exponents read; a hyphen after a letter or digit is no sign."""
    found = F.regexp_extract(first_line(text), r"((?:(?<![A-Za-z0-9])-)?\d[\d,]*\.?\d*(?:[eE][-+]?\d+)?)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")
