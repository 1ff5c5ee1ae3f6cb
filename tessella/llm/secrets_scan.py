"""Secret scans: patterns, and a battery of randomness tests with false-discovery control. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: kind: (pattern, group whose length counts, its least length). Matches are leftmost and do not overlap within a kind.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What is tested for randomness: unbroken runs of the characters of hex, base32, base64 and base64url.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Encodings from narrow to wide: (name, alphabet in order, pattern of a whole token).
ENCODINGS = (
    ("hex", "0123456789abcdef", r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/_-]+$"),
)
#: Ordinary tokens deviate from uniform letters by at least this much a character (X^2 / n): one row an encoding.
ORDINARY = {"hex": 1.2, "base32": 0.8, "base36": 1.2, "base64": 2.0}
STEPS, MOST = 8, 400


#: Matches whose positions are added up one by one; lots of so many are added up as wholes, so a text with many matches takes little more than linear time.
LOT = 256


def _total(xs: Column, zero: Column) -> Column:
    return F.aggregate(xs, zero, lambda a, x: a + x)


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end) of all matches of ``pattern`` whose ``group`` has ``least`` characters, in code points.

    The text is split at the matches; the lengths of what lies between and of the matches, added up, are the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    length = lambda xs: F.transform(xs, lambda x: F.length(x))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(length(F.split(text, pattern, -1)).alias("b"), length(found).alias("m"), length(sized).alias("g"))
    steps = F.slice(steps, 1, F.size(found))
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / LOT).cast("int")), lambda i: F.slice(steps, i * LOT + 1, LOT))
    wide = F.transform(lots, lambda lot: F.aggregate(lot, F.lit(0), lambda a, x: a + x["b"] + x["m"]))
    begins = F.aggregate(wide, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    empty = F.array().cast("array<struct<start:int,end:int,n:int>>")

    def placed(lot: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = F.when(F.size(acc) == 0, begin).otherwise(F.element_at(acc, -1)["end"]) + x["b"]
            return F.concat(acc, F.array(F.struct(start.alias("start"), (start + x["m"]).alias("end"), x["g"].alias("n"))))

        return F.aggregate(lot, empty, step)

    all_ = F.flatten(F.zip_with(lots, F.slice(begins, 1, F.size(lots)), placed))
    kept = F.transform(F.filter(all_, lambda x: x["n"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def candidates(text: Column) -> Column:
    """Array of (start, end, token) of the tokens to be tested: what ``CANDIDATE`` matches between the matches of the assign pattern and holds no other
    base match. A hex or access match lies within one run of a candidate's characters, so the token alone tells that."""
    assign, _, _ = BASE["assign"]
    pieces = F.when(text.rlike(assign), F.split(text, assign, -1)).otherwise(F.array(text))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans(text, assign), lambda s: s["end"]))
    token = lambda piece, s: F.substr(piece, s["start"] + 1, s["end"] - s["start"])

    def of_piece(piece: Column, begin: Column) -> Column:
        return F.transform(spans(piece, CANDIDATE), lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end"), token(piece, s).alias("token")))

    found = F.flatten(F.zip_with(pieces, begins, of_piece))
    free = F.filter(found, lambda c: ~c["token"].rlike(BASE["hex"][0]) & ~c["token"].rlike(BASE["access"][0]))
    return F.when(text.rlike(CANDIDATE), free).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def _log10_tail(z: Column) -> Column:
    """log10 of P(Z < z) of the normal distribution: a logistic form near the middle, the asymptotic one below -5."""
    a = F.greatest(F.lit(-38.0), F.least(F.lit(8.0), z))
    middle = -F.log10(1 + F.exp(-a * (F.lit(1.5976) + 0.070566 * a * a)))
    far = (-a * a / 2 - F.ln(F.greatest(-a, F.lit(1.0)) * 2.5066282746310002)) / 2.302585092994046
    return F.when(a < -5, far).otherwise(middle)


def _two_sided(z: Column) -> Column:
    """ln of P(|Z| > |z|), at least 1e-300 and at most 1."""
    return F.least(F.lit(0.0), (_log10_tail(-F.abs(z)) + 0.30102999566398120) * 2.302585092994046)


def battery(token: Column) -> Column:
    """Struct (encoding, n, score) of a candidate token; score is -log10 of the p-value of "an ordinary name", at least 0.

    The encoding is the narrowest of ``ENCODINGS`` that all characters fit; tokens without a letter or without a digit are words or
    numbers and get none. The symbols are numbers of the encoding's alphabet, K letters long. Three tests hold the token against random
    symbols: (1) chi-squared of the symbol counts, its deviate by the Wilson-Hilferty cube root; (2) the runs above and below the middle of the
    alphabet; (3) the lag-one serial correlation. Fisher's method makes one p-value, r, of the three. The chi-squared is also held against
    what ordinary names of that length give (non-central, ``ORDINARY`` a character), with the p-value o. The token's p-value is o / r: small if the counts are far
    from an ordinary name's, and larger the more the battery speaks against chance, so sequences and repetitions are no secrets.
    """
    core = F.regexp_replace(token, "=+$", "")
    mixed = core.rlike("[0-9]") & core.rlike("[A-Za-z]")
    enc = F.lit(None).cast("string")
    for name, _, pattern in reversed(ENCODINGS):
        enc = F.when(core.rlike(pattern), F.lit(name)).otherwise(enc)
    enc = F.when(mixed, enc)
    of = lambda values: F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), enc)
    alphabet = of({name: letters for name, letters, _ in ENCODINGS})
    plain = F.translate(F.when(enc == "hex", F.lower(core)).otherwise(core), "-_", "+/")
    base = F.array(F.struct(enc.alias("encoding"), alphabet.alias("alphabet"), of(ORDINARY).alias("ordinary"), F.split(plain, "").alias("chars")))
    coded = F.transform(base, lambda t: F.struct(t["encoding"].alias("encoding"), F.length(t["alphabet"]).cast("double").alias("k"), t["ordinary"].alias("ordinary"), F.transform(t["chars"], lambda c: F.position(c, t["alphabet"]).cast("double")).alias("x")))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)

    def sums(t: Column) -> Column:
        x, n = t["x"], F.size(t["x"]).cast("double")
        counts = F.transform(F.array_distinct(x), lambda d: F.pow(F.size(F.filter(x, lambda y: y == d)), F.lit(2.0)))
        side = F.transform(x, lambda v: (v > t["k"] / 2).cast("double"))
        turns = F.zip_with(F.slice(side, 2, F.size(side)), F.slice(side, 1, F.size(side) - 1), lambda a, b: (a != b).cast("double"))
        return F.struct(t["encoding"].alias("encoding"), t["k"].alias("k"), t["ordinary"].alias("ordinary"), x.alias("x"), n.alias("n"), (t["k"] / n * total(counts) - n).alias("x2"), total(side).alias("n1"), (total(turns) + 1).alias("runs"), (total(x) / n).alias("mean"))

    def tests(t: Column) -> Column:
        n, df, n1, n2 = t["n"], t["k"] - 1, t["n1"], t["n"] - t["n1"]
        off = F.transform(t["x"], lambda v: v - t["mean"])
        lag = total(F.zip_with(F.slice(off, 2, F.size(off)), F.slice(off, 1, F.size(off) - 1), lambda a, b: a * b))
        serial = F.try_divide(lag, total(F.transform(off, lambda v: v * v))) * F.sqrt(n)
        expected = 2 * n1 * n2 / n + 1
        runs = F.try_divide(t["runs"] - expected, F.sqrt((expected - 1) * (expected - 2) / (n - 1)))
        uniform = (F.pow(F.greatest(t["x2"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        excess = t["ordinary"] * n
        ordinary = (t["x2"] - df - excess) / F.sqrt(2 * (df + 2 * excess))
        # Without any variation runs and correlation are not defined: as far from chance as can be.
        logs = _two_sided(uniform) + _two_sided(F.coalesce(runs, F.lit(9.0))) + _two_sided(F.coalesce(serial, F.lit(9.0)))
        fisher = (logs + F.ln(1 - logs + logs * logs / 2)) / 2.302585092994046
        score = F.greatest(F.lit(0.0), fisher - _log10_tail(ordinary))
        return F.struct(t["encoding"].alias("encoding"), n.cast("int").alias("n"), score.alias("score"))

    return F.element_at(F.transform(F.transform(coded, sums), tests), 1)


def _stratum(n: Column) -> Column:
    """Length classes of tokens; false discoveries are controlled in each, for long tokens can give more evidence."""
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).otherwise(3)


def discovery_limits(scored: DataFrame, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg by length class: the least score, in steps of 1 / ``STEPS``, whose expected share of false finds is ``rate``.

    ``scored``: class, bin. The histogram has at most 4 x ``MOST`` rows for any input; four numbers reach the driver.
    """
    counts = scored.groupBy("class", "bin").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy("class")
    least = all_.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumns({"above": F.sum("n").over(least), "m": F.sum("n").over(all_)})
    good = c.where((F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / STEPS) <= F.lit(rate) * F.col("above")))
    return {r[0]: r[1] for r in good.groupBy("class").agg(F.min("bin")).collect()}


def _sortable(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Find secrets in whole texts: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, sorted by start, then kind as listed, joined by commas. The base kinds are those of ``BASE``;
    ``random`` spans come from ``battery`` on every candidate token that no base span covers, kept by ``discovery_limits``.
    base_sha256 is of the base spans alone, that of the empty string without any.

    One pass over the texts, no shuffle of rows: what is found is written, without the texts, to the shared folder, for the limits need all
    candidates. Null and empty texts have no spans. Null ids and repeated rows are scanned each; empty tables give no rows. Other columns are not used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"))
    for kind, (pattern, group, least) in BASE.items():
        found = found.withColumn(kind, spans(F.col("text"), pattern, group, least))
    found = found.withColumn("_c", candidates(F.col("text")))
    scored = F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["token"]).alias("t")))
    scored = F.filter(scored, lambda c: c["t"]["encoding"].isNotNull())
    bin_ = lambda s: F.least(F.lit(MOST), F.floor(s * STEPS)).cast("int")
    scored = F.transform(scored, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _stratum(c["t"]["n"]).alias("class"), bin_(c["t"]["score"]).alias("bin")))
    found = staged(found.select("doc_id", *BASE, F.when(F.size("_c") > 0, scored).alias("_c")), "secrets")
    limits = discovery_limits(found.select(F.explode("_c").alias("c")).select("c.class", "c.bin"), rate)
    limit = F.lit([limits.get(k, MOST + 1) for k in range(4)])
    kinds = [_sortable(F.col(k), i, k) for i, k in enumerate(BASE)]
    chosen = F.filter(F.coalesce("_c", F.array().cast("array<struct<start:int,end:int,class:int,bin:int>>")), lambda c: c["bin"] >= F.element_at(limit, c["class"] + 1))
    extra = _sortable(chosen, len(BASE), "random")
    line = lambda arrays: F.array_join(F.transform(F.array_sort(F.concat(*arrays)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(line(kinds), 256).alias("base_sha256"), line([*kinds, extra]).alias("spans"))
