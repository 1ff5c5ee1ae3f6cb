"""Host reputation by empirical Bayes, with hand-made host and path rules on top."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path): a rule fits its host and all subdomains below the path.
RULES: tuple[tuple[str, str], ...] = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(host)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


# Public suffixes of two labels under which names are registered; every last label is one too.
PUBLIC_SUFFIXES: tuple[str, ...] = tuple(
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk "
    "com.au edu.au gov.au id.au net.au org.au "
    "ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz "
    "ac.jp ad.jp co.jp ed.jp go.jp gr.jp lg.jp ne.jp or.jp "
    "ac.kr co.kr go.kr ne.kr or.kr re.kr "
    "ac.in co.in edu.in gov.in net.in org.in res.in "
    "ac.za co.za gov.za net.za org.za web.za "
    "com.br edu.br gov.br net.br org.br "
    "com.cn edu.cn gov.cn net.cn org.cn com.hk edu.hk gov.hk org.hk com.tw edu.tw gov.tw org.tw "
    "com.ar edu.ar gob.ar org.ar com.mx edu.mx gob.mx org.mx com.co edu.co gov.co com.pe com.ve "
    "com.tr edu.tr gov.tr org.tr ac.il co.il gov.il org.il com.sg edu.sg gov.sg com.my edu.my gov.my "
    "ac.id co.id go.id or.id web.id ac.th co.th go.th in.th or.th com.vn edu.vn gov.vn com.ph edu.ph gov.ph "
    "com.pl edu.pl gov.pl net.pl org.pl com.ua edu.ua gov.ua com.ru org.ru net.ru com.gr edu.gr com.pt edu.pt "
    "com.eg edu.eg com.sa edu.sa com.pk edu.pk com.ng edu.ng co.ke ac.ke".split()
)


def name_of(host: Column) -> Column:
    """The host without user name, port and final dot, by which it is registered."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(?::\d*)?$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") | name.startswith("[")


def suffix_of(host: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """The public suffix: the last two labels if they are one of ``suffixes``, else the last label. Addresses have the suffix "#"."""
    name = name_of(host)
    two = F.regexp_extract(name, r"[^.]+\.[^.]*$", 0)
    return F.when(_is_address(name), F.lit("#")).when(two.isin(list(suffixes)), two).otherwise(F.regexp_extract(name, r"[^.]*$", 0))


def domain_of(host: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """The registered domain: the public suffix with one label more, if there is one. An address is a domain of its own."""
    name = name_of(host)
    two = F.regexp_extract(name, r"[^.]+\.[^.]*$", 0)
    three = F.regexp_extract(name, r"(?:[^.]*\.)?[^.]+\.[^.]*$", 0)
    return F.when(_is_address(name), name).when(two.isin(list(suffixes)), three).otherwise(F.regexp_extract(name, r"(?:[^.]*\.)?[^.]*$", 0))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Equal lengths: the first by code point."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; keep larger lists in a table of hosts")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, low: float, high: float) -> float:
    """Prior strength by moments: the overdispersion of the groups' counts around their parents' means ``m``."""
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("m")))
    n, x = F.col("n"), F.col("bad")
    var = m * (1 - m)
    rho = groups.agg(F.try_divide(F.sum((x - n * m) * (x - n * m) - n * var), F.sum(n * (n - 1) * var))).first()[0]
    return high if rho is None or rho <= 0 else max(low, min(high, 1 / rho - 1))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """The lower quantile of a beta distribution, ``z`` normal deviations below its middle, on the scale of log odds: always between 0 and 1.

    The cumulants of the log odds are differences and sums of polygamma functions of a and b, taken by their expansions after a shift by two;
    the quantile is that of Cornish and Fisher with the skewness. Within 0.002 of the exact one if a and b are 1 at least.
    """
    power = lambda x, n: F.pow(x, F.lit(float(n)))
    psi = lambda x: F.ln(x + 2) - 1 / (2 * (x + 2)) - 1 / (12 * power(x + 2, 2)) - 1 / (x + 1) - 1 / x
    psi1 = lambda x: 1 / (x + 2) + 1 / (2 * power(x + 2, 2)) + 1 / (6 * power(x + 2, 3)) + 1 / power(x + 1, 2) + 1 / power(x, 2)
    psi2 = lambda x: -1 / power(x + 2, 2) - 1 / power(x + 2, 3) - 1 / (2 * power(x + 2, 4)) - 2 / power(x + 1, 3) - 2 / power(x, 3)
    var = psi1(a) + psi1(b)
    odds = psi(a) - psi(b) - F.lit(z) * F.sqrt(var) + F.lit((z * z - 1) / 6) * (psi2(a) - psi2(b)) / var
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))


def host_reputation(hosts: DataFrame, z: float = 1.645, low: float = 2.0, high: float = 200.0, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> DataFrame:
    """Posterior of the share of bad pages for each host.

    ``hosts``: one row a host with ``host``, ``n`` (labelled pages) and ``bad`` (bad ones among them); n may be 0.
    Beta-binomial shrinkage from the whole to suffix, from suffix to registered domain, from domain to host; each level's
    prior strength is fitted from its own overdispersion, between ``low`` and ``high`` pages. Returns host, rate (posterior
    mean) and bound (``lower_bound`` of the posterior at ``z`` deviations). No host: no rows. No labels: the prior everywhere (0.5 by a
    uniform prior). All sums are over hosts, so a hot host costs one row; four numbers reach the driver. ``hosts`` should be a
    staged table, since it is read several times.
    """
    h = hosts.withColumns({"suffix": suffix_of(F.col("host"), suffixes), "domain": domain_of(F.col("host"), suffixes)})
    n, bad = h.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    s = h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m", F.lit((bad + 1) / (n + 2)))
    mean = lambda kappa: ((F.lit(kappa) * F.col("m") + F.col("bad")) / (F.lit(kappa) + F.col("n"))).alias("m")
    s = s.select("suffix", mean(_strength(s, low, high)))
    d = h.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(s, "suffix")
    d = d.select("domain", mean(_strength(d, low, high)))
    h = h.join(d, "domain")
    kappa = F.lit(_strength(h, low, high))
    a = kappa * F.col("m") + F.col("bad")
    b = kappa * (1 - F.col("m")) + F.col("n") - F.col("bad")
    return h.select("host", (a / (a + b)).alias("rate"), lower_bound(a, b, z).alias("bound"))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    limit: float = 0.3,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
    suffixes: Sequence[str] = PUBLIC_SUFFIXES,
) -> DataFrame:
    """Judge every page's URL: ``id_col``, host, path, rule, verdict (``allow`` or ``block``), bound.

    ``outcomes``: (id, bad): labelled pages, ``bad`` true, false or null (not labelled); an id labelled more than once is bad
    if one label says so. A page is blocked by the longest rule that fits, or, without one, when the lower posterior bound of
    its host's share of bad pages exceeds ``limit``: a host is blocked on evidence, never on its prior alone.

    ``suffixes``: the public suffixes of two labels under which names are registered; a full list can be given.

    A null URL or one without ``://``: host and path are empty and the host counts as one group. Repeated rows are judged each.
    A null id is judged by its host. Empty tables give no rows. Other columns of ``pages`` are not used, whatever their names.
    """
    p = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    o = outcomes.select(F.col(outcomes.columns[0]).alias("_oid"), F.col(outcomes.columns[1]).cast("int").alias("_bad"))
    o = o.where(F.col("_bad").isNotNull() & F.col("_oid").isNotNull()).groupBy("_oid").agg(F.max("_bad").alias("_bad"))
    labelled = p.select(id_col, "host").join(o, F.col(id_col) == F.col("_oid"), "left")
    hosts = staged(labelled.groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")), "hosts")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    reputation = host_reputation(hosts, z, suffixes=suffixes).select(F.col("host").alias("_host"), "bound")
    out = p.join(reputation, F.col("host") == F.col("_host"))
    own = F.when(F.round("bound", 9) > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")
