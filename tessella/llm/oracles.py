"""DuckDB SQL for the queries that SQL can express, over whole tables.

The others have positions of matches (6), hashes that SQL lacks (2, 10), tokens (8), page structure (3) or edit distance inside a text (5);
the tests hold them against brute force.
"""

from __future__ import annotations

from .quality import SYMBOLS
from .urlfilter import LOWER, PUBLIC_SUFFIXES, RULES, UPPER

_W = r"[^\x20\x09-\x0D]+"

OP1 = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, url, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
 f AS (SELECT s, min(page_id) AS first_ FROM d WHERE n >= 100 GROUP BY s HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest, CASE WHEN first_ IS NULL OR first_ = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first_ <> page_id THEN first_ END AS refers_to, url FROM d LEFT JOIN f USING (s)"""

_rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))


def _fits(text: str) -> str:
    h, _, p = text.partition("/")
    return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))"


def _kappa(level: str) -> str:
    """Prior strength of a level whose rows have n, bad and m."""
    return f"""(SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 200.0 ELSE greatest(2.0, least(200.0, 1 / rho - 1)) END FROM (SELECT sum((bad - n * c) * (bad - n * c) - n * c * (1 - c)) / nullif(sum(n * (n - 1) * c * (1 - c)), 0) AS rho
      FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, m)) AS c FROM {level})))"""


_suffixes = ", ".join(f"'{s}'" for s in PUBLIC_SUFFIXES)
_psi = "(ln({0} + 2) - 1 / (2 * ({0} + 2)) - 1 / (12 * ({0} + 2) ^ 2) - 1 / ({0} + 1) - 1 / {0})".format
_psi1 = "(1 / ({0} + 2) + 1 / (2 * ({0} + 2) ^ 2) + 1 / (6 * ({0} + 2) ^ 3) + 1 / ({0} + 1) ^ 2 + 1 / {0} ^ 2)".format
_psi2 = "(-1 / ({0} + 2) ^ 2 - 1 / ({0} + 2) ^ 3 - 1 / (2 * ({0} + 2) ^ 4) - 2 / ({0} + 1) ^ 3 - 2 / {0} ^ 3)".format
_Z = 1.645
_odds = f"({_psi('a')} - {_psi('b')} - {_Z} * sqrt({_psi1('a')} + {_psi1('b')}) + {(_Z * _Z - 1) / 6} * ({_psi2('a')} - {_psi2('b')}) / ({_psi1('a')} + {_psi1('b')}))"

OP4 = f"""WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN NULL ELSE substr(url, instr(url, '://') + 3) END AS r FROM pages),
 p AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
 o AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
 h0 AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(?::\\d*)?$', '') AS name, count(o.bad) AS n, coalesce(sum(o.bad), 0) AS bad FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host),
 h1 AS (SELECT *, regexp_matches(name, '^\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}$') OR starts_with(name, '[') AS address, regexp_extract(name, '[^.]+\\.[^.]*$') IN ({_suffixes}) AS two FROM h0),
 h AS (SELECT host, CASE WHEN address THEN '#' WHEN two THEN regexp_extract(name, '[^.]+\\.[^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix,
   CASE WHEN address THEN name WHEN two THEN regexp_extract(name, '(?:[^.]*\\.)?[^.]+\\.[^.]*$') ELSE regexp_extract(name, '(?:[^.]*\\.)?[^.]*$') END AS domain, n, bad FROM h1),
 s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY suffix), s2 AS (SELECT suffix, (k * m + bad) / (k + n) AS m FROM s, (SELECT {_kappa('s')} AS k)),
 d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h JOIN s2 USING (suffix) GROUP BY domain, suffix), d2 AS (SELECT domain, (k * m + bad) / (k + n) AS m FROM d, (SELECT {_kappa('d')} AS k)),
 g AS (SELECT host, n, bad, m FROM h JOIN d2 USING (domain)), g2 AS (SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM g, (SELECT {_kappa('g')} AS k)),
 b AS (SELECT host, round(1 / (1 + exp(-{_odds})), 9) AS bound FROM g2)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_fits(t)} THEN '{t}'" for _, t in _rules)} END AS rule,
 CASE {' '.join(f"WHEN {_fits(t)} THEN '{v}'" for v, t in _rules)} WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict FROM p JOIN b USING (host)"""

_symbols = "".join(f"\\{c}" for c in SYMBOLS)
OP7 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS w FROM t),
 g AS (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS pos FROM (SELECT doc_id, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS gs FROM w)),
 m AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1), r AS (SELECT doc_id, count(DISTINCT pos + k) AS rep FROM m, range(5) x(k) GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) AS full_, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_W}') GROUP BY doc_id),
 x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[{_symbols}]'))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
   coalesce(full_, 0) AS full_, len(regexp_extract_all(text, '\\p{{Lu}}')) AS upper_ FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
 y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words OR (full_ >= 4 AND 2 * n_dup_lines > full_) OR 2 * upper_ > greatest(word_chars, 1)) AS kept FROM y"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_W}') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS gs FROM w),
 g AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM s),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(gs)::BIGINT AS n_shingles, component_id, component_id = s.doc_id AS kept FROM s JOIN c ON c.id = s.doc_id"""
