"""DuckDB SQL for the operators whose results SQL can express in full (license scans state theirs beside the method)."""

from __future__ import annotations

from math import log

from specmark.llm import audit, licenses, quality, secrets


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The rule of private keys without possessive quantifiers and looking ahead: the span is one of the groups, and what ends the
#: line of a short last part is matched after it.
_SPACES = r"(?:[\x20\x09-\x0D]|\\[nr])*"
_KEY = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_WHOLE = r"[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,20}PRIVATE KEY-----"
_LINES = rf"(?:{_SPACES}(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:{_SPACES}[A-Za-z0-9+/]{{20,}}=*)*"
PLAIN = {"pem": rf"({_KEY}{_WHOLE})|({_KEY}{_LINES}{_SPACES}[A-Za-z0-9+/]+=*)[\x20\x09\r]*(?:\n|\\|$)|({_KEY}{_LINES})"}


def secret_spans_sql(rules: tuple[secrets.Rule, ...] = secrets.RULES) -> str:
    """Every rule over every text: a match begins after the pieces and the matches before it."""

    def one(k: int, rule: secrets.Rule) -> str:
        p = _quoted(PLAIN.get(rule.kind, rule.pattern))
        found = lambda g: f"regexp_extract_all(t, {p}, {g})"
        x = f"list_transform(range(1, len({found(0)}) + 1), lambda i: coalesce({found(1)}[i], {found(2)}[i], {found(3)}[i]))" if rule.kind in PLAIN else found(0)
        return (
            f"SELECT doc_id, {k} AS k, {_quoted(rule.kind)} AS kind, {rule.least} AS least, {found(0)} AS m, {x} AS x,"
            f" {x if rule.kind in PLAIN else found(rule.group)} AS g, regexp_split_to_array(t, {p}) AS s FROM d WHERE regexp_matches(t, {p})"
        )

    base = secrets.BASE_RULES
    found = "\n  UNION ALL ".join(one(k, r) for k, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(base))
    numbers = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in base)
    span = "kind || ':' || b || ':' || (b + n)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
a AS (SELECT doc_id, k, kind, length(array_to_string(s[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS b, length(x[i]) AS n
  FROM i WHERE length(g[i]) >= least),
j AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY b, k) FILTER (WHERE k < {len(base)}) AS base,
  string_agg({span}, ',' ORDER BY b, k, n) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {numbers}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.doc_id = j.doc_id"""


SUBSTRINGS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM s),
o AS (SELECT g, min(doc_id) AS owner FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g JOIN o ON g.g = o.g WHERE doc_id > owner),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

def quality_sql(min_group: int = 50) -> str:
    """The base rule, the sketches as counts in logarithmic buckets, and the fences of the three levels."""
    names = [s.name for s in quality.SIGNALS]
    value = lambda b: f"CASE WHEN {b} < 0 THEN 0 ELSE {quality.LEAST} * pow({quality.GAMMA!r}, {b}) * {2 / (quality.GAMMA + 1)!r} END"

    def level(name: str, *keys: str) -> str:
        by = "".join(f"{k}, " for k in keys)
        return f"""{name}n AS (SELECT {by}s, b, sum(n) AS n FROM k GROUP BY {by}s, b),
{name}c AS (SELECT {by}s, b, sum(n) OVER (PARTITION BY {by}s ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}s) AS n FROM {name}n),
{name}q AS (SELECT {by}s, max(n) AS n, min(b) FILTER (WHERE upto > floor(0.25 * (n - 1))) AS lo, min(b) FILTER (WHERE upto > floor(0.75 * (n - 1))) AS hi FROM {name}c GROUP BY {by}s),
{name} AS (SELECT {by}s, n, {value("lo")} AS lo, {value("hi")} AS hi FROM {name}q)"""

    at = lambda t: f"{t}.hi + {quality.REACH} * greatest({t}.hi - {t}.lo, {quality.LEAST_SHARE} * coalesce(usual, 0), {2 * quality.ACCURACY} * {t}.hi)"
    values = " UNION ALL ".join(f"SELECT lang, source, t, {i} AS s, {n} AS v FROM m WHERE NOT base_failed" for i, n in enumerate(names))
    noise = lambda n: f"coalesce(({n} - {quality.NOISE} * sqrt({n})) / nullif(word_chars, 0), 0)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
x AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM p) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, source, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) AS n_signs,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, 1 - ln(len(list_distinct(ws)) + 1) / ln(greatest(len(ws), 1) + 1) AS monotony
  FROM w LEFT JOIN x ON w.r = x.r),
m AS (SELECT *, n_signs / nullif(word_chars, 0) AS sign_ratio, n_upper / nullif(word_chars, 0) AS upper_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
v AS (SELECT DISTINCT lang, source, t, s, v FROM ({values})),
k AS (SELECT lang, source, s, CASE WHEN v < {quality.LEAST} THEN -1 ELSE CAST(ceil(ln(v / {quality.LEAST}) / {log(quality.GAMMA)!r}) AS INT) END AS b, count(*) AS n FROM v GROUP BY ALL),
{level("a")},
{level("l", "lang")},
{level("e", "lang", "source")},
un AS (SELECT s, CASE WHEN hi - lo < {quality.LEAST} THEN -1 ELSE CAST(ceil(ln((hi - lo) / {quality.LEAST}) / {log(quality.GAMMA)!r}) AS INT) END AS b, sum(n) AS n
  FROM e WHERE n >= {min_group} GROUP BY ALL),
uc AS (SELECT s, b, sum(n) OVER (PARTITION BY s ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY s) AS n FROM un),
u AS (SELECT s, {value("min(b) FILTER (WHERE upto > floor(0.5 * (n - 1)))")} AS usual FROM uc GROUP BY s),
fence AS (SELECT e.lang, e.source, e.s,
  CASE WHEN e.n >= {min_group} THEN {at("e")} WHEN l.n >= {min_group} THEN {at("l")} ELSE a.hi + {quality.REACH} * greatest(a.hi - a.lo, {2 * quality.ACCURACY} * a.hi) END AS f
  FROM e JOIN l ON e.s = l.s AND e.lang IS NOT DISTINCT FROM l.lang JOIN a ON e.s = a.s LEFT JOIN u ON e.s = u.s),
z AS (SELECT lang, source, {", ".join(f"max(f) FILTER (WHERE s = {i}) AS f{i}" for i in range(len(names)))} FROM fence GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join(f"{noise(s.count) if s.count else s.name} > f{i}" for i, s in enumerate(quality.SIGNALS))}) AS kept
FROM m LEFT JOIN z ON m.lang IS NOT DISTINCT FROM z.lang AND m.source IS NOT DISTINCT FROM z.source"""


ORACLES = {
    "op2_secret_scans": secret_spans_sql(),
    "op3_license_scans": licenses.ORACLE_SQL,
    "op5_quality_rules": quality_sql(),
    "op8_substring_dedup": SUBSTRINGS,
    "op13_filter_audit": audit.ORACLE_SQL,
}
