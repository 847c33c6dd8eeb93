"""Secret scans through a trigram inverted index (native).

From each rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs of trigrams that any match
must contain (folded to lower case). The index holds a posting (gram, document) for each trigram that some query
mentions; it is written, can be kept (``trigram_index``) and answers other rules as far as it holds their trigrams. Postings are
intersected per document with bit masks (one bit per trigram of a conjunction, combined by bit_or before and after the
shuffle), and only the candidates that are left are verified by the regular expression. Rules without mandatory trigrams
scan every text. So that the texts of all documents need not move to meet the candidates, those without the rarest
trigram of some conjunction, by the index's own counts, stay where they are.

Offsets are code points, end exclusive. Matches of a rule are leftmost and non-overlapping; those that are too short
are dropped after matching. What lies between and in the matches gives their offsets by sums in order, over rows of
numbers, so that a very long text with very many matches takes time in proportion to them. Null texts count as empty and
have no spans. Ties of spans go to the kind that is listed first. Repeated rows each get the same spans; unlike texts
under one id are told apart. An empty table gives no rows. Input columns other than doc_id and text are ignored by
``secret_spans`` and kept by ``redact_secrets``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.llm.common import computed_once, materialize, packed, text_of, unpacked


@dataclass(frozen=True)
class Rule:
    """kind, pattern, the fewest characters that the group must have."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three kinds of the contract in its order. A run of 24 or more is what a run of any length and a
#: later test of its length find, so hex and access state the length in the pattern; assign must match first.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: What the method adds: formats of issued credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # to the END line, or else over the lines of base64 that follow (the last may be short), line breaks escaped or not
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
        r"|(?:(?:[\x20\x09-\x0D]|\\[nr])*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:(?:[\x20\x09-\x0D]|\\[nr])*+[A-Za-z0-9+/]{20,}+=*+)*+"
        r"(?:(?:[\x20\x09-\x0D]|\\[nr])*+[A-Za-z0-9+/]++=*+(?=[\x20\x09\r]*+(?![^\n\\])))?+)",
    ),
    Rule("url", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^@/:\x20\x09-\x0D]{3,64}@[A-Za-z0-9.-]{3,}"),
)
RULES = BASE_RULES + MORE_RULES

# --- from a pattern to a query: a query is a set of conjunctions, each a set of trigrams; {{}} holds for every text ---
_ALL = frozenset([frozenset()])
_MOST_STRINGS, _MOST_TERMS = 64, 64


def _grams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _either(a: frozenset, b: frozenset) -> frozenset:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > _MOST_TERMS:
        return a if len(a) <= len(b) else b  # one of the two alone is still mandatory
    return _either(frozenset(x | y for x in a for y in b), frozenset())


def _of_strings(strings: frozenset) -> frozenset:
    query = frozenset()
    for s in strings:
        query = _either(query, frozenset([_grams(s)]))
    return query


def _parts(tree) -> list:
    """The pattern as a list of string sets (what stands there exactly) and queries (what it at least contains)."""
    out = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append(("strings", frozenset([chr(arg).lower()])))
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            out.append(("strings", frozenset(chr(a).lower() for _, a in arg)))
        elif op is C.SUBPATTERN:
            out += _parts(arg[3])
        elif op is C.BRANCH:
            sides = [_merge(_parts(side)) for side in arg[1]]
            if all(len(s) == 1 and s[0][0] == "strings" for s in sides):
                out.append(("strings", frozenset().union(*(s[0][1] for s in sides))))
            else:
                query = frozenset()
                for side in arg[1]:
                    query = _either(query, _query(_parts(side)))
                out.append(("query", query))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner = _merge(_parts(body))
            if (low, high) == (0, 1) and len(inner) == 1 and inner[0][0] == "strings":
                out.append(("strings", inner[0][1] | {""}))
            elif low and len(inner) == 1 and inner[0][0] == "strings":
                out += [inner[0]] * min(low, 3) + [("query", _ALL)]  # it begins like this and goes on somehow
            else:
                out.append(("query", _query(_parts(body)) if low else _ALL))
        else:
            out.append(("query", _ALL))
    return out


def _merge(parts: list) -> list:
    """Neighbouring string sets joined while they stay few."""
    out: list = []
    for kind, x in parts:
        if kind == "strings" and out and out[-1][0] == "strings" and len(out[-1][1]) * len(x) <= _MOST_STRINGS:
            out[-1] = ("strings", frozenset(a + b for a in out[-1][1] for b in x))
        else:
            out.append((kind, x))
    return out


def _query(parts: list) -> frozenset:
    query = _ALL
    for kind, x in _merge(parts):
        query = _both(query, _of_strings(x) if kind == "strings" else x)
    return query


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Conjunctions of trigrams of which each match contains one; None if the pattern has no mandatory trigrams."""
    query = _query(_parts(P.parse(pattern.replace("(?i:", "(?:"))))
    return None if frozenset() in query else sorted(sorted(x) for x in query)


def trigrams(rules: tuple[Rule, ...]) -> frozenset[str]:
    """Every trigram that a query of the rules mentions."""
    return frozenset(g for rule in rules for grams in trigram_query(rule.pattern) or [] for g in grams)


def _terms(rules: tuple[Rule, ...], known: frozenset[str]) -> list[tuple[int, int, list[str]]]:
    """(rule, conjunction, trigrams) as far as an index of the known trigrams can tell; none of rules that must be scanned."""
    out = []
    for r, rule in enumerate(rules):
        told = [[g for g in grams if g in known] for grams in trigram_query(rule.pattern) or []]
        if all(told):
            out += [(r, c, grams) for c, grams in enumerate(told)]
    return out


# --- spans ---
_MATCHES = "array<struct<kind:int,nth:int,gap:int,len:int,ok:boolean>>"


def _matches(text: str, rule: Rule, order: int) -> Column:
    """The matches of a rule in order: what lies before each since the last, its length, and whether it is long enough."""
    t, p = F.col(text), F.lit(rule.pattern)
    lengths = lambda xs: F.transform(xs, F.length)
    matched, measured = F.regexp_extract_all(t, p, F.lit(0)), F.regexp_extract_all(t, p, F.lit(rule.group))
    both = F.zip_with(lengths(matched), lengths(measured), lambda n, m: F.struct(n.alias("len"), (m >= rule.least).alias("ok")))
    gaps = lengths(F.slice(F.split(t, rule.pattern, -1), F.lit(1), F.size(matched)))
    rows = F.zip_with(gaps, both, lambda g, x: F.struct(g.alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))
    listed = F.transform(rows, lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok")))
    return F.when(F.regexp_like(t, p), listed).otherwise(F.array().cast(_MATCHES))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_s_id"), text_of().alias("_s_text")).select("*", F.xxhash64("_s_text").alias("_s_key"))


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (_s_gram, _s_id, _s_key) for each trigram that a query mentions."""
    grams = sorted(trigrams(rules))
    folded = _keyed(docs).select("_s_id", "_s_key", F.lower("_s_text").alias("_s_folded"))
    held = F.filter(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: F.contains(F.col("_s_folded"), g))
    return folded.select("_s_id", "_s_key", F.explode(held).alias("_s_gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES, known: frozenset[str] = trigrams(RULES)) -> DataFrame:
    """_s_id, _s_key and the numbers of the rules whose query the postings satisfy."""
    terms = [(g, r, c, 1 << i, (1 << len(gs)) - 1) for r, c, gs in _terms(rules, known) for i, g in enumerate(gs)]
    schema = "_t_gram string, _t_rule int, _t_conj int, _t_bit bigint, _t_full bigint"
    table = index.sparkSession.createDataFrame(terms, schema)  # as many rows as the rules have trigrams
    return (
        index.join(F.broadcast(table), F.col("_s_gram") == F.col("_t_gram"))
        .groupBy("_s_id", "_s_key", "_t_rule", "_t_conj")
        .agg(F.bit_or("_t_bit").alias("_bits"), F.first("_t_full").alias("_full"))
        .filter(F.col("_bits") == F.col("_full"))
        .groupBy(F.col("_s_id").alias("_c_id"), F.col("_s_key").alias("_c_key"))
        .agg(F.collect_set("_t_rule").alias("_c_rules"))
    )


def probes(index: DataFrame, rules: tuple[Rule, ...] = RULES, known: frozenset[str] = trigrams(RULES)) -> list[str]:
    """The rarest trigram of each conjunction; the index's counts are as many as the rules have trigrams."""
    terms = [gs for _, _, gs in _terms(rules, known)]
    wanted = sorted({g for gs in terms for g in gs})
    counts = {r["_s_gram"]: r["count"] for r in index.filter(F.col("_s_gram").isin(wanted)).groupBy("_s_gram").count().collect()}
    rarest = (min(gs, key=lambda g: (counts.get(g, 0), g)) for gs in terms)
    return sorted({g for g in rarest if g in counts})


def _any_of(text: Column, grams: list[str]) -> Column:
    folded = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(folded, F.lit(g)) for g in grams), F.lit(False))


def _scanned(rules: tuple[Rule, ...], known: frozenset[str]) -> list[int]:
    return sorted(set(range(len(rules))) - {r for r, _, _ in _terms(rules, known)})


def span_rows(docs: DataFrame, rules: tuple[Rule, ...], index: DataFrame, known: frozenset[str]) -> DataFrame:
    """_s_id, _s_key, kind, start, end of all spans, once for each different row."""
    keyed, scanned = _keyed(docs), _scanned(rules, known)
    none = F.array().cast(_MATCHES)
    everywhere = keyed.select("_s_id", "_s_key", F.inline(F.concat(none, *(_matches("_s_text", rules[i], i) for i in scanned))))
    same = F.col("_s_id").eqNullSafe(F.col("_c_id")) & (F.col("_s_key") == F.col("_c_key"))
    met = keyed.filter(_any_of(F.col("_s_text"), probes(index, rules, known))).join(candidates(index, rules, known), same)
    own = (F.when(F.array_contains("_c_rules", i), _matches("_s_text", r, i)).otherwise(none) for i, r in enumerate(rules) if i not in scanned)
    verified = met.select("_s_id", "_s_key", F.inline(F.concat(none, *own)))
    once = everywhere.unionByName(verified).groupBy("_s_id", "_s_key", "kind", "nth").agg(F.first("gap").alias("gap"), F.first("len").alias("len"), F.first("ok").alias("ok"))
    upto = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("_s_id", "_s_key", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    return once.withColumn("end", upto.cast("int")).filter("ok").select("_s_id", "_s_key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None, indexed: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans and all spans as text. index: one that was kept,
    made for the rules ``indexed``; rules that its trigrams tell nothing of are scanned."""
    n = len(BASE_RULES)
    if index is None:
        index, indexed = materialize(trigram_index(docs, rules), "secret-postings"), rules
    rows = span_rows(docs, rules, index, trigrams(indexed))
    per = rows.groupBy(F.col("_s_id").alias("_p_id"), F.col("_s_key").alias("_p_key")).agg(
        *(F.count_if(F.col("kind") == k).alias(f"_p_n{k}") for k in range(n)),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_p_spans"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    keyed = _keyed(docs).select("_s_id", "_s_key").join(per, F.col("_s_id").eqNullSafe(F.col("_p_id")) & (F.col("_s_key") == F.col("_p_key")), "left")
    spans = F.coalesce("_p_spans", none)
    return keyed.select(
        F.col("_s_id").alias("doc_id"),
        *(F.coalesce(f"_p_n{k}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] < n), rules), 256).alias("base_sha256"),
        _joined(spans, rules).alias("spans"),
    )


#: A text is cut in parts of so many code points, in which places are counted off.
_PART = 1024


def _piece(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in parts."""
    first = F.floor(start / _PART).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.greatest(F.floor((end - 1) / _PART).cast("int") - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(held, F.pmod(start, F.lit(_PART)) + 1, end - start)).otherwise("")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by [kind] and n_chars, if there, set anew. Overlapping spans go as one, by the kind of
    the first. Only texts that may hold one move."""
    index, known = materialize(trigram_index(docs.select("doc_id", "text"), rules), "secret-postings"), trigrams(rules)
    text = text_of()
    may = reduce(lambda a, b: a | b, (F.regexp_like(text, F.lit(rules[i].pattern)) for i in _scanned(rules, known)), _any_of(text, probes(index, rules, known)))
    before = F.max("end").over(W.partitionBy("_s_id", "_s_key").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1))
    rows = span_rows(docs.select("doc_id", "text"), rules, index, known).withColumn("before", F.coalesce(before, F.lit(0)))
    # of what overlaps, the first span stands for all
    apart = F.when(F.col("start") >= F.col("before"), F.struct("start", "before", "kind"))
    cuts = rows.groupBy("_s_id", "_s_key").agg(F.sort_array(F.collect_list(apart)).alias("_s_cuts"), F.max("end").alias("_s_last"))
    names = F.array(*(F.lit(r.kind) for r in rules))
    parts = F.col("_r_parts")
    hidden = F.transform("_s_cuts", lambda s: F.concat(_piece(parts, s["before"], s["start"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")))
    cleaned = F.concat(F.array_join(hidden, ""), _piece(parts, F.col("_s_last"), F.col("_r_length")))
    flagged = packed(docs.filter(may), F.col("doc_id").alias("_r_id"), text.alias("_r_text")).withColumn("_r_key", F.xxhash64("_r_text"))
    joined = flagged.join(cuts, F.col("_r_id").eqNullSafe(F.col("_s_id")) & (F.col("_r_key") == F.col("_s_key")), "left")
    cut = computed_once(
        joined, ["_row", "_s_cuts", "_s_last"],
        [F.when(F.col("_s_cuts").isNotNull(), F.regexp_extract_all("_r_text", F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))).alias("_r_parts"), F.length("_r_text").alias("_r_length")],
    )
    renewed = cut.select("_row", F.when(F.col("_s_cuts").isNotNull(), cleaned).alias("_r_new"))
    new = {"text": F.coalesce("_r_new", F.col("_row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_r_new").cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars"))
    return docs.filter(~may).unionByName(unpacked(renewed, docs.columns, **new))
