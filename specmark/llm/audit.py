"""Interaction of filters: what each of them removes in every order in which they can be applied.

A document's failures are a bit mask. Per part, three rows of counts over the masks are stacked: all documents, those
labelled good and those labelled toxic. What a step of an order keeps, removes, finds removed already, and what only its
filter finds are sums over masks, so the stacked rows are multiplied by integer matrices with a row per mask and a column
per step of an order (32 by 600 for five filters). Documents meet in counts by (part, mask) with partial aggregation, at
most 32 rows per task and part; only these rows reach numpy, in tasks of their own.

``FILTERS`` are the five filters of the query; ``audit_masks`` takes masks of any filters, up to six.

A null text is the empty text, which fails A (under 200 words) and no other filter, but E where a smaller id has it too.
Null sources and the empty one are the same part. A null id is neither smaller than another nor larger, so such a row never
fails E, and has no labels. Repeated rows count as often as they occur; a row fails E only where an id below its own has the
text, so rows that repeat the smallest id do not. A document with several labels is good or toxic where one of them says
so. A very long text costs time in proportion to its length. An empty table has no parts and gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.llm.common import materialize, text_of

#: The filters by letter, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DIFFERENT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SIGNS = "[#$%&*|]"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def _words(text: Column) -> Column:
    """The words of a text; one sign splits faster than a pattern does."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of each document, by the five filters. Texts are read once, and do not move."""
    text = text_of("text")
    words = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_a_text"), _words(text).alias("_a_words"))
    n = F.size("_a_words")
    conditions = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("_a_words")) < MIN_DIFFERENT_PERCENT * n,
        100 * F.length(F.regexp_replace("_a_text", "[^A-Z]+", "")) > MAX_CAPITAL_PERCENT * F.length("_a_text"),
        F.col("_a_text").rlike(SIGNS),
    )
    own = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0))
    signals = words.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("_a_text", 256)).alias("digest"))
    signals = materialize(signals, "audit-signals")
    # joined by text and id together, so that a group of copies is dealt out
    first = signals.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("_a_first"))
    first = first.withColumnRenamed("digest", "_a_digest")
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    known = labels.groupBy(F.col("doc_id").alias("_a_id")).agg(is_one("quality"), is_one("toxic"))
    joined = signals.join(first, (F.col("digest") == F.col("_a_digest")) & (F.col("doc_id") == F.col("_a_first")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_a_first").isNull()
    return joined.join(known, F.col("doc_id") == F.col("_a_id"), "left").select(
        "part",
        (F.col("own") + F.when(copy, F.lit(1 << len(conditions))).otherwise(0)).alias("mask"),
        *(F.coalesce(c, F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))),
    )


def outcomes(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) pairs, and by outcome an integer matrix of a row per mask and a column per pair."""
    steps = [("".join(o), k) for o in permutations(letters) for k in range(1, len(letters) + 1)]
    bit = {x: 1 << k for k, x in enumerate(letters)}
    own = np.array([bit[o[k - 1]] for o, k in steps])
    before = np.array([sum(bit[x] for x in o[: k - 1]) for o, k in steps])
    masks = np.arange(1 << len(letters))[:, None]
    fails, gone = masks & own != 0, masks & before != 0
    tables = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    same_filter = own[:, None] == own[None, :]
    whole = {k: m.astype(np.int64) for k, m in tables.items()}
    return steps, whole | {"shapley": whole["removed"] @ same_filter.astype(np.int64)}


def audit_masks(masks: DataFrame, letters: str = FILTERS) -> DataFrame:
    """From part, mask, good and toxic (0 or 1) of each document: a row per part, order of the filters and step."""
    if not 1 <= len(letters) <= 6 or len(set(letters)) != len(letters):
        raise ValueError("one to six different filters")
    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # a list holds an entry per mask at most
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def multiply(batches):
        steps, matrices = outcomes(letters)
        orders, places = pa.array([o for o, _ in steps]), np.array([k for _, k in steps], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                parts, cells = batch.column(0).slice(at, 64), batch.column(1).slice(at, 64)
                n = len(parts)
                row, cell = np.asarray(cells.value_parent_indices()), cells.flatten()
                stacked = np.zeros((3, n, 1 << len(letters)), np.int64)
                mask = np.asarray(cell.field("mask"))
                for k, name in enumerate(("n", "good", "toxic")):
                    stacked[k, row, mask] = np.asarray(cell.field(name))
                every, good, toxic = stacked
                found = {k: every @ m for k, m in matrices.items()}
                found |= {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
                repeated = np.repeat(np.arange(n), len(steps))
                yield pa.RecordBatch.from_arrays(
                    [parts.take(pa.array(repeated)), orders.take(pa.array(np.tile(np.arange(len(steps)), n))), pa.array(np.tile(places, n)), *(pa.array(found[c].ravel()) for c in COUNTS)],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return rows.mapInArrow(multiply, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over all documents: part, filter_order, step and the counts."""
    return audit_masks(failures(docs, labels))


ORACLE_SQL = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k, o[k] AS own, o[1:k - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, o, k, own, good, toxic, fails = own AS alone, contains(fails, own) AS hit, translate(fails, before, '') <> fails AS gone FROM f, s),
c AS (SELECT part, o, k, own, count(*) FILTER (WHERE NOT hit AND NOT gone) AS kept, count(*) FILTER (WHERE hit AND NOT gone) AS removed,
  count(*) FILTER (WHERE hit AND gone) AS redundant, count(*) FILTER (WHERE alone) AS unique_fails,
  count(*) FILTER (WHERE hit AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (WHERE hit AND NOT gone AND toxic = 1) AS toxic_lost
  FROM r GROUP BY part, o, k, own)
SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c"""
