"""Marker sets of two corpora and the dashboard's items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.functions.domains import DASHBOARD_LABELS, DASHBOARD_NONE, EMOTION_COLUMNS, OTHER
from specmark.functions.text import trim_all


def is_designee(mode: Column) -> Column:
    """F16."""
    return F.lower(trim_all(mode)) == "designee"


def marker_set(markers: DataFrame) -> DataFrame:
    """distinct markers in lower case, trimmed, of more than two code points."""
    value = F.lower(trim_all(F.col("marker_value").cast("string")))
    # distinct before and after: few values are left to trim, and what trimming makes equal is one
    return markers.select("marker_value").distinct().select(value.alias("marker")).filter(F.length("marker") > 2).distinct()


def compare(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """What both have, what one alone has, and all."""
    return {
        "intersect": left.intersect(right),
        "except_left": left.subtract(right),
        "except_right": right.subtract(left),
        "union": left.union(right).distinct(),
    }


def set_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """A15, in one shuffle: each marker with the sides that have it."""
    both = left.select("marker", F.lit(1).alias("side")).union(right.select("marker", F.lit(2).alias("side")))
    sides = both.groupBy("marker").agg(F.bit_or("side").alias("sides"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    s = F.col("sides")
    return sides.agg(
        count(s.bitwiseAND(1) == 1).alias("n_left"), count(s.bitwiseAND(2) == 2).alias("n_right"), count(s == 3).alias("n_both"),
        count(s == 1).alias("n_left_only"), count(s == 2).alias("n_right_only"), F.count(F.lit(1)).alias("n_all"),
    )


def french_order(column: str = "marker") -> list[Column]:
    """As a French dictionary has it (accents and case decide between words of the same letters only), then by code points."""
    return [F.collate(F.col(column), "fr"), F.col(column)]


def sample_markers(markers: DataFrame, n: int = 30) -> DataFrame:
    """O4, in a fixed order."""
    return markers.orderBy("marker").limit(n)


def dashboard_label(emotion: Column) -> Column:
    """The label of what an annotator wrote; null for none, and anything else with a capital."""
    clean = F.lower(trim_all(emotion))
    known = F.create_map(*(F.lit(x) for pair in DASHBOARD_LABELS.items() for x in pair))
    return F.when(clean.isin(*DASHBOARD_NONE), None).otherwise(
        F.coalesce(known[clean], F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)))
    )


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """columns, each computed once for a row however often what follows mentions it: projections do not merge over a generator."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def _labelled(rows: DataFrame, labels: Column, corpus: str) -> DataFrame:
    folded = F.transform("_labels", lambda e: F.when(e.isin(*EMOTION_COLUMNS), e).otherwise(F.lit(OTHER)))
    emotions = F.when(F.size("_labels") == 0, F.array(F.lit(OTHER))).otherwise(F.array_distinct(folded))
    value = F.lower(trim_all(F.col("marker_value").cast("string")))
    own = _once(rows, value.alias("marker"), labels.alias("_labels"))
    named = own.select("marker", F.lit(corpus).alias("corpus"), F.explode(emotions).alias("emotion"))
    return named.filter((F.length("marker") > 2) & (F.col("marker") != "nan"))


def items_of_annotations(markers: DataFrame, corpus: str = "Glozz") -> DataFrame:
    """(marker, corpus, emotion) of designated markers, by both categories."""
    pair = F.array_distinct(F.array_compact(F.array(dashboard_label(F.col("categorie1")), dashboard_label(F.col("categorie2")))))
    kinds = markers.select("mode", "categorie1", "categorie2", "marker_value").distinct()
    return _labelled(kinds.filter(is_designee(F.col("mode"))), pair, corpus)


def items_of_table(markers: DataFrame, corpus: str = "XLSX") -> DataFrame:
    """The same from one-hot columns."""
    flags = [F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in EMOTION_COLUMNS if c in markers.columns]
    kinds = markers.filter(F.col("`Désignée`") == 1).select(*(F.col(f"`{c}`") for c in EMOTION_COLUMNS if c in markers.columns), "marker_value").distinct()
    return _labelled(kinds, F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>"), corpus)


def dashboard_sets(*items: DataFrame) -> DataFrame:
    """Marker, sorted corpora, sorted emotions. Distinct triples first, so a frequent marker sends few rows."""
    every = reduce(lambda a, b: a.unionByName(b), items).distinct()
    return every.groupBy("marker").agg(F.sort_array(F.collect_set("corpus")).alias("corpora"), F.sort_array(F.collect_set("emotion")).alias("emotions"))


def dashboard_filter(sets: DataFrame, corpus: str = "all", emotion: str | None = None) -> DataFrame:
    """F19. corpus: all, both, only:<name>, or a name that the marker's corpora contain."""
    rows = sets
    if corpus == "both":
        rows = rows.filter(F.size("corpora") == 2)
    elif corpus.startswith("only:"):
        rows = rows.filter((F.size("corpora") == 1) & (F.col("corpora")[0] == corpus[5:]))
    elif corpus != "all":
        rows = rows.filter(F.array_contains("corpora", corpus))
    return rows.filter(F.array_contains("emotions", emotion)) if emotion else rows
