"""Class probabilities and Shannon entropy of markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.functions.domains import MODES
from specmark.operators.moments import deviation, merge_moments, moment_states
from specmark.sources.store import kept

KEYS = ["marker_value", "marker_type"]


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def _sum(columns: list[Column], start) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(start))


def _number_of(column: str, names: Sequence[str]) -> Column:
    """The place of a value among names, null for any other."""
    return F.coalesce(*(F.when(F.col(column) == c, F.lit(i)) for i, c in enumerate(names)))


def _counts(markers: DataFrame, condition: str, valid: Sequence[str], *more: Column) -> DataFrame:
    """Per marker: a count for each class (by its number), and more. One shuffle, of a row per marker and task."""
    rows = markers.filter(F.col("marker_value").isNotNull() & F.col("marker_type").isNotNull()).withColumn("_k", _number_of(condition, valid))
    return rows.groupBy(*KEYS).agg(*(F.count_if(F.col("_k") == i).alias(f"_c{i}") for i in range(len(valid))), *more)


def class_counts(markers: DataFrame, condition: str, valid: Sequence[str]) -> DataFrame:
    """Counts per marker and class and their total."""
    counts = _counts(markers.filter(F.col(condition).isin(*valid)), condition, valid)
    total = _sum([F.col(f"_c{i}") for i in range(len(valid))], 0).cast("long")
    return counts.select(*KEYS, *(F.col(f"_c{i}").alias(c) for i, c in enumerate(valid)), total.alias("total_count"))


def with_entropy(counts: DataFrame, valid: Sequence[str]) -> DataFrame:
    """A5-A7. The sum is taken away from zero, so that a marker of one class has 0 and not -0."""
    p = counts.select("*", *((q(c) / q("total_count")).alias(f"P({c})") for c in valid))
    terms = [F.when(q(f"P({c})") > 0, q(f"P({c})") * F.log2(q(f"P({c})"))).otherwise(0.0) for c in valid]
    bits = F.lit(0.0) - _sum(terms, 0.0)
    most = log2(len(valid)) if len(valid) > 1 else 1.0
    return p.withColumn("entropy", bits).withColumn("normalized_entropy", F.col("entropy") / F.lit(most))


def conditional_entropy(markers: DataFrame, condition: str, valid: Sequence[str], min_freq: int = 3) -> DataFrame:
    """One row per marker seen min_freq times in valid classes (F14); empty input gives an empty table of this schema."""
    return with_entropy(class_counts(markers, condition, valid).filter(F.col("total_count") >= min_freq), valid)


def by_entropy(entropy: DataFrame) -> DataFrame:
    """O1, with ties by marker and type."""
    return entropy.orderBy(F.desc("entropy"), *KEYS)


def extreme(entropy: DataFrame, n: int = 10, highest: bool = False) -> DataFrame:
    """O2."""
    return entropy.orderBy(F.desc("entropy") if highest else F.asc("entropy"), *KEYS).limit(n)


#: Entropies are compared and ranked as rounded values, so that equal distributions tie whatever the order of their classes.
PLACES = 9


#: Modes that one number holds, a bit each.
BITS = 62


def entropy_of_modes(
    markers: DataFrame, condition: str, valid: Sequence[str], min_freq: int = 3, modes: Sequence[str] = MODES, column: str = "mode"
) -> DataFrame:
    """(mode, marker_value, marker_type, entropy) for each marker of each mode.

    The marker's counts and the modes that have it come from one aggregate, so there is neither a second pass nor a join.
    Modes are bits of as many numbers as they need; Spark's own bitmaps would take four kilobytes a marker for any number.
    """
    words = -(-len(modes) // BITS)
    own = markers.withColumn("_m", _number_of(column, modes))
    seen = own.filter(F.col(condition).isin(*valid) | F.col("_m").isNotNull())
    bit = lambda i: F.when(F.col("_m").between(i * BITS, i * BITS + BITS - 1), F.expr(f"shiftleft(1L, _m - {i * BITS})"))
    counts = _counts(seen, condition, valid, F.count("_k").alias("_total"), *(F.bit_or(bit(i)).alias(f"_w{i}") for i in range(words))).filter(F.col("_total") >= min_freq)
    # one array each, so that what follows is as short for hundreds of classes and modes as for four
    arrays = counts.select(*KEYS, "_total", F.array(*(f"_c{i}" for i in range(len(valid)))).alias("_n"), F.array(*(F.coalesce(f"_w{i}", F.lit(0).cast("long")) for i in range(words))).alias("_held"))
    p = lambda n: n / F.col("_total")
    bits = F.aggregate("_n", F.lit(0.0), lambda a, n: a + F.when(n > 0, p(n) * F.log2(p(n))).otherwise(0.0))
    held = F.expr(f"filter(sequence(0, {len(modes) - 1}), i -> (shiftright(_held[int(i / {BITS})], i % {BITS}) & 1L) = 1L)")
    rows = arrays.select(*KEYS, F.round(F.lit(0.0) - bits, PLACES).alias("entropy"), F.explode(held).alias("_m"))
    return rows.select(F.array(*(F.lit(m) for m in modes))[F.col("_m")].alias("mode"), *KEYS, "entropy")


def spectrum(of_modes: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """How many markers of each mode have each entropy: entropy, c0, c1, ... in the order of modes, and the counts up to and
    with it, u0, u1, ..., and in all, t0, t1, ...

    The counts are written and read back, so that tests and summaries plan and read a small table and not the markers. Prefix
    sums are taken over fixed ranges of entropies, then inside each range, so that no task sees more than a range: a
    thousandth of a bit, which holds a million different values at most, as entropies are rounded.
    """
    n = range(len(modes))
    held = of_modes.withColumn("_m", _number_of("mode", modes)).filter(F.col("_m").isNotNull() & F.col("entropy").isNotNull())
    per = kept(held.groupBy("entropy").agg(*(F.count_if(F.col("_m") == i).alias(f"c{i}") for i in n)), "spectrum")
    ranged = per.withColumn("_range", F.floor(F.col("entropy") * 1000))
    # as many rows as there are ranges: a thousand for each bit of entropy
    below, every = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    totals = ranged.groupBy("_range").agg(*(F.sum(f"c{i}").alias(f"s{i}") for i in n))
    before = totals.select(
        F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"s{i}").over(below), F.lit(0)).alias(f"b{i}") for i in n), *(F.sum(f"s{i}").over(every).alias(f"t{i}") for i in n)
    )
    within = W.partitionBy("_range").orderBy("entropy").rowsBetween(W.unboundedPreceding, 0)
    inside = ranged.select("*", *(F.sum(f"c{i}").over(within).alias(f"w{i}") for i in n))
    placed = inside.join(F.broadcast(before), F.col("_range") == F.col("_of")).select(
        "entropy", *(f"c{i}" for i in n), *((F.col(f"b{i}") + F.col(f"w{i}")).alias(f"u{i}") for i in n), *(f"t{i}" for i in n)
    )
    return kept(placed, "spectrum-placed")


def summarise_modes(of_modes: DataFrame, modes: Sequence[str] = MODES, population: bool = False) -> DataFrame:
    """A9 (sample deviation) or A10 (population): always a row per mode, with n = 0 and nulls where it has no marker."""
    return summary_of(spectrum(of_modes, modes), modes, population)


def summary_of(spectrum: DataFrame, modes: Sequence[str] = MODES, population: bool = False) -> DataFrame:
    """The same from a spectrum, read once: moments by merging, and medians where the counts reach half of all."""
    columns = lambda i: (F.lit(i).alias("_at"), F.col(f"c{i}").alias("_c"), F.col(f"u{i}").alias("_u"), F.col(f"t{i}").alias("_t"))
    long = spectrum.select("entropy", F.inline(F.array(*(F.struct(*columns(i)) for i in range(len(modes)))))).filter("_c > 0")
    # the two middle places; one where the number is odd
    at = lambda k: F.max(F.when((F.col("_u") >= k) & (F.col("_u") - F.col("_c") < k), F.col("entropy")))
    middle = [at(F.floor((F.col("_t") + 1) / 2)).alias("_low"), at(F.floor(F.col("_t") / 2) + 1).alias("_high")]
    states = moment_states(long, ["_at"], "entropy", F.col("_c"), more=middle)
    stats = merge_moments(states, ["_at"], more=[((F.max("_low") + F.max("_high")) / 2).alias("_median")])
    order = spectrum.sparkSession.createDataFrame(list(enumerate(modes)), "_mode int, mode string")
    return (
        F.broadcast(order).join(stats, F.col("_mode") == F.col("_at"), "left").orderBy("_mode")
        .select(
            "mode", F.coalesce("n", F.lit(0)).cast("long").alias("n_markers"), F.col("mean").alias("mean_entropy"), F.col("_median").alias("median_entropy"),
            deviation(population).alias("std_entropy"),
        )
    )


def mean_entropy(entropy: DataFrame) -> DataFrame:
    """A12."""
    return entropy.agg(F.count(F.lit(1)).alias("n_markers"), F.avg("entropy").alias("mean_entropy"))


def value_counts(df: DataFrame, *columns: str, keep_null: bool = True) -> DataFrame:
    """A11."""
    rows = df if keep_null else df.dropna(subset=list(columns))
    return rows.groupBy(*columns).count().orderBy(F.desc("count"), *columns)
