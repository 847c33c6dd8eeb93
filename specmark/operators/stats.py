"""Rank tests on entropies, from aggregates.

Ranks come from the spectrum of entropies, a table of distinct values with the counts of each mode and their prefix sums
(Mann & Whitney 1947; Kruskal & Wallis 1952): the average rank of a value among some modes is what their counts up to it
add up to, less half of what ties. So all tests are sums over one table, and what is ordered is the distinct entropies and
not the markers. Tails of the normal and chi-square distributions have no built-in expression; a UDF computes them on
the handful of result rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from specmark.functions.domains import HIGH_MODES, LOW_MODES, MODES
from specmark.operators.entropy import spectrum


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_square_tail(x: float, df: int) -> float:
    """The upper tail for whole degrees of freedom, by the recurrence from one or two."""
    if x <= 0:
        return 1.0
    tail = math.erfc(math.sqrt(x / 2)) if df % 2 else math.exp(-x / 2)
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2) if df % 2 else x / 2 * math.exp(-x / 2)
    for k in range(3 if df % 2 else 4, df + 1, 2):
        tail += term
        term *= x / k
    return tail


def exact_tail(u: float, n1: int, n2: int) -> float:
    """The chance of U or more without ties: subsets by their sum, the coefficients of a Gaussian binomial as shares of all."""
    few, many = sorted((n1, n2))
    ways = np.zeros(few * many + 1)
    ways[0] = 1.0
    for i in range(1, few + 1):
        # times (1 - x^(many + i)), divided by (1 - x^i); and by the number of subsets, so that nothing overflows
        shifted = ways.copy()
        shifted[many + i :] -= ways[: -(many + i)]
        for k in range(i):
            shifted[k::i] = np.cumsum(shifted[k::i])
        ways = shifted * (i / (many + i))
    return float(min(1.0, max(0.0, ways[math.ceil(u) :].sum())))


#: Below this size of either side, and without ties, the distribution of U is taken as it is.
EXACT = 8


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else normal_tail(v))


@F.pandas_udf(DoubleType())
def _chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else chi_square_tail(a, int(d)) for a, d in zip(x, df)])


@F.pandas_udf(DoubleType())
def _exact_tail(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else exact_tail(a, int(b), int(c)) for a, b, c in zip(u, n1, n2)], dtype="float64")


def _u_sums(tag: str, side1: list[int], side2: list[int]) -> list[Column]:
    """What a test of two sides needs, as sums over the spectrum."""
    add = lambda name, which: reduce(lambda a, b: a + b, (F.col(f"{name}{i}") for i in which), F.lit(0)).cast("double")
    e, c1, c2, upto = F.col("entropy"), add("c", side1), add("c", side2), add("u", side1 + side2)
    c = c1 + c2
    sums = {"n1": c1, "n2": c2, "r1": c1 * (upto - (c - 1) / 2), "ties": c * c * c - c, "s1": c1 * e, "s2": c2 * e}
    return [F.sum(x).alias(f"{tag}_{k}") for k, x in sums.items()]


def _u_statistics(sums: DataFrame) -> DataFrame:
    """U and what goes with it, from rows of sums (with any other columns); none where a side is empty."""
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    own = [c for c in sums.columns if c not in ("n1", "n2", "r1", "ties", "s1", "s2")]
    larger = F.greatest(u, n1 * n2 - u)
    tested = sums.filter("n1 > 0 AND n2 > 0").select(
        *own, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), "ties", (1 - 2 * u / (n1 * n2)).alias("r"),
        (F.col("s1") / n1).alias("mean1"), (F.col("s2") / n2).alias("mean2"),
        F.try_divide(u - n1 * n2 / 2 - 0.5, spread).alias("z_greater"), F.try_divide(larger - n1 * n2 / 2 - 0.5, spread).alias("z_two_sided"), larger.alias("larger"),
    )
    return tested.withColumn("exact", (F.col("ties") == 0) & (F.least("n1", "n2") <= EXACT))


def _tail(z: str, u: str) -> Column:
    exact = lambda x: F.when(F.col("exact"), x)
    return F.coalesce(_exact_tail(exact(F.col(u)), "n1", "n2"), _normal_tail(F.when(~F.col("exact"), F.col(z))))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def mann_whitney(of_modes: DataFrame, high: Sequence[str] = HIGH_MODES, low: Sequence[str] = LOW_MODES) -> DataFrame:
    """One row (none if a side is empty): are entropies of the high modes greater?

    A marker of two modes of a side counts twice. The distribution of U is exact where a side has eight markers at most and
    none tie, and else normal with corrections; where all entropies tie there is no p and no verdict.
    """
    modes = [*high, *low]
    return mann_whitney_of(spectrum(of_modes, modes), modes, high, low)


def mann_whitney_of(spectrum: DataFrame, modes: Sequence[str], high: Sequence[str] = HIGH_MODES, low: Sequence[str] = LOW_MODES) -> DataFrame:
    """The same from a spectrum over modes."""
    sums = spectrum.agg(*_u_sums("t", [list(modes).index(m) for m in high], [list(modes).index(m) for m in low]))
    u = _u_statistics(sums.select(*(F.col(c).alias(c[2:]) for c in sums.columns)))
    p = F.least(F.col("p"), F.lit(1.0))
    verdict = F.when(p < 0.001, "p < 0.001").when(p < 0.01, "p < 0.01").when(p < 0.05, "p < 0.05").when(p.isNotNull(), "p >= 0.05")
    return u.withColumn("p", _tail("z_greater", "u")).select(
        "n1", "n2", "u", "ties", "r", F.col("mean1").alias("mean_high"), F.col("mean2").alias("mean_low"), (F.col("mean1") - F.col("mean2")).alias("difference"),
        F.when(F.col("p").isNotNull(), p).alias("p"), verdict.alias("verdict"),
    )


def mann_whitney_pairs(of_modes: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """H4: two-sided tests of all pairs of modes, in order, where both have markers."""
    return mann_whitney_pairs_of(spectrum(of_modes, modes), modes)


def mann_whitney_pairs_of(spectrum: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """The same from a spectrum over modes: one row of sums for all pairs, then a row for each."""
    pairs = list(combinations(range(len(modes)), 2))
    sums = spectrum.agg(*(x for k, (i, j) in enumerate(pairs) for x in _u_sums(f"t{k}", [i], [j])))
    row = lambda k, i, j: F.struct(
        F.lit(k).alias("_at"), F.lit(modes[i]).alias("mode1"), F.lit(modes[j]).alias("mode2"), *(F.col(f"t{k}_{x}").alias(x) for x in ("n1", "n2", "r1", "ties", "s1", "s2"))
    )
    u = _u_statistics(sums.select(F.inline(F.array(*(row(k, i, j) for k, (i, j) in enumerate(pairs))))))
    tested = u.withColumn("p", 2 * _tail("z_two_sided", "larger"))
    p = F.when(F.col("p").isNotNull(), F.least("p", F.lit(1.0)))
    return tested.orderBy("_at").select("mode1", "mode2", "n1", "n2", "u", p.alias("p"), stars(p).alias("stars"))


def kruskal_wallis(of_modes: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """H1: one row (none with fewer than two modes that have markers); h and p are null where all entropies tie."""
    return kruskal_wallis_of(spectrum(of_modes, modes), modes)


def kruskal_wallis_of(spectrum: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """The same from a spectrum over modes."""
    every = range(len(modes))
    add = lambda name: reduce(lambda a, b: a + b, (F.col(f"{name}{i}") for i in every)).cast("double")
    c = add("c")
    rank = add("u") - (c - 1) / 2
    sums = spectrum.agg(
        F.sum(c).alias("n"), F.sum(c * c * c - c).alias("ties"),
        *(F.sum(f"c{i}").cast("double").alias(f"n{i}") for i in every), *(F.sum(F.col(f"c{i}") * rank).alias(f"r{i}") for i in every),
    )
    n, terms, groups = F.col("n"), F.lit(0.0), F.lit(0)
    for i in every:
        terms = terms + F.coalesce(F.try_divide(F.col(f"r{i}") * F.col(f"r{i}"), F.col(f"n{i}")), F.lit(0.0))
        groups = groups + F.when(F.col(f"n{i}") > 0, 1).otherwise(0)
    h = F.try_divide(F.lit(12.0) / (n * (n + 1)) * terms - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = sums.filter("n > 1").select(n.cast("long").alias("n"), groups.alias("groups"), h.alias("h")).filter("groups > 1")
    return out.withColumn("p", _chi_square_tail("h", F.col("groups") - 1))
