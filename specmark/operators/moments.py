"""Mergeable moments of weighted values: count, mean and sum of squared deviations.

A state (n, mean, m2) of one part and that of another give the state of both (Chan, Golub & LeVeque, 1979), so values are
read once, in any number of parts, and states of earlier runs can be merged with new ones. Values first meet inside narrow
ranges of fixed bounds, as sums of their distances from the middle of the range: no digits are lost there, as all distances
are small, and sums are combined before the shuffle. What is left is a state per range and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a range of values. States of a key are as many as the ranges that its values lie in.
WIDTH = 1e-3

_STATE = "struct<n:bigint,mean:double,m2:double>"


def moment_states(
    df: DataFrame, keys: list[str], value: str, weight: Column | None = None, width: float = WIDTH, more: Sequence[Column] = ()
) -> DataFrame:
    """keys, n, mean and m2 of each range of a key, and more aggregates; null values and weights of zero do not count."""
    v, w = F.col(value).cast("double"), (F.lit(1) if weight is None else weight).cast("long")
    place = F.floor(v / width)
    rows = df.filter(v.isNotNull() & (w > 0)).select("*", place.alias("_place"), w.alias("_w"), (v - (place + 0.5) * width).alias("_d"))
    d, n = F.col("_d"), F.col("_n")
    sums = rows.groupBy(*keys, "_place").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * d).alias("_s"), F.sum(F.col("_w") * d * d).alias("_q"), *more)
    others = [c for c in sums.columns if c not in (*keys, "_place", "_n", "_s", "_q")]
    return sums.select(
        *keys, n.alias("n"), ((F.col("_place") + 0.5) * width + F.col("_s") / n).alias("mean"),
        F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0)).alias("m2"), *others,
    )


def _both(a: Column, b: Column) -> Column:
    """The state of two parts, neither of them empty."""
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"), (a["mean"] + d * (b["n"] / n)).alias("mean"), (a["m2"] + b["m2"] + d * d * (a["n"] * (b["n"] / n))).alias("m2")
    )


def merge_moments(states: DataFrame, keys: list[str], more: Sequence[Column] = ()) -> DataFrame:
    """One state per key, from any states, and more aggregates. They are merged in the order of their means, so that reruns agree."""
    listed = states.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("mean", "n", "m2"))).alias("_states"), *more)
    others = [c for c in listed.columns if c not in (*keys, "_states")]
    first = F.col("_states")[0]
    start = F.struct(first["n"].alias("n"), first["mean"].alias("mean"), first["m2"].alias("m2")).cast(_STATE)
    rest = F.expr("slice(_states, 2, size(_states))")
    merged = listed.select(*keys, F.aggregate(rest, start, lambda a, b: _both(a, b).cast(_STATE)).alias("_state"), *others)
    return merged.select(*keys, "_state.n", "_state.mean", "_state.m2", *others)


def deviation(population: bool = False) -> Column:
    """The standard deviation of a state; null for a sample of one."""
    return F.sqrt(F.try_divide(F.col("m2"), F.col("n") if population else F.col("n") - 1))
