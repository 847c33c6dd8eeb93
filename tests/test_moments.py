import random
import statistics

import pytest
from pyspark.sql import functions as F

from specmark.operators import entropy as E
from specmark.operators.moments import deviation, merge_moments, moment_states


def _two_passes(rows):
    n = sum(w for _, w in rows)
    mean = sum(v * w for v, w in rows) / n
    return n, mean, sum(w * (v - mean) ** 2 for v, w in rows)


def test_moments_equal_two_passes_in_any_number_of_parts(spark):
    rng = random.Random(8)
    groups = {
        "wide": [(rng.uniform(-50, 3e3), rng.randrange(1, 9)) for _ in range(500)],
        "narrow": [(1e6 + rng.random() * 1e-4, rng.randrange(1, 10**9)) for _ in range(200)],
        "one": [(2.5, 1)],
        "same": [(0.1, 3), (0.1, 10**12)],
    }
    rows = [(k, v, w) for k, own in groups.items() for v, w in own] + [("wide", None, 5), ("wide", 1e9, 0), ("none", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w long").repartition(7)
    whole = merge_moments(moment_states(df, ["k"], "v", F.col("w")), ["k"])
    halves = [merge_moments(moment_states(df.filter(F.hash("v") % 2 == i), ["k"], "v", F.col("w")), ["k"]) for i in (-1, 0, 1)]
    parts = merge_moments(halves[0].unionByName(halves[1]).unionByName(halves[2]), ["k"])
    for states in (whole, parts):
        got = {r.k: r for r in states.withColumn("sd", deviation(True)).collect()}
        assert set(got) == set(groups)
        for k, own in groups.items():
            n, mean, m2 = _two_passes(own)
            assert got[k].n == n and got[k].mean == pytest.approx(mean, rel=1e-12)
            assert got[k].sd == pytest.approx((m2 / n) ** 0.5, rel=1e-7, abs=1e-9)
    assert moment_states(df.limit(0), ["k"], "v").count() == 0


def test_sample_deviation(spark):
    v = [0.25, 1.5, 1.5, 3.0]
    df = spark.createDataFrame([("a", x) for x in v] + [("b", 1.0)], "k string, v double")
    got = {r.k: r.sd for r in merge_moments(moment_states(df, ["k"], "v"), ["k"]).withColumn("sd", deviation()).collect()}
    assert got["a"] == pytest.approx(statistics.stdev(v)) and got["b"] is None


def test_two_hundred_modes_equal_a_join(spark):
    rng = random.Random(3)
    modes = [f"mode {i}" for i in range(200)]
    rows = [(f"m{rng.randrange(60)}", "word", rng.choice("abcd"), rng.choice([*modes, "other", None])) for _ in range(4000)]
    markers = spark.createDataFrame(rows, "marker_value string, marker_type string, k string, mode string")
    got = {(r.mode, r.marker_value): r.entropy for r in E.entropy_of_modes(markers, "k", "abc", 3, modes).collect()}
    entropy = E.conditional_entropy(markers, "k", "abc", 3)
    pairs = markers.filter(F.col("mode").isin(*modes)).select("mode", *E.KEYS).distinct()
    want = {(r.mode, r.marker_value): round(r.entropy, 9) for r in pairs.join(entropy, E.KEYS).collect()}
    assert set(got) == set(want) and len({m for m, _ in got}) == 200
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    summary = E.summarise_modes(E.entropy_of_modes(markers, "k", "abc", 3, modes), modes).collect()
    assert [r.mode for r in summary] == modes and all(r.n_markers > 0 for r in summary)
