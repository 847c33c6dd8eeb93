import math
import random
import statistics
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from specmark.functions.domains import MODES
from specmark.operators import entropy as E
from specmark.operators import stats as S
from specmark.plans.report import hypothesis_report

SCHEMA = "mode string, marker_value string, marker_type string, entropy double"


def _values(spark, seed=1, n=30):
    rng = random.Random(seed)
    return spark.createDataFrame([(m, f"{m}{i}", "word", rng.choice((0.0, 0.5, 1.0, 1.5, 2.0))) for m in MODES for i in range(n + len(m))], SCHEMA)


def _brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def _by_mode(df):
    out = {m: [] for m in MODES}
    for r in df.collect():
        out[r.mode].append(r.entropy)
    return out


def test_u_equals_brute_force_and_adds_up(spark):
    df = _values(spark)
    by = _by_mode(df)
    row = S.mann_whitney(df).first()
    high, low = by["Montree"] + by["Suggeree"], by["Designee"] + by["Comportementale"]
    assert row.u == _brute_u(high, low) and (row.n1, row.n2) == (len(high), len(low))
    assert row.r == pytest.approx(1 - 2 * row.u / (row.n1 * row.n2)) and row.difference == pytest.approx(sum(high) / len(high) - sum(low) / len(low))
    pairs = {(r.mode1, r.mode2): r for r in S.mann_whitney_pairs(df).collect()}
    assert len(pairs) == 6
    for (a, b), r in pairs.items():
        assert r.u == _brute_u(by[a], by[b])
    crossing = [pairs[low, high] for high in ("Montree", "Suggeree") for low in ("Comportementale", "Designee")]
    assert sum(r.n1 * r.n2 - r.u for r in crossing) == row.u


def test_published_figures_are_consistent(spark):
    sums = spark.createDataFrame([(2860.0, 2830.0, 4490988.0), (2805.0, 2775.0, 4308025.0)], "n1 double, n2 double, u double")
    sums = sums.selectExpr("n1", "n2", "u + n1 * (n1 + 1) / 2 AS r1", "0D AS ties", "0D AS s1", "0D AS s2")
    assert sorted(r.r for r in S._u_statistics(sums).collect()) == [pytest.approx(-0.1097, abs=5e-5), pytest.approx(-0.1069, abs=5e-5)]


def test_exact_tail_equals_all_subsets(spark):
    for n1, n2 in ((1, 1), (3, 5), (6, 4), (2, 9)):
        us = [sum(sum(x > y for y in set(range(n1 + n2)) - set(c)) for x in c) for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert S.exact_tail(u, n1, n2) == pytest.approx(sum(x >= u for x in us) / len(us))
    rows = [("Montree", f"a{i}", "word", 1.0 + i / 7) for i in range(4)] + [("Designee", f"b{i}", "word", 0.5 + i / 5) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    row, pair = S.mann_whitney(df).first(), S.mann_whitney_pairs(df).first()
    assert row.p == pytest.approx(S.exact_tail(row.u, 4, 5)) and pair.p == pytest.approx(min(1, 2 * S.exact_tail(max(pair.u, 20 - pair.u), 5, 4)))


def test_medians_and_moments_of_a_spectrum(spark):
    df = _values(spark, 7, 9).filter("mode <> 'Suggeree'")
    by = _by_mode(df)
    for population in (False, True):
        for r in E.summarise_modes(df, population=population).collect():
            v = by[r.mode]
            if not v:
                assert (r.n_markers, r.mean_entropy, r.median_entropy, r.std_entropy) == (0, None, None, None)
                continue
            spread = (statistics.pstdev if population else statistics.stdev)(v)
            assert (r.n_markers, r.mean_entropy, r.median_entropy, r.std_entropy) == (len(v), pytest.approx(statistics.mean(v)), statistics.median(v), pytest.approx(spread))


def test_report_where_all_entropies_tie(spark):
    text = hypothesis_report(_values(spark).withColumn("entropy", F.lit(1.0)))
    assert "H = non défini" in text and text.count("non défini") >= 9


def test_tails():
    assert S.normal_tail(1.959963984540054) == pytest.approx(0.025)
    assert S.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert S.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert S.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert S.chi_square_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert S.chi_square_tail(0, 3) == 1


def test_kruskal_equals_brute_force(spark):
    df = _values(spark, 5)
    by = _by_mode(df)
    every = sorted(x for v in by.values() for x in v)
    n = len(every)
    rank = {x: (every.index(x) + 1 + every.index(x) + every.count(x)) / 2 for x in set(every)}
    h = 12 / (n * (n + 1)) * sum(sum(rank[x] for x in v) ** 2 / len(v) for v in by.values()) - 3 * (n + 1)
    h /= 1 - sum(every.count(x) ** 3 - every.count(x) for x in set(every)) / (n**3 - n)
    row = S.kruskal_wallis(df).first()
    assert row.h == pytest.approx(h) and row.groups == 4 and row.p == pytest.approx(math.erfc(math.sqrt(h / 2)) + math.sqrt(2 * h / math.pi) * math.exp(-h / 2))


def test_missing_modes(spark):
    one = _values(spark).filter("mode = 'Montree'")
    assert S.kruskal_wallis(one).count() == 0 and S.mann_whitney(one).count() == 0 and S.mann_whitney_pairs(one).count() == 0
    text = hypothesis_report(one)
    assert "aucun marqueur" in text and "KRUSKAL" not in text
    assert hypothesis_report(one.limit(0)) == "Aucune donnée d'entropie disponible."


def test_report(spark):
    lines = hypothesis_report(_values(spark)).split("\n")
    assert lines[0] == "=" * 70 and lines[-1] == "=" * 70
    assert any(x.startswith("  Comportementale      : n=   45, moy=") for x in lines)
    assert sum(" vs " in x and "U=" in x for x in lines) == 6
