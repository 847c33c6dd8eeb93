import math

import pytest
from pyspark.sql import functions as F

from specmark.functions.domains import EMOTIONS, MODES
from specmark.functions.numbers import float_text
from specmark.operators import comparison as C
from specmark.operators import entropy as E
from specmark.operators import markers as M
from specmark.operators import ranking as R

FOUR = ("a", "b", "c", "d")


def _marked(spark, counts):
    """counts: {marker: (n for a, b, c, d)}"""
    rows = [(m, "word", FOUR[i]) for m, per in counts.items() for i, n in enumerate(per) for _ in range(n)]
    return spark.createDataFrame(rows + [("x", "word", "other"), ("x", "word", None), (None, "word", "a")], "marker_value string, marker_type string, k string")


def test_entropy_values(spark):
    df = E.conditional_entropy(_marked(spark, {"one": (4, 0, 0, 0), "two": (2, 2, 0, 0), "even": (1, 1, 1, 1), "rare": (1, 1, 0, 0)}), "k", FOUR, 3)
    assert df.columns == ["marker_value", "marker_type", *FOUR, "total_count", *(f"P({c})" for c in FOUR), "entropy", "normalized_entropy"]
    rows = {r.marker_value: r for r in df.collect()}
    assert set(rows) == {"one", "two", "even"}
    assert (rows["one"].entropy, rows["two"].entropy, rows["even"].entropy) == (0.0, 1.0, 2.0)
    assert math.copysign(1, rows["one"].entropy) == 1
    assert (rows["two"].normalized_entropy, rows["even"].normalized_entropy) == (0.5, 1.0)
    for r in rows.values():
        assert sum(r[f"P({c})"] for c in FOUR) == pytest.approx(1)


def test_empty_input_keeps_the_schema(spark):
    none = spark.createDataFrame([], "marker_value string, marker_type string, mode string, categorie1 string")
    entropy = E.conditional_entropy(none, "categorie1", EMOTIONS)
    assert entropy.count() == 0 and "P(Colere)" in entropy.columns
    summary = E.summarise_modes(E.entropy_of_modes(none, "categorie1", EMOTIONS)).collect()
    assert [(r.mode, r.n_markers, r.mean_entropy) for r in summary] == [(m, 0, None) for m in MODES]
    assert R.top_markers(entropy).count() == 0


def test_summary_by_mode(spark):
    of_modes = spark.createDataFrame([("a", "x", "word", 0.0), ("a", "y", "word", 1.0), ("b", "x", "word", 0.5)], "mode string, marker_value string, marker_type string, entropy double")
    a, b, c = E.summarise_modes(of_modes, ("a", "b", "c")).collect()
    assert (a.n_markers, a.mean_entropy, a.median_entropy) == (2, 0.5, 0.5)
    assert a.std_entropy == pytest.approx(math.sqrt(0.5)) and b.std_entropy is None and c.n_markers == 0
    assert E.summarise_modes(of_modes, ("a",), population=True).first().std_entropy == pytest.approx(0.5)


def test_top_markers_order_and_ties(spark):
    df = E.conditional_entropy(_marked(spark, {"p": (3, 0, 0, 0), "q": (3, 0, 0, 0), "r": (9, 1, 0, 0), "s": (4, 0, 0, 0)}), "k", FOUR, 3)
    rows = R.top_markers(df, 3).collect()
    assert [(r.Classe, r.Marqueur) for r in rows] == [("a", "s"), ("a", "p"), ("a", "q"), ("b", "r")]
    assert [x.marker_value for x in E.extreme(df, 2).collect()] == ["p", "q"]


def test_annotation_filters(spark):
    rows = [("SitEmo", "Montree", "x"), ("SitEmo", None, "x"), ("Autre", None, "x"), ("Autre", None, "\t "), ("paragraph", "Montree", "x"), ("SitEmo", "Montree", None)]
    df = spark.createDataFrame(rows, "type string, mode string, text_span string")
    assert M.keep_annotations(df).count() == 2
    assert M.keep_annotations(df, include_empty=True).count() == 3


def test_markers_carry_stopwords_out(spark):
    df = spark.createDataFrame([(1, "Le chat, l'été")], "i int, text string")
    every = M.explode_markers(df, "text", lemmatizer="identity").collect()
    assert [(r.marker_type, r.marker_value) for r in every] == [
        ("word", "le"), ("word", "chat"), ("word", "l'été"), ("punctuation", ","), ("punctuation", "'"),
        ("lemma", "le"), ("lemma", "chat"), ("lemma", "l"), ("lemma", "été"),
    ]
    kept = M.explode_markers(df, "text", lemmatizer="identity", remove_stopwords=True).collect()
    assert [r.marker_value for r in kept] == ["chat", "l'été", ",", "'", "chat"]


def _onehot(spark):
    rows = [(1, "1", "n", "deux mots", 1.0, 1.0, 1.0, 1.0), (2, "2", "n", "trois", 0.0, None, None, 0.0), (3, "3", "n", " ", 1.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "idx int, ID string, NAME string, TEXT string, `Colère` double, Joie double, `Désignée` double, `Montrée` double")


def test_onehot_combinations(spark):
    rows = [(r.idx, r.categorie1, r.mode, r.type) for r in M.onehot_to_classes(_onehot(spark)).orderBy("idx", "categorie1", "mode").collect()]
    assert rows == [
        (1, "Colere", "Designee", "SitEmo"), (1, "Colere", "Montree", "SitEmo"), (1, "Joie", "Designee", "SitEmo"), (1, "Joie", "Montree", "SitEmo"),
        (2, "Autre", None, "SitEmo"), (3, "Colere", None, "SitEmo"),
    ]


def test_table_markers(spark):
    df = _onehot(spark)
    assert {r.idx for r in M.markers_of_table(df, use_lemma=False).collect()} == {1}
    assert {r.idx for r in M.markers_of_table(df, include_empty=True, use_lemma=False).collect()} == {1, 2}
    assert {r.idx for r in M.markers_of_table(df.withColumn("Emo", (F.col("idx") == 2).cast("int")), use_lemma=False).collect()} == {2}
    with pytest.raises(ValueError, match="NAME"):
        M.markers_of_table(df.drop("NAME"))
    assert M.markers_of_table(df.withColumn("TEXT", F.lit(1.5)), use_lemma=False).count() == 2  # the sign of "1.5", for the two active rows


def test_sets_and_dashboard(spark):
    side = lambda *m: C.marker_set(spark.createDataFrame([(x,) for x in m], "marker_value string"))
    left, right = side(" Joie ", "joie", "peur", "ab", None), side("peur", "rire")
    found = {k: sorted(r.marker for r in v.collect()) for k, v in C.compare(left, right).items()}
    assert found == {"intersect": ["peur"], "except_left": ["joie"], "except_right": ["rire"], "union": ["joie", "peur", "rire"]}
    assert tuple(C.set_sizes(left, right).first()) == (2, 2, 1, 1, 1, 3)
    assert tuple(C.set_sizes(left.limit(0), left.limit(0)).first()) == (0, 0, 0, 0, 0, 0)
    glozz = spark.createDataFrame(
        [("Designee ", "joie", "Aucune", "rire"), ("DESIGNEE", "ennui", None, "rire"), ("Montree", "joie", None, "non"), ("Designee", None, "", "seul")],
        "mode string, categorie1 string, categorie2 string, marker_value string",
    )
    table = spark.createDataFrame([(1.0, 1.0, "Rire"), (0.0, 1.0, "pas"), (1.0, 0.0, "nan")], "`Désignée` double, Peur double, marker_value string")
    sets = C.dashboard_sets(C.items_of_annotations(glozz), C.items_of_table(table))
    assert {r.marker: (r.corpora, r.emotions) for r in sets.collect()} == {"rire": (["Glozz", "XLSX"], ["Autre", "Joie", "Peur"]), "seul": (["Glozz"], ["Autre"])}
    count = lambda *a: C.dashboard_filter(sets, *a).count()
    assert (count(), count("both"), count("only:Glozz"), count("XLSX"), count("all", "Peur")) == (2, 1, 1, 1, 1)


def test_french_order_and_places(spark):
    want = ["aujourd'hui", "ca", "ça", "cote", "Cote", "coté", "côte", "côté", "etat", "été", "Été", "étude", "l'été", "la", "œuf", "zèbre"]  # by hand
    df = spark.createDataFrame([(m,) for m in sorted(want)], "marker string").repartition(4)
    rows = R.places(df.orderBy(*C.french_order())).collect()
    assert [r.marker for r in sorted(rows, key=lambda r: r.place)] == want and sorted(r.place for r in rows) == list(range(1, 17))
    assert R.places(df.limit(0).orderBy("marker")).count() == 0


def test_numbers_as_python_writes_them(spark):
    values = [0.0, -0.0, 1.0, -1.5, 1e7, 123456789.25, 1e15, 1e16, -1.5e16, 0.001, 0.0005, 0.0001, 0.00001, 1.25e-7, 1e100, float("nan"), float("inf"), float("-inf"), 1 / 3, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [None if v is None else repr(v) for v in values]


def test_labels_are_computed_once(spark):
    rows = spark.createDataFrame([("designee", "joie", "peur", "Mot")], "mode string, categorie1 string, categorie2 string, marker_value string")
    items = C.items_of_annotations(rows)
    # once for the mode, the marker, and each mention of a category in its label
    assert items._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 12
    assert sorted(map(tuple, items.collect())) == [("mot", "Glozz", "Joie"), ("mot", "Glozz", "Peur")]


def test_rare_markers_go_before_their_entropy(spark):
    rows = [("a", "word", "x", "m")] * 3 + [("b", "word", "x", "m")] * 2 + [("b", "word", "z", "m")] * 4 + [("c", "word", "y", "n")] * 3
    markers = spark.createDataFrame(rows, "marker_value string, marker_type string, categorie1 string, mode string")
    got = E.entropy_of_modes(markers, "categorie1", ("x", "y"), modes=("m", "n"))
    assert sorted(tuple(r) for r in got.collect()) == [("m", "a", "word", 0.0), ("n", "c", "word", 0.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Filter" in line and "aggregate(" in line for line in plan)
