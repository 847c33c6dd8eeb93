"""Operators 11, 12 and 13: held-out accuracy, numpy's eigenvectors, brute force over all orders, and their edge cases."""

import random
import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specmark.llm import audit, boosting, registry, textbytes, whitening
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = DATA / "sf0.01"
needs_data = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


# --- 11 ---
def _one(text):
    return boosting.features(*next(iter((d, o) for _, _, d, o in textbytes.chunks(pa.array([text])))))[0]


def test_statistics_are_those_of_each_text():
    texts = [None, "", " \n\t", "a", "The cat.\nThe cat.\nthe dog ate 3 %", "x " * 3000, "é😀 ÉCOLE " * 5, "A B A B A B A B"]
    parts = [boosting.features(data, offsets) for _, _, data, offsets in textbytes.chunks(pa.array(texts))]
    whole = np.concatenate(parts)
    assert whole.shape == (len(texts), len(boosting.NAMES)) and np.isfinite(whole).all()
    assert np.allclose(whole, np.stack([_one(t or "") for t in texts]))  # whatever stands beside a text
    assert not whole[:2].any()
    of = dict(zip(boosting.NAMES, whole[4]))
    words = WORD.findall(texts[4])
    assert of["log_words"] == pytest.approx(np.log1p(len(words))) and of["different_words"] == pytest.approx(len(set(words)) / len(words))
    assert of["repeated_lines"] == pytest.approx(1 / 3) and of["log_lines"] == pytest.approx(np.log1p(3))
    size = len(texts[4].encode())
    assert [of[k] * size for k in ("capitals", "digits", "newlines", "other_signs", "sentence_signs")] == pytest.approx([2, 1, 2, 1, 2])
    assert of["repeated_pairs"] == pytest.approx(1 - len(set(zip(words, words[1:]))) / (len(words) - 1))
    assert of["signed_words"] == pytest.approx(1 / len(words)) and of["top_word"] == pytest.approx(2 / len(words))


def test_trees_in_arrays_score_as_they_were_grown():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 5)), 1)  # with ties
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    weight = rng.uniform(0.5, 2, len(y))
    forest = boosting.train(x, y, weight, 40)
    assert np.mean((forest.score(x) > 0.5) == (y == 1)) > 0.99

    def walk(row):  # one tree after the other, by its nodes
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if row[feature[k]] > threshold[k] else 1)
            total += leaf[k - len(feature)]
        return total

    assert np.allclose(forest.logit(x[:50]), [walk(r) for r in x[:50]])
    # the first split is the best one of all, found without histograms
    edges, p = boosting.bin_edges(x), np.average(y, weights=weight)
    g, h = weight * (p - y), weight * p * (1 - p)
    gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + boosting.SHRINK)
    every = {(f, e): gain(x[:, f] <= e) + gain(x[:, f] > e) for f in range(5) for e in edges[f] if min(weight[x[:, f] <= e].sum(), weight[x[:, f] > e].sum()) >= boosting.LEAST_WEIGHT}
    assert every[forest.feature[0, 0], forest.threshold[0, 0]] == pytest.approx(max(every.values()))
    assert boosting.train(x, np.ones(900), weight).score(x[:3]).tolist() == [1, 1, 1]
    assert boosting.train(x[:0], y[:0], weight[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert len(boosting.train(np.zeros((50, 2)), np.arange(50) % 2.0, np.ones(50)).score(np.ones((1, 2)))) == 1  # nothing to split


def test_quality_scores_of_odd_rows(spark):
    texts = [None, "", "  \n", "a", "x " * 30000, "same text here", "same text here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "id again")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)] + [(2, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = boosting.quality_scores(docs, labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(["0", "1", "2", "3", "3", "4", "5", "6", "None"])
    of = {r.doc_id: r.score for r in rows if r.doc_id is not None}
    assert of[0] == of[1] and of[5] == of[6]
    assert {r.score for r in boosting.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in boosting.quality_scores(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert boosting.quality_scores(docs.limit(0), labels).count() == 0


@needs_data
def test_quality_held_out(spark):
    rows = registry.queries()["op11_quality_classifier"](spark, str(DATA / "sf0.1"))
    labels = spark.read.parquet(str(DATA / "sf0.1/labels.parquet"))
    assert rows.count() == spark.read.parquet(str(DATA / "sf0.1/documents.parquet")).count()
    held = rows.filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").toPandas()
    assert len(held) > 500 and (held.quality == held.predicted).mean() > 0.98
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.995
    assert held.predicted[held.quality == 1].mean() > 0.99


# --- 12 ---
def _of(v, components=32):
    """By numpy from the whole matrix of integers."""
    n = len(v)
    x = np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000
    s = x.sum(0)
    c = (n * x - s) / n
    e, p = np.linalg.eigh(c.T @ c / n)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    some = e > 1e-12 * e[0]
    return ((n * x - s) ** 2).sum(1), c @ p[:, some] / np.sqrt(e[some]), e[some] / (c**2).sum() * n


def _hold(rows, ids, v):
    deviation, whitened, explained = _of(v)
    k = whitened.shape[1]
    assert len(rows) == len(ids) * k and {r.n for r in rows} == {len(ids)}
    place = {x: i for i, x in enumerate(ids)}
    got = np.zeros_like(whitened)
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert int(r.deviation) == deviation[place[r.vec_id]] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = np.sign((got * whitened).sum(0))
    assert np.abs(got * sign - whitened).max() < 1e-6
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitened_as_by_all_eigenvectors(spark):
    rng = np.random.default_rng(5)
    for n, d in ((40, 3), (300, 50), (20, 60)):
        v = np.round(rng.normal(size=(n, d)) * (1 + np.arange(d)[::-1]), 3).astype(np.float32)
        odd = [(1000, None), (1001, [None] + [1.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, []), (1005, [1.0] * (d + 1))]
        data = [(i, x.tolist()) for i, x in enumerate(v)] + odd
        vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3).withColumn("component", F.lit("clash"))
        _hold(whitening.whiten(vectors).collect(), list(range(n)), v)


def test_whitening_of_odd_tables(spark):
    make = lambda data: whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, [1.0, 2.0])]).count() == 0
    assert make([(1, [1.0, 2.0])] * 50).count() == 0  # equal vectors have no axis
    rows = make([(None, [0.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0]), (2, [0.0, 0.0, 5.0])]).collect()
    assert len(rows) == 4 and {r.component for r in rows} == {1} and {abs(round(r.whitened, 9)) for r in rows} == {1.0}
    assert {r.deviation for r in rows} == {(4 * 64 - 2 * 64) ** 2} and rows[0].explained == pytest.approx(1)
    large = make([(k, [1e12 * k, -3e11 * k * k, 1.0]) for k in range(5)]).collect()  # deviations beyond 64 bits
    x = [[64 * 10**12 * k, -192 * 10**11 * k * k, 64] for k in range(5)]
    total = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in large} == {k: sum((5 * a - s) ** 2 for a, s in zip(x[k], total)) for k in range(5)}
    with pytest.raises(Exception, match="too large"):
        make([(1, [1e300]), (2, [1.0])]).count()


def test_lanczos_with_equal_eigenvalues_and_breakdown():
    rng = np.random.default_rng(2)
    for values in ([3.0] * 30 + [1.0] * 90, [5.0, 4.0] + [0.0] * 70, list(range(200, 0, -1)), [1.0]):
        d, passes = len(values), []
        u = np.linalg.qr(rng.normal(size=(d, d)))[0]
        a = u @ np.diag(values) @ u.T
        found, axes = whitening.block_lanczos(lambda q: passes.append(q.shape) or a @ q, d, 32)
        k = min(32, d)
        assert np.abs(found - np.array(values[:k], float)).max() < 1e-10 * max(values)
        assert np.abs(a @ axes - axes * found).max() < 1e-10 * max(values) and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
        assert sum(s[1] for s in passes) <= d  # no direction twice


@needs_data
def test_whitening_of_the_table(spark):
    table = spark.read.parquet(str(SF / "embeddings.parquet")).orderBy("vec_id").collect()
    rows = registry.queries()["op12_embedding_whitening"](spark, str(SF))
    assert dict(rows.dtypes)["deviation"] == "bigint"
    _hold(rows.collect(), [r.vec_id for r in table], [r.embedding for r in table])


# --- 13 ---
def _fails(docs):
    out = []
    for id, text in docs:
        text = text or ""
        words = WORD.findall(text)
        copy = id is not None and any(t == text and i is not None and i < id for i, t in [(i, t or "") for i, t in docs])
        checks = (len(words) < 200, 2 * len(set(words)) < len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(set(text) & set("#$%&*|")), copy)
        out.append({x for x, bad in zip("ABCDE", checks) if bad})
    return out


def test_audit_as_by_applying_each_order(spark):
    rng = random.Random(4)
    long = lambda n, m: " ".join(rng.choice("abcdefghij") + str(rng.randrange(m)) for _ in range(n))
    texts = [None, "", " \n ", "A B C", "same", "same", "same", long(300, 3), long(300, 3) + " %", long(400, 999), long(400, 999).upper(), "w " * 9000, "é\x0bÉ\x1cÀ " * 80]
    texts += [rng.choice(texts) for _ in range(60)] + [long(rng.randrange(150, 260), 40) + rng.choice(["", " $", " UPPER" * 9]) for _ in range(40)]
    ids = [None if k == 5 else 3 if k in (4, 6) else k for k in range(len(texts))]
    parts = [rng.choice([None, "", "web", "web", "web", "books"]) for _ in texts]
    docs = spark.createDataFrame(list(zip(ids, texts, parts)), "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).repartition(3)
    known = {k: (rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, len(texts), 2)}
    labels = spark.createDataFrame([(k, q, t) for k, (q, t) in known.items()] + [(8, 1, 0), (None, 1, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(docs, labels).collect()}
    fails = _fails(list(zip(ids, texts)))
    known[8] = (1, max(known[8][1], 0))
    of = lambda k, j: int(ids[k] in known and known[ids[k]][j] == 1)
    assert len(got) == 600 * len({p or "" for p in parts})
    for part in {p or "" for p in parts}:
        own = [k for k, p in enumerate(parts) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                r = got[part, "".join(order), step]
                out = [k for k in left if x in fails[k]]
                left = [k for k in left if x not in fails[k]]
                shapley[x] += len(out)
                want = (len(left), len(out), sum(x in fails[k] for k in own) - len(out), sum(fails[k] == {x} for k in own), sum(of(k, 0) for k in out), sum(of(k, 1) for k in out))
                assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want
        for (p, order, step), r in got.items():
            assert p != part or r.shapley == shapley[order[step - 1]]
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("a", 5, 1, 0), ("a", 0, 0, 1), ("b", 2, 0, 0)], "part string, mask int, good int, toxic int")
    rows = audit.audit_masks(masks, "xyz").collect()
    assert len(rows) == 2 * factorial(3) * 3
    first = next(r for r in rows if (r.part, r.filter_order, r.step) == ("a", "xyz", 3))
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.shapley) == (1, 0, 1, 0, 0, 3)
    with pytest.raises(ValueError):
        audit.audit_masks(masks, "xx")
    with pytest.raises(ValueError):
        audit.audit_masks(masks, "")
