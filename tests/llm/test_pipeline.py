"""The stages one by one against brute force, and the pipeline as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specmark.llm import registry
from specmark.llm.common import materialize
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 900)}" for _ in range(n)]


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)
    item = _words(rng, 30)
    texts = [" ".join(_words(rng, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], "short", None, "a b c d e " * 40]
    texts += [" ".join(_words(rng, 50) + item + _words(rng, 50)), " ".join(_words(rng, 60)) + " token=abcdef123 end"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tables), name)
        seen.append(docs)
        if name != "mix_sources":
            assert docs.columns == columns
    ids = [sorted(r.doc_id for r in d.collect()) for d in seen[:4]]
    assert ids[0] == [*range(42), 45, 46]
    assert ids[1] == [*range(40), 45, 46]
    assert ids[2] == ids[3] == [*range(40), 46]
    changed = {r.doc_id: r for r in seen[3].collect()}[46]
    assert changed.text.endswith(" [assign] end") and changed.n_chars == len(changed.text)
    assert {r.doc_id for r in seen[4].collect()} <= set(ids[3])


def test_run_and_names(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "redact_secrets", "mix_sources"]
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_odd_rows_through_all_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    long = " ".join(f"{'abcdefgh'[k % 8]}{k}" for k in range(30000)) + " password=verysecret99 end"
    odd = [(None, "no id " + " ".join(_words(random.Random(k), 80)), "en", "s0", None) for k in (1, 2)] + [(500, long, None, None, len(long)), (501, long, "en", "s1", 1), (502, "", "en", "", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    for clash in ("copy", "score", "component_id", "kept", "_row", "_words"):
        docs = docs.withColumn(clash, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, tables), name)
        if name != "mix_sources":
            assert docs.columns == before.columns and docs.filter("doc_id IS NULL").count() == 2
            assert docs.filter("doc_id IN (500, 501)").count() == (2 if name == "quality_rules" else 1)
    rows = docs.collect()
    assert all(r.kept == "clash" and len(r.text.split()) >= r.words > 0 for r in rows)
    changed = [r for r in rows if r.doc_id != 501 and r.n_chars is not None]
    assert all(r.n_chars == len(r.text) for r in changed)  # of texts with secrets, and of those that the border of a source cuts
    assert not any("verysecret99" in r.text for r in rows) and {r.doc_id for r in rows} >= {None}


def test_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, tables), name)
        assert docs.count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_on_the_drivers_tables(spark):
    rows = registry.pipeline(spark, f"{DATA}/sf0.001")
    assert rows.count() > 0 and {"doc_id", "shard", "words"} <= set(rows.columns)
