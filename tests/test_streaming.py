from pyspark.sql import functions as F

from specmark.operators import entropy as E
from specmark.operators import markers as M
from specmark.streaming.counts import count_stream, stream_entropy

SCHEMA = "corpus string, file_id string, unit_id string, type string, mode string, categorie1 string, text_span string"


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [("c", str(i), "", "SitEmo", "Montree", "Joie" if i % 3 else "Peur", f"mot{'a' * (i % 4)} deux, mots") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    valid = ("Joie", "Peur")
    for part in (0, 1):
        df.filter(F.col("file_id").cast("int") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        count_stream(stream, "categorie1", valid, str(tmp_path / "out"), str(tmp_path / "state"), use_lemma=False).awaitTermination()
    want = E.conditional_entropy(M.markers_of_annotations(df, narrow=True, use_lemma=False), "categorie1", valid)
    assert sorted(map(tuple, stream_entropy(spark, str(tmp_path / "out"), valid).collect())) == sorted(map(tuple, want.collect()))
