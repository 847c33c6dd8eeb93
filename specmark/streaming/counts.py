"""Marker counts of a growing corpus by Structured Streaming.

Counts add up, so each micro-batch writes its own partial counts, in a folder named by the batch: a batch that is run
again after a failure replaces its folder, and the totals stay exact. No state is kept between batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specmark.operators.entropy import KEYS, class_counts, with_entropy
from specmark.operators.markers import markers_of_annotations


def count_stream(annotations: DataFrame, condition: str, valid: Sequence[str], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Start counting the markers of a stream of annotations into path; options are those of the marker stage."""

    def write(batch: DataFrame, number: int) -> None:
        marked = markers_of_annotations(batch, narrow=True, **options)
        class_counts(marked, condition, valid).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return annotations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_entropy(spark: SparkSession, path: str, valid: Sequence[str], min_freq: int = 3) -> DataFrame:
    """The entropy table of all batches so far."""
    partial = spark.read.parquet(path)
    counts = partial.groupBy(*KEYS).agg(*(F.sum(f"`{c}`").alias(c) for c in valid), F.sum("total_count").alias("total_count"))
    return with_entropy(counts.filter(F.col("total_count") >= min_freq), valid)
