"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. quality_rules: documents that the rules reject go.
2. near_dedup: one document of each near-duplicate group stays.
3. decontaminate: documents that hold a copy of a benchmark item go.
4. redact_secrets: each secret in a text is replaced by its kind in brackets, and n_chars follows.
5. mix_sources: the mix, a row with its text for each copy of a document that it takes, with shard and order in the shard.

All but the last return the columns of ``documents``, and any others that the table has. Nulls, empty and long texts, ties
and repeated rows are treated as the operators say: a document without words is rejected by stage 1, repeated rows leave
one row in stage 2; rows go by id and text, so that none is lost or kept for an id that is null or that unlike texts
share. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specmark.llm import decontamination, mixing, quality, secrets, simhash
from specmark.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]

#: SQL has neither the sketches of stage 1 nor the hashes of stages 2 and 5; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
