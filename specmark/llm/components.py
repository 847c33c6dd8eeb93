"""Connected components over an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a minimum per node with partial aggregation and a join back, so that a node with many neighbours is never
gathered. Each round is written to the shared folder; the only things that reach the driver are two sums per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmark.llm.common import materialize


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): for each, the least of u and its v. The minima are written, so that the join can split a hub."""
    least = materialize(pairs.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "least")
    return pairs.join(least, F.col("u") == F.col("c")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs; returns (node, component) for every node with an edge, component its least node."""
    edges = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == seen or not found[0]:
            break
        seen = found
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        edges = materialize(
            small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(),
            "edges",
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
