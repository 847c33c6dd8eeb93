"""The most specific markers of each class, and places in an order of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specmark.sources.store import kept


def probability_columns(entropy: DataFrame) -> dict[str, str]:
    """class by the column of its probability, in column order."""
    return {c: c[2:-1] for c in entropy.columns if c.startswith("P(") and c.endswith(")")}


def top_markers(entropy: DataFrame, n: int = 20) -> DataFrame:
    """Classe, Marqueur, Type, P(Classe), Freq_Globale, Entropie: n per class, by probability, frequency, low entropy.

    The window's rank is limited before its shuffle as well as after.
    """
    names = probability_columns(entropy)
    long = entropy.unpivot(
        ["marker_value", "marker_type", "total_count", "entropy"], [F.col(f"`{c}`") for c in names], "_column", "_p"
    ).filter("_p > 0")
    order = W.partitionBy("_column").orderBy(F.desc("_p"), F.desc("total_count"), F.asc("entropy"), "marker_value", "marker_type")
    ranked = long.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    place = F.create_map(*(x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i)))) if names else F.lit(None)
    return (
        ranked.withColumn("_place", place[F.col("_column")] if names else F.lit(0))
        .orderBy("_place", "_rank")
        .select(
            F.expr("substring(_column, 3, length(_column) - 3)").alias("Classe"),
            F.col("marker_value").alias("Marqueur"),
            F.col("marker_type").alias("Type"),
            F.col("_p").alias("P(Classe)"),
            F.col("total_count").alias("Freq_Globale"),
            F.col("entropy").alias("Entropie"),
        )
    )


def places(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their ``place`` from 1 on: the sizes of the parts before a row's own, and its place there.

    No task sees more than its part; what meets in one task is a row per part of the sort.
    """
    number = F.monotonically_increasing_id()
    at = kept(ordered.select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND((1 << 33) - 1).alias("_nth")), "places")
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")
