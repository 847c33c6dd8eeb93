"""What the training-data operators share: table access, word rules and durable cuts of the lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: a word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its files have far fewer parts than there are cores (one small file, say), dealt out over all."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "pages") and 4 * rows.rdd.getNumPartitions() <= cores else rows


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def first_by_hash(df: DataFrame, key: str, order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each key in the given order, which starts with a hash.

    Each task of the input sends at most k rows of a key, and these meet in two steps, so that a hot key's last task
    sees salts * k rows however many tasks there were. Which rows are first does not depend on how they are dealt.
    """
    salted = df.select("*", (F.spark_partition_id() % salts).alias("_f_part"))
    for keys in ([key, "_f_part"], [key]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_f_rank", rank).filter(F.col("_f_rank") <= k)
    return salted.drop("_f_part", "_f_rank")


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The rows of df as one column ``_row``, beside columns: what is added then cannot clash with a column of df."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *columns)


def unpacked(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    return df.select(*(instead.get(c, F.col("_row")[c]).alias(c) for c in columns))


def computed_once(df: DataFrame, carry: list, columns: list[Column]) -> DataFrame:
    """Select carry and columns so that a later filter on the columns is not rewritten into their expressions.

    A filter moves below a projection with the expressions put in, which would compute them for each mention;
    it does not move below a generator.
    """
    return df.select(*carry, F.inline(F.array(F.struct(*columns))))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where the session is local."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="specmark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads survive lost executors and do no work twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """Which residues of the one column occur: bits / 8 bytes, whatever the number of rows."""
    place = F.pmod(values[values.columns[0]], F.lit(bits)) + 1
    rows = (
        values.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.map, np.uint8)
    return out


def in_bitmap(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & np.int64(len(held) * 8 - 1)
    return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
