"""The driver's tables in the shape of labelled recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, windows

#: Geometry of the event recordings: windows of 16, half overlapping or not; the lead-in is 2.
HALF, WHOLE = windows.Geometry(16, 8), windows.Geometry(16, 16)
LEAD, RATE = 2, 4.0
ITEM_HALF, ITEM_WHOLE = windows.Geometry(64, 32), windows.Geometry(64, 64)
ITEM_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount"]
ITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user: annotation 2 for errors, 0 for sign-ups, 1 for the rest."""
    e = table(spark, sf_dir, "events")
    annotation = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 0).otherwise(1)
    return e.select(F.col("user_id").alias("subject"), "ts", "event_id", "event_type", F.col("value").alias("x"), annotation.alias("annotation"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event recordings without annotation 0, numbered after that filter."""
    kept = events(spark, sf_dir).filter(F.col("annotation") != labels.NOT_IN_EXPERIMENT)
    return labels.with_ordinal(kept, ["subject"], ["ts", "event_id"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_labels(samples(spark, sf_dir), ["subject"], ["pos"], lead=LEAD)


def event_windows(spark: SparkSession, sf_dir: str, geometry: windows.Geometry = HALF) -> DataFrame:
    return windows.sliding(labelled(spark, sf_dir), geometry, ["subject"], ["x"], ["binary_label", "multiclass_label"])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per supplier and return flag, with three channels."""
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("trial"), *ITEM_ORDER, *ITEM_CHANNELS, F.col("l_tax"), (F.col("l_linestatus") == "O").cast("int").alias("label")
    )
    return labels.with_ordinal(t, ["subject", "trial"], ITEM_ORDER)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window of 64 samples per vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") >= 5).cast("int").alias("y"))


def gappy(column: str = "x", key: str = "event_id"):
    """The event signal with every 17th value missing and every 23rd fifty times too large."""
    spiked = F.when(F.col(key) % 23 == 0, F.col(column) * 50).otherwise(F.col(column))
    return F.when(F.col(key) % 17 == 0, F.lit(None)).otherwise(spiked)
