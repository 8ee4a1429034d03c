"""Newest value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_values(kb: DataFrame) -> DataFrame:
    """(object_id, feature_type, feature_value, ts) of the newest row per object and feature type.

    Equal times are decided by the greater value. One aggregation, combined before the shuffle.
    """
    newest = F.max(F.struct("ts", "feature_value")).alias("m")
    return kb.groupBy("object_id", "feature_type").agg(newest).select(
        "object_id", "feature_type", F.col("m.feature_value").alias("feature_value"), "m.ts"
    )


def latest_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first whole row per key in the given order.

    Spark filters the window to its first row before the shuffle (window group limit), so a hot key
    sends one row per map task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def newest_time(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its newest time."""
    return df.groupBy(*keys).agg(F.max("ts").alias("ts"))
