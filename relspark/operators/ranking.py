"""Consecutive numbers in a given order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from relspark.sources.stored import stored


def with_index(
    df: DataFrame, order: list[Column], name: str = "idx", kind: str = "int"
) -> DataFrame:
    """Add 0, 1, 2, ... in the given order, which must leave no ties.

    `kind` is long for tables of two billion rows or more. Rows are split into ranges of the order, numbered inside each range, and shifted by the sizes
    of the ranges before. The ranged rows are stored first: range bounds come from a sample, and
    both uses below must see the same ones. Only the range sizes (one row per partition) meet in
    one task.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_size"))
        .select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(shifts), "_range")
        .withColumn(name, (F.col("_shift") + F.col("_inside") - 1).cast(kind))
        .drop("_range", "_inside", "_shift")
    )
