"""Readers and writers. Tables are parquet; columns are taken by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.operators.joins import semi_join

ISIN_LIMIT = 1000


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema only its columns are read, cast to its types."""
    df = spark.read.parquet(path)
    if schema is None:
        return df
    return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_partitioned(spark: SparkSession, path: str, **equal: object) -> DataFrame:
    """Scan with equality filters, which Spark turns into partition pruning or pushed filters."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def only_batch(
    df: DataFrame, batch: DataFrame | list[str], key: str, spread: list[str]
) -> DataFrame:
    """Rows whose key is in the batch: an IN list while it is short, else a semi join."""
    if isinstance(batch, DataFrame):
        return semi_join(df, batch, [key], spread)
    if len(batch) <= ISIN_LIMIT:
        return df.where(F.col(key).isin(list(batch)))
    ids = df.sparkSession.createDataFrame([(b,) for b in batch], T.StructType([df.schema[key]]))
    return semi_join(df, ids, [key], spread)


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_new(df: DataFrame, path: str) -> None:
    """Write parquet; fails if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def append_knowledge_base(kb: DataFrame, path: str) -> None:
    """Append, one directory per feature type.

    The rebalance hint lets Spark size the files: small feature types are merged and a feature type
    that holds most of the rows is split over many tasks.
    """
    cols = ["object_id", "feature_type", "feature_value", "ts"]
    out = kb.select(cols).hint("rebalance", "feature_type")
    out.write.mode("append").partitionBy("feature_type").parquet(path)


def append_relationships(records: DataFrame, path: str) -> None:
    """Append records; `current_relationships` shows only the newest write of each object."""
    records.write.mode("append").parquet(path)


def current_relationships(records: DataFrame) -> DataFrame:
    """The rows of each object's newest write, which is what an upsert on object_id would leave.

    Only (object_id, ts) is aggregated; the wide match columns are not carried through it.
    """
    newest = records.groupBy("object_id").agg(F.max("ts").alias("ts"))
    return records.join(newest, ["object_id", "ts"], "left_semi")


def kb_by_feature(kb: DataFrame, feature_type: str) -> DataFrame:
    """The by-feature view: one feature type, rows with a NULL in a key or value left out."""
    cols = ["feature_type", "object_id", "ts", "feature_value"]
    return kb.where(F.col("feature_type") == feature_type).dropna(subset=cols).select(cols)


def read_words(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """One term per line, order not kept: a stop list."""
    term = F.lower("value") if lower else F.col("value")
    return spark.read.text(path).select(term.alias("term"))


def read_ordered_words(spark: SparkSession, path: str) -> DataFrame:
    """One term per line with its line number from 0, for a short code list.

    The file is read as one value, so the numbers do not depend on how Spark splits files.
    """
    lines = F.split(F.regexp_replace("value", r"\n$", ""), "\r?\n")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("idx", "term"))


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    """Text sink, one line per row."""
    df.select(line.alias("value")).write.mode("errorifexists").text(path)
