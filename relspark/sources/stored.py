"""Intermediate tables on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set as the session's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder


@dataclass(frozen=True)
class Stored:
    """A stored table with its number of rows and its bytes in memory, measured as it was written."""

    df: DataFrame
    rows: int
    size: int


def stored(df: DataFrame, read_as: dict[str, T.DataType] | None = None) -> DataFrame:
    """Write the rows to a table in the shared folder and read them from there.

    Used where a result is read more than once and must be the same each time. The table outlives
    executors, cuts the lineage, and gives Spark its true size for later join planning. `read_as` names
    columns to be read as another type of the same layout.
    """
    spark = df.sparkSession
    path = f"{folder_of_application(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    other = read_as or {}
    fields = [T.StructField(f.name, other.get(f.name, f.dataType)) for f in df.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


#: Names of the runs that are open, the outermost first.
_RUNS: ContextVar[tuple[str, ...]] = ContextVar("runs", default=())


def folder_of_application(spark: SparkSession) -> str:
    """Where this application, or the innermost open run of it, keeps what it writes in between."""
    return "/".join([shared_folder(spark), "relspark", spark.sparkContext.applicationId, *_RUNS.get()])


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application or open run. Results not yet written need them."""
    _remove(spark, folder_of_application(spark))


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A run that owns every folder made inside it, and removes them at its end, also if it fails.

    Write results before the end: frames made inside read from those folders. Runs may be nested.
    """
    token = _RUNS.set((*_RUNS.get(), f"run-{uuid.uuid4().hex}"))
    folder = folder_of_application(spark)
    try:
        yield folder
    finally:
        _RUNS.reset(token)
        _remove(spark, folder)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, about: 8 for numbers, the length of texts, all members of lists."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            return F.greatest(F.size(column), F.lit(0)) * 8 + 8
        each = F.transform(column, lambda x: _width(x, kind.elementType).cast("long"))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 8


def measured(df: DataFrame) -> Stored:
    """Store a table, and sum up its rows and the bytes they take in memory in the same pass."""
    seen = Observation()
    widths = (_width(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields)
    width = sum(widths, F.lit(0)).cast("long")
    table = stored(
        df.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(width), F.lit(0)).alias("size"),
        )
    )
    found = seen.get
    return Stored(table, found.get("rows", 0), found.get("size", 0))
