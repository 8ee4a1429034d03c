"""Tables laid out by a hash bucket of object_id: a batch reads its own buckets, a write replaces those it touches.

A table is a folder with one sub-folder per bucket. Every object lies in one bucket, so

- a lookup of some ids lists the buckets they fall in and leaves the files of all others unread,
- an upsert merges the new rows with the old ones of the touched buckets and overwrites just these: there is
  one version of each object on disk, however often it was written, and readers need no search for
  the newest,
- two tables of the same number of buckets are joined bucket by bucket.

Spark writes an overwrite beside the table and moves it in place when all tasks are done: a write that fails
changes nothing. Rows of an object go together: an upsert replaces all of them. Rows without id are kept in bucket 0
and are replaced together, too, if the new rows have some.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.operators.joins import fits_broadcast, salted_join, sized_join
from relspark.sources.stored import measured, stored

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketTable:
    """A table of `buckets` parts below `path`; as many as keep a part within an executor's memory."""

    path: str
    schema: T.StructType
    buckets: int = 256
    key: str = "object_id"

    def bucket_of(self, key: Column | str) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        number = F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")
        return F.when(key.isNull(), 0).otherwise(number)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: the files of the others are not opened."""
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = spark.read.schema(whole).parquet(self.path)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def create(self, spark: SparkSession) -> None:
        """An empty table."""
        empty = spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        empty.write.mode("ignore").parquet(self.path)

    def _write(self, rows: DataFrame) -> None:
        placed = rows.select(*self.schema.names, self.bucket_of(self.key).alias(BUCKET))
        writer = placed.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def touched(self, ids: DataFrame) -> list[int]:
        """The buckets of some ids: at most as many numbers as there are buckets."""
        found = ids.select(self.bucket_of(self.key).alias(BUCKET)).distinct().collect()
        return sorted(r[BUCKET] for r in found)

    def upsert(self, rows: DataFrame) -> None:
        """Replace all rows of the objects in `rows` by those given. The rows are stored first, as they are read twice."""
        new = stored(rows.select(*self.schema.names))
        buckets = self.touched(new)
        if not buckets:
            return
        keys = measured(new.select(F.col(self.key).alias("_key")).distinct())
        old = self.read(rows.sparkSession, buckets)
        small = F.broadcast(keys.df) if fits_broadcast(keys) else keys.df
        kept = old.join(small, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        self._write(kept.select(*self.schema.names).unionByName(new))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The rows of some objects, read from their buckets alone."""
        wanted = measured(ids.select(self.key).where(F.col(self.key).isNotNull()).distinct())
        rows = self.read(ids.sparkSession, self.touched(wanted.df)).drop(BUCKET)
        return sized_join(rows, wanted, [self.key], self.schema.names[:1], "left_semi")

    def joined(self, spark: SparkSession, other: BucketTable) -> DataFrame:
        """Rows of two tables of the same layout that are of one object."""
        if (self.buckets, self.key) != (other.buckets, other.key):
            raise ValueError("the tables must have the same key and number of buckets")
        left, right = self.read(spark), other.read(spark)
        return salted_join(left, right, [BUCKET, self.key], self.schema.names[:1]).drop(BUCKET)


def bucketed(rows: DataFrame, path: str, buckets: int = 256, key: str = "object_id") -> BucketTable:
    """Write rows as a new table."""
    table = BucketTable(path, rows.schema, buckets, key)
    table.create(rows.sparkSession)
    table._write(rows)
    return table

