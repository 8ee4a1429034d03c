"""Bucketed tables and run scopes."""

import pytest
from pyspark.sql import functions as F

from relspark.sources.buckets import BucketTable, bucketed
from relspark.sources.stored import folder_of_application, run_scope, stored


def new_path(spark, name):
    return f"{folder_of_application(spark)}/{name}"


def files(spark, path):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    found, listed = [], system.listFiles(folder, True)
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.endswith(".parquet"):
            found.append(name)
    return found


def rows(spark, n, value="x"):
    return spark.range(n).select(F.concat(F.lit("o"), "id").alias("object_id"), F.lit(value).alias("value"))


def test_a_batch_reads_few_files(spark):
    table = bucketed(rows(spark, 5000), new_path(spark, "lookup"), 200)
    ids = spark.createDataFrame([(f"o{i}",) for i in range(0, 1000, 100)] + [("none",), (None,)], "object_id string")
    found = table.lookup(ids)
    assert sorted(r.object_id for r in found.collect()) == sorted(f"o{i}" for i in range(0, 1000, 100))
    part = table.read(spark, table.touched(ids.where("object_id <> 'none'")))
    assert part.select(F.input_file_name()).distinct().count() < 0.1 * len(files(spark, table.path))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]  # files of other buckets are not opened


def test_twenty_writes_leave_one_row_per_object(spark):
    table = bucketed(rows(spark, 60), new_path(spark, "upsert"), 8)
    for k in range(20):
        table.upsert(rows(spark, 60, f"v{k}").where(f"CAST(substr(object_id, 2) AS int) % 20 <= {k}"))
    on_disk = spark.read.parquet(table.path)
    assert on_disk.count() == 60
    assert {r.value for r in on_disk.collect()} == {"v19"}
    table.upsert(rows(spark, 0))
    assert spark.read.parquet(table.path).count() == 60


def test_all_rows_of_an_object_are_replaced(spark):
    schema = "object_id string, value string"
    start = [("a", "1"), ("a", "2"), ("b", "3"), (None, "4")]
    table = bucketed(spark.createDataFrame(start, schema), new_path(spark, "replace"), 4)
    table.upsert(spark.createDataFrame([("a", "5"), (None, "6"), ("c", "7"), ("c", "8")], schema))
    got = sorted((r.object_id or "", r.value) for r in table.read(spark).collect())
    assert got == [("", "6"), ("a", "5"), ("b", "3"), ("c", "7"), ("c", "8")]


def test_a_failed_write_changes_nothing(spark):
    table = bucketed(rows(spark, 50), new_path(spark, "fail"), 4)
    before = sorted(files(spark, table.path))
    bad = rows(spark, 50, "new").select(
        "object_id", F.when(F.col("object_id") == "o33", F.raise_error(F.lit("broken")).cast("string")).otherwise("new").alias("value")
    )
    with pytest.raises(Exception, match="broken"):
        table._write(bad)
    assert sorted(files(spark, table.path)) == before
    assert {r.value for r in table.read(spark).collect()} == {"x"}


def test_joined_and_empty(spark):
    left = bucketed(rows(spark, 40), new_path(spark, "left"), 8)
    right = bucketed(rows(spark, 60).select("object_id", F.lit(1).alias("n")), new_path(spark, "right"), 8)
    assert left.joined(spark, right).count() == 40
    with pytest.raises(ValueError):
        left.joined(spark, BucketTable("x", left.schema, 9))
    empty = BucketTable(new_path(spark, "empty"), left.schema, 8)
    empty.create(spark)
    assert empty.read(spark).count() == 0
    assert empty.lookup(rows(spark, 3).select("object_id")).count() == 0


def test_nothing_is_left_of_a_run(spark):
    with run_scope(spark) as folder:
        assert stored(rows(spark, 3)).count() == 3
        with run_scope(spark) as inner:
            assert inner.startswith(folder + "/") and stored(rows(spark, 3)).count() == 3
        assert files(spark, inner) is None and files(spark, folder)
    assert files(spark, folder) is None
    with pytest.raises(RuntimeError), run_scope(spark) as folder:
        stored(rows(spark, 3))
        raise RuntimeError("stopped")
    assert files(spark, folder) is None
    assert folder_of_application(spark) not in (folder,)
