"""Shards cut from a Hilbert curve over several dimensions of metadata.

Each dimension is quantised to 2^BITS steps at its own quantiles, so that a frequent value does not
leave the other steps empty. Strings are compared whole, so that values with a long common beginning
are told apart: their distinct values are counted, and the bounds are those at which the running count
passes each share. A row's steps are a cell of a grid, and cells are ordered along a Hilbert curve, on which neighbours differ by one step in one
dimension. The curve is cut into runs of equal numbers of rows: so each shard, and each file in it,
spans a short range of every dimension at once, and a filter on any of them skips most files by the
ranges in the Parquet footers.

Law: `rows`; the numbers of rows of any two shards differ by at most one. Rows of one cell are ordered by the
checksum of their text, so that equal texts of a cell lie together, then by id; a cell with a third
of all rows is cut like any other run. Texts are read once, for size and checksum; what is ordered
are short rows. At most (2^BITS - 1) bounds per dimension come to the driver.

Long texts count whole. Repeated rows are rows of their own, each with a slot. Names of the given columns may be any. A null dimension counts as the least value. Null text has size 1 and checksum 0. Null ids come first in
a cell. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.llm.rows import column, numbered
from relspark.operators.ranking import with_index
from relspark.sources.stored import measured, stored

SHARDS = 16
BITS = 4
DIMENSIONS = ("lang", "source", "n_chars")


def curve_index(steps: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of the cells with these steps (Skilling's transform)."""
    x = [s.astype(np.int64) for s in steps]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & q, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[n - 1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ turn) >> b & 1)
    return out


def curve_place(steps: list[Column], bits: int = BITS) -> Column:
    @F.arrow_udf("long")
    def place(*columns: pa.Array) -> pa.Array:
        return pa.array(curve_index([c.to_numpy(zero_copy_only=False) for c in columns], bits), pa.int64())

    return place(*steps)


def measure(value: Column, kind: T.DataType) -> Column:
    """A dimension as a number, or as a whole string, in the order of its values."""
    return value.cast("double" if isinstance(kind, T.NumericType) else "string")


def string_bounds(values: DataFrame, shares: list[float]) -> list[str | None]:
    """For each share the least value of the column `value` that, with all before it, makes up that share of the rows.

    Distinct values are counted before the shuffle and added up range by range; only the sizes of the
    ranges meet in one task.
    """
    counts = values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = (
        ranged.groupBy("range")
        .agg(F.sum("n").alias("size"))
        .select(
            "range",
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"),
            F.sum("size").over(W.partitionBy()).alias("total"),
        )
    )
    upto = F.col("shift") + F.sum("n").over(W.partitionBy("range").orderBy("value"))
    reached = ranged.join(F.broadcast(ranges), "range").select("value", "total", upto.alias("upto"))
    least = [F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("value"))) for share in shares]
    return list(reached.agg(*[c.alias(f"b{k}") for k, c in enumerate(least)]).first())


def bounds_of(rows: DataFrame, names: list[str], bits: int) -> list[list]:
    """The distinct bounds between the steps of each dimension, in order; none for a dimension without values."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [n for n in names if isinstance(rows.schema[n].dataType, T.DoubleType)]
    found = {}
    if numbers:
        one = rows.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in numbers]).first()
        found = {n: one[n] or [] for n in numbers}
    for name in set(names) - set(numbers):
        found[name] = string_bounds(rows.select(F.col(name).alias("value")), shares)
    return [sorted({b for b in found[n] if b is not None}) for n in names]


def _facts(
    value_of: Callable[[str], Column],
    kinds: T.StructType,
    id_column: str,
    text_column: str,
    dimensions: tuple[str, ...],
) -> list[Column]:
    raw = F.coalesce(value_of(text_column).cast("string"), F.lit("")).cast("binary")
    facts = [
        value_of(id_column).alias("id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
    ]
    measures = [measure(value_of(name), kinds[name].dataType) for name in dimensions]
    return facts + [m.alias(f"d{i}") for i, m in enumerate(measures)]


def _ordered(rows: DataFrame, dimensions: int, bits: int) -> DataFrame:
    """(row, id, size, text_crc32, curve, place) of rows with measures d0, d1, ...: their global order."""
    names = [f"d{i}" for i in range(dimensions)]
    steps = []
    for name, bounds in zip(names, bounds_of(rows, names, bits), strict=True):
        above = F.lit(0)
        for bound in bounds:
            above += F.coalesce(F.col(name) > F.lit(bound), F.lit(False)).cast("int")
        # equal bounds leave steps out: spread what is left over the whole range
        steps.append(F.floor(above * ((1 << bits) - 1) / max(1, len(bounds))).cast("int"))
    placed = rows.withColumn("curve", curve_place(steps, bits))
    order = [F.col(c).asc_nulls_first() for c in ("curve", "text_crc32", "id", "row")]
    return with_index(placed, order, "place", "long")


def _cut(ordered: DataFrame, rows: int, shards: int) -> DataFrame:
    n = F.lit(max(1, rows)).cast("long")
    shard = F.expr(f"(place * {shards}) div {max(1, rows)}").cast("int")
    start = F.floor((F.col("shard").cast("long") * n + shards - 1) / shards).cast("long")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("place") - start)


def curve_shards(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    dimensions: tuple[str, ...] = DIMENSIONS,
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """(<id>, size, text_crc32, law, shard, slot, grown_shard, curve) of every row."""
    facts = _facts(lambda c: column(docs, c), docs.schema, id_column, text_column, dimensions)
    rows = measured(docs.select(F.monotonically_increasing_id().alias("row"), *facts))
    found = _cut(_ordered(rows.df, len(dimensions), bits), rows.rows, shards)
    return found.select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    dimensions: tuple[str, ...] = DIMENSIONS,
    shards: int = SHARDS,
    bits: int = BITS,
) -> str:
    """Write all rows, as Parquet in curve order, to one subfolder per shard; returns the shard column's name.

    The rows' own columns are kept; the shard column is `shard`, with underscores added if a column has
    that name.
    """
    table = numbered(docs)
    facts = _facts(F.col("doc").getField, docs.schema, id_column, text_column, dimensions)
    rows = measured(table.select("row", *facts))
    found = _cut(_ordered(rows.df, len(dimensions), bits), rows.rows, shards)
    name = "shard"
    while name in docs.columns:
        name += "_"
    joined = table.join(found.select("row", "shard", "slot"), "row")
    ordered = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(folder)
    return name
