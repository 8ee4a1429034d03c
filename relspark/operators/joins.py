"""Equi joins that stay even when one key holds a large part of the rows.

`small` below means the side without repeated hot keys (targets, vocabularies, group sizes). It is
broadcast only after its size was measured; beyond the bound the join shuffles and hot keys of the
big side are salted. Measuring starts a job while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.sources.stored import Stored, measured

BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
ROWS_PER_PIECE = 2_000_000


def fits_broadcast(table: Stored) -> bool:
    return table.rows <= BROADCAST_ROWS and table.size <= BROADCAST_BYTES


def hot_keys(big: DataFrame, on: list[str], rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Every key of more than rows_per_piece rows, and the number of pieces to cut it into.

    There are at most rows / rows_per_piece of them.
    """
    return (
        big.groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows_per_piece)
        .select(*on, F.ceil(F.col("_n") / rows_per_piece).cast("int").alias("_pieces"))
    )


def measured_hot_keys(big: DataFrame, on: list[str], rows_per_piece: int) -> DataFrame:
    """All hot keys, as a table measured to fit a broadcast.

    Should there be too many, which takes more than BROADCAST_ROWS * rows_per_piece rows, pieces are made
    larger until they fit; every key above the piece size is still cut. Starts a job.
    """
    while True:
        hot = measured(hot_keys(big, on, rows_per_piece))
        if fits_broadcast(hot):
            return hot.df
        rows_per_piece *= 4


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    counted: DataFrame | None = None,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Join where each hot key of `big` is cut into pieces by a hash of the `spread` columns.

    Rows of `small` with a hot key are repeated once per piece, all others once, so the result is
    that of the plain join. `how` is inner, left, left_semi or left_anti. Keys are counted in `counted` if
    given: a table with about the same keys as `big` that is cheaper to read.
    """
    hot = measured_hot_keys(big if counted is None else counted, on, rows_per_piece)
    pieces = F.coalesce("_pieces", F.lit(1))
    left = big.join(F.broadcast(hot), on, "left").withColumn(
        "_piece", F.pmod(F.xxhash64(*spread), pieces).cast("int")
    )
    right = small.join(F.broadcast(hot), on, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), pieces - 1))
    )
    joined = left.drop("_pieces").join(right.drop("_pieces"), [*on, "_piece"], how)
    return joined.drop("_piece")


def sized_join(
    big: DataFrame,
    small: DataFrame | Stored,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Broadcast `small` if it was measured to fit, so `big` is joined in place; else salt."""
    table = small if isinstance(small, Stored) else measured(small)
    if fits_broadcast(table):
        return big.join(F.broadcast(table.df), on, how)
    return salted_join(big, table.df, on, spread, how, counted)


def semi_join(
    big: DataFrame,
    small: DataFrame | Stored,
    on: list[str],
    spread: list[str],
    counted: DataFrame | None = None,
) -> DataFrame:
    """Rows of `big` whose key is in `small`, by the same two ways."""
    if isinstance(small, Stored):
        keys = Stored(small.df.select(*on), small.rows, small.size)
    else:
        keys = measured(small.select(*on).distinct())
    return sized_join(big, keys, on, spread, "left_semi", counted)
