"""Rows with an identity of their own, whatever ids and columns the given table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.sources.stored import Stored, stored


def column(df: DataFrame, name: str) -> Column:
    """A top-level column, also one with dots in its name."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name an operator adds can clash with one of them."""
    return F.struct(*[column(df, c) for c in df.columns])


def numbered(docs: DataFrame, **more: Column) -> DataFrame:
    """Stored (row, doc, ...): a number for each row that stays the same, and the row as a struct."""
    named = [value.alias(name) for name, value in more.items()]
    row = F.monotonically_increasing_id().alias("row")
    return stored(docs.select(row, whole_row(docs).alias("doc"), *named))


def least_row(id_column: str | Column, row: str | Column = "row") -> Column:
    """Orders rows by id, rows without id last, equal ids by row number."""
    key = F.col(id_column) if isinstance(id_column, str) else id_column
    number = F.col(row) if isinstance(row, str) else row
    return F.struct(key.isNull().alias("no_id"), key.alias("id"), number.alias("row"))


def without_rows(table: DataFrame, gone: Stored) -> DataFrame:
    """Original columns of the rows of a numbered table whose number is not in `gone`.

    `gone` is broadcast only if it was measured to be small.
    """
    from relspark.operators.joins import sized_join

    return sized_join(table, gone, ["row"], ["row"], "left_anti").select("doc.*")
