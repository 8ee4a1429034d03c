"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, text_of


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in no fold."""
    return (F.crc32(id_column.cast("string").cast("binary")) % folds).cast("int")


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str,
    folds: int,
    held_out: int,
    per_class: int,
    max_bytes: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[pa.Array, list[int]]:
    """(texts, labels): at most per_class texts of each label, none longer than max_bytes.

    The rows with the least hash of their id are taken, none of the held-out fold. The order is that
    of the hash. Rows without label or id are left out; an id labelled twice has its greater label, an id
    with several texts the least of them.
    """
    key, label = column(labels, id_column).alias("id"), column(labels, label_column).alias("label")
    known = (
        labels.select(key, label)
        .where(F.col("label").isin(0, 1) & (fold_of(F.col("id"), folds) != held_out))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("id"))
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("place", "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(column(docs, id_column).alias("id"), text_of(docs, text_column).alias("text"))
    found = (
        texts.where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(chosen), "id")  # at most 2 * per_class rows
        .groupBy("place", "id", "label")
        .agg(F.min("text").alias("text"))  # an id may have many rows
        .toArrow()
        .sort_by([("place", "ascending"), ("id", "ascending"), ("text", "ascending")])
    )
    text = found["text"].combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    return text, found["label"].to_pylist()
