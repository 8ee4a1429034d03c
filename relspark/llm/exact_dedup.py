"""Exact duplicates: frequent digests are split off and removed map-side, the rest is shuffled.

Two texts are equal when they are the same after each run of white space became one space. Only
DataFrame functions are used.

1. Texts are read once and reduced to SHA-256 digests, which are stored.
2. A Misra-Gries summary of 1 / support counters finds every digest that more than `support` of the
   rows have. There are at most 1 / support of them, however large the table is.
3. Their exact winners (least id) and group sizes are counted with map-side combining. This table
   of at most 1 / support rows is broadcast, so rows of frequent texts never cross the network.
4. No other digest has more than `support` of the rows; they are grouped by an ordinary shuffle with
   map-side combining. Only groups of two rows or more are joined back: broadcast if they were measured
   to fit, else shuffled with the larger digests cut into pieces, so no task holds a whole large group.
5. Rows are removed by their numbers; texts are never shuffled.

Null text counts as empty. Long texts are hashed whole. Rows without id come after all rows with one. Of
rows with equal id and text one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, least_row, numbered, text_of, without_rows
from relspark.operators.joins import sized_join
from relspark.sources.stored import measured, stored

SUPPORT = 0.005


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest): at most 1 / support rows, with every digest of more than that share of the rows."""
    found = digests.freqItems(["digest"], support)
    return found.select(F.explode("digest_freqItems").alias("digest"))


def groups_of(digests: DataFrame) -> DataFrame:
    """(digest, winner, group_size) of digests of two rows or more."""
    groups = digests.groupBy("digest").agg(
        F.min(least_row("id")).alias("winner"), F.count("*").alias("group_size")
    )
    return groups.where("group_size > 1")


def frequent_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified (digest, winner, group_size) of the frequent digests, at most 1 / support rows."""
    frequent = stored(frequent_digests(digests, support))
    return stored(groups_of(digests.join(F.broadcast(frequent), "digest", "left_semi")))


def with_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(id, digest, row, winner, group_size) of every row of (id, digest, row)."""
    winners = F.broadcast(frequent_winners(digests, support))
    frequent = digests.join(winners, "digest")
    rare = digests.join(winners, "digest", "left_anti")
    found = sized_join(rare, measured(groups_of(rare)), ["digest"], ["row"], "left")
    columns = ("id", "digest", "row", "winner", "group_size")
    alone = found.withColumn("winner", F.coalesce("winner", least_row("id"))).withColumn(
        "group_size", F.coalesce("group_size", F.lit(1).cast("long"))
    )
    return frequent.select(*columns).unionByName(alone.select(*columns))


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """(<id>, keep_id, group_size, kept, text_sha256) of every row.

    keep_id is the id of the row that stays; null only if no row of the group has an id.
    """
    digests = stored(
        docs.select(
            column(docs, id_column).alias("id"),
            digest_of(text_of(docs, text_column)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    return with_winners(digests, support).select(
        F.col("id").alias(id_column),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows that stay, with their columns."""
    rows = numbered(docs, digest=digest_of(text_of(docs, text_column)))
    digests = rows.select("row", "digest", F.col("doc").getField(id_column).alias("id"))
    gone = measured(with_winners(digests, support).where("row != winner.row").select("row"))
    return without_rows(rows, gone)
