"""Merkle manifest of a table: a leaf hash per row, a tree per group, a tree over the groups, and proofs.

Every node is the SHA-256, as 64 hex digits, of what it joins. Rows of a group ascend by id; every FAN
consecutive nodes are joined while there are several. The roots of the groups are joined likewise.

Levels are kept as strings: a block of FAN ** 3 = 512 consecutive nodes is one row with its lowest level
as one string of 64 digits a node. The next level is made of hashes of fixed-width substrings; what stands left
and right of a node in its run are the siblings of its proof. The roots of the blocks are the nodes of
the next round, in which there are 512 times fewer, until each group has one. Then the same is done with
the groups. Proofs come back down: each block gets the sibling segments above it, once per block.

Rows are numbered by range partitioning, so a group that holds all rows is as good as many; a block
has 512 short members at most. Texts are hashed where they are read and never shuffled.

A null value is hashed as `-`. A null id comes first in its group and is never tampered with; the null group comes
first of all. Rows with equal ids are ordered by their hashes, so the tree does not depend on the
order of the table. Empty and very long texts are hashed as they are. An empty table gives an empty result.
Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column
from relspark.operators.joins import sized_join
from relspark.operators.ranking import with_index
from relspark.sources.stored import measured, stored

FAN, DEPTH, HEX = 8, 3, 64
BLOCK = FAN**DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_SEGMENTS = "array<struct<l: binary, r: binary>>"


def _hash(value: Column) -> Column:
    return F.sha2(value, 256).cast("binary")


def field(value: Column) -> Column:
    """`-`, or the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _up(level: Column, nodes: Column) -> Column:
    """The level above, from the string of one level and its number of nodes."""
    run = FAN * HEX
    place = F.sequence(F.lit(0), F.ceil(nodes / FAN).cast("int") - 1)
    # substrings of binary values are cut at once, those of texts are counted from the start
    hashes = F.transform(place, lambda k: F.sha2(F.substring(level, k * run + 1, F.lit(run)), 256))
    return F.array_join(hashes, "").cast("binary")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """Stored (grp, block, n, members, level0, level1, level2, levels, root) of (grp, pos, n, hash, member).

    n is the number of nodes of the group, `levels` how many of the three joins its blocks need, `root` the
    node each block ends in.
    """
    n = F.col("n")
    rows = (
        nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
        .groupBy("grp", "block")
        .agg(
            F.first("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("pos", "hash", "member"))).alias("members"),  # BLOCK at most
        )
    )
    level = F.array_join(F.transform("members", lambda m: m["hash"]), "").cast("binary")
    rows = rows.select("grp", "block", "n", "members", level.alias("level0"))
    for k in range(DEPTH):
        here = F.col(f"level{k}")
        rows = rows.withColumn(f"level{k + 1}", F.when(n > FAN**k, _up(here, F.octet_length(here) / HEX)))
    levels = sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(1, DEPTH)), F.when(n > 1, 1).otherwise(0))
    root = F.coalesce(*[f"level{k}" for k in range(DEPTH, -1, -1)]).cast("string")
    return stored(rows.select("*", levels.alias("levels"), root.alias("root")).drop(f"level{DEPTH}"))


def rounds_of(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the given nodes, then of their roots, until each group has one block.

    As many rounds as the largest group has digits to the base of 512.
    """
    rounds = [blocks_of(nodes)]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        nodes = rounds[-1].select(
            "grp",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.col("root").alias("hash"),
            F.lit(None).cast("string").alias("member"),
        )
        rounds.append(blocks_of(nodes))
    return rounds


def _own_segments(i: Column) -> Column:
    """What stands left and right of member i in its runs, on the levels of its block."""
    pairs = []
    for k in range(DEPTH):
        level, node = F.col(f"level{k}"), F.floor(i / FAN**k).cast("int")
        first = F.floor(i / FAN ** (k + 1)).cast("int") * FAN
        left = F.substring(level, first * HEX + 1, (node - first) * HEX)
        right = F.substring(level, (node + 1) * HEX + 1, (first + (FAN - 1) - node) * HEX)
        pairs.append(F.struct(left.alias("l"), right.alias("r")))
    return F.slice(F.array(*pairs), 1, F.col("levels"))


def members_of(blocks: DataFrame, more=lambda member, segments: {}) -> DataFrame:
    """(grp, pos, member, hash, segments, ..., subroot, top): the members of blocks with all siblings up to the root.

    `more` makes further values of a member; they are worked out inside the block's row, so that
    its level strings are not copied for each member.
    """

    def each(m: Column, i: Column) -> Column:
        segments = F.concat(_own_segments(i), F.col("above"))
        return F.struct(m["pos"], m["member"], m["hash"], segments.alias("segments"))

    def all_values(m: Column) -> Column:
        named = [value.alias(name) for name, value in more(m, m["segments"]).items()]
        kept = [] if named else [m["segments"]]
        return F.struct(m["pos"], m["member"], m["hash"], *kept, *named)

    found = F.transform(F.transform("members", each), all_values)
    # the outer form: for the inner one Spark works the whole array out a second time, to drop empty ones
    return blocks.select("grp", "subroot", "top", F.explode_outer(found).alias("m")).select(
        "grp", "subroot", "top", "m.*"
    )


def _proved(m: Column, segments: Column) -> dict[str, Column]:
    none, start = F.lit("").cast("binary"), F.coalesce(m["member"]["tampered"], m["hash"]).cast("binary")
    siblings = F.aggregate(segments, none, lambda done, s: F.concat(done, s["l"], s["r"]))
    folded = F.aggregate(segments, start, lambda node, s: _hash(F.concat(s["l"], node, s["r"])))
    return {"proof_sha256": F.sha2(siblings, 256), "folded_root": folded.cast("string")}


def _attached(lower: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks of a round with the segments above them: each is one node of the round above."""
    above = nodes.select(
        "grp", F.col("pos").alias("block"), F.col("segments").alias("above"), "top", "subroot"
    )
    return lower.join(above, ["grp", "block"])


def merkle_manifest(
    docs: DataFrame,
    fields: list[str] = FIELDS,
    group_column: str = "lang",
    id_column: str = "doc_id",
    text_column: str = "text",
    tampered_every: int = 3,
) -> DataFrame:
    """(<id>, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows whose crc32 of the id is divisible by tampered_every have their text lower-cased (A-Z) before
    their path is hashed again with the siblings of the untouched tree.
    """
    key, group = column(docs, id_column), column(docs, group_column).cast("string")
    changed = [lower_ascii(column(docs, f)) if f == text_column else column(docs, f) for f in fields]
    chosen = F.crc32(key.cast("string").cast("binary")) % tampered_every == 0
    rows = docs.select(
        # null first, then bytewise
        F.coalesce(F.concat(F.lit("."), group), F.lit("")).alias("grp"),
        key.alias("key"),
        leaf_of([column(docs, f) for f in fields]).alias("hash"),
        F.when(chosen, leaf_of(changed)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = with_index(rows, [F.col("grp"), F.col("key"), F.col("hash"), F.col("row")], "place", "long")
    groups = stored(
        rows.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    )
    nodes = sized_join(rows, measured(groups), ["grp"], ["row"]).select(
        "grp",
        (F.col("place") - F.col("first")).alias("pos"),
        "n",
        "hash",
        F.struct("key", "tampered").alias("member"),
    )
    below = rounds_of(nodes)

    # the tree over the groups: in the last round each group is one block
    subroots = with_index(below[-1].select("grp", "root"), [F.col("grp")], "pos", "long")
    count = subroots.agg(F.count("*").alias("n"))
    above = rounds_of(
        subroots.crossJoin(F.broadcast(count)).select(  # one row
            F.lit("").alias("grp"), "pos", "n", F.col("root").alias("hash"), F.col("grp").alias("member")
        )
    )
    blocks = above[-1].select(
        "*",
        F.array().cast(_SEGMENTS).alias("above"),
        F.col("root").alias("top"),
        F.lit(None).cast("string").alias("subroot"),
    )
    for lower in reversed(above[:-1]):
        blocks = _attached(lower, members_of(blocks))
    # each node of the lowest blocks is the root of a group, which is the last block of that group
    heads = members_of(blocks).select(
        F.col("member").alias("grp"), F.lit(0).alias("pos"), "segments", "top", F.col("hash").alias("subroot")
    )
    blocks = _attached(below[-1], heads)
    for lower in reversed(below[:-1]):
        blocks = _attached(lower, members_of(blocks))
    found = members_of(blocks, _proved)
    return found.select(
        F.col("member.key").alias(id_column),
        F.col("hash").alias("leaf"),
        "subroot",
        F.col("top").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("top")).alias("verified"),
    )
