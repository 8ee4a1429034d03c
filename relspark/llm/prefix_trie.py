"""Trie of conversations by their turns: which beginnings are shared, by whom, and how much text that saves.

A turn is known by a fixed-width id: the first 16 bytes, big-endian, of the SHA-256 of its role and text.
A conversation is the string of its turns' ids, cut into blocks of SPAN turns. A block is keyed by its number, a digest
of all blocks before it, and its ids; so blocks of equal beginnings are alike and no row grows with the
length of a conversation. Equal blocks are counted before they are dealt out by key range; each task then builds an
adaptive radix tree over its blocks. Only byte depths at which a turn ends give nodes of the trie; what lies
between them are the tree's own. A node that lies in several tasks has one identity, the digest of its path,
under which its parts are added up.

A node belongs to the smallest conversation in it. So the nodes of a conversation are the lower end of
its path, and sums over a subtree are sums over members: of what each owns, less what its owner has above
the node. That takes a second pass of the same trees and no recursion from node to node.

Positions come from range partitioning, so one conversation may hold any share of the rows. Ids of the
members that end at a node are hashed as a stream, from pieces that tasks have joined before.

Turns are ordered by number, null first; equal numbers by their ids. Null role or text counts as empty. Rows
without conversation id belong to none and are left out. Repeated rows are repeated turns. Negative ids take the
remainder that SQL gives (c % 5 has the sign of c). An empty table has no trie: the result is empty.
Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relspark.llm.radix_tree import RadixTree
from relspark.llm.rows import column, text_of
from relspark.operators.joins import sized_join
from relspark.operators.ranking import with_index
from relspark.sources.stored import measured, stored

#: Bytes of a turn's id, turns of a block, and the bytes before a block's ids: its number and a digest.
ID, SPAN, HEAD = 16, 256, 48
#: Conversations of one family share a beginning of up to MOST_SHARED turns of the family's first.
FAMILY, MOST_SHARED = 5, 8
#: A task's tree is given out and begun anew after so many bytes of keys.
MOST_BYTES, BATCH, PIECE = 32 << 20, 8192, 1 << 20

_LANES = 8
_NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """As hex digits. The length of the role keeps (ab, c) and (a, bc) apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * ID)


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family, if there are so many."""
    return F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt_turns(conversations: DataFrame, conv_column: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(conv, d, tid, size) of all turns after rebuilding, and (conv) of those left without turns."""
    role, text = text_of(conversations, "role"), text_of(conversations, "text")
    rows = conversations.select(
        column(conversations, conv_column).cast("long").alias("conv"),
        column(conversations, "turn").alias("turn"),
        turn_id(role, text).alias("tid"),
        F.octet_length(text).cast("long").alias("size"),
    ).where("conv IS NOT NULL")
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("tid")]
    rows = stored(with_index(rows, order, "place", "long").drop("turn"))
    sizes = stored(rows.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    firsts = sizes.select(F.col("conv").alias("family"), F.col("n").alias("given"))
    convs = (
        sizes.withColumn("family", F.col("conv") - F.col("conv") % FAMILY)
        .withColumn("skipped", shared_turns(F.col("conv")))
        .join(firsts, "family", "left")
        .withColumn("taken", F.least("skipped", F.coalesce("given", F.lit(0))))
        .select("conv", "family", "first", "n", "skipped", "taken")
    )
    convs = measured(convs)
    rows = sized_join(rows, convs, ["conv"], ["place"]).withColumn("at", F.col("place") - F.col("first"))
    own = rows.where("at >= skipped").select(
        "conv", (F.col("taken") + F.col("at") - F.col("skipped")).alias("d"), "tid", "size"
    )
    heads = rows.where((F.col("at") < MOST_SHARED) & (F.col("conv") == F.col("family"))).select(
        "family", "at", "tid", "size"
    )
    begun = convs.df.select("conv", "family", "taken").where("taken > 0").join(heads, "family")
    begun = begun.where("at < taken").select("conv", F.col("at").alias("d"), "tid", "size")
    return own.unionByName(begun), convs.df.where("taken = 0 AND n <= skipped").select("conv")


def blocks_of(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """Stored (conv, block, digest, key, sizes, up, before, total, ends).

    `digest` stands for all blocks before; `up` is the node in which the block before ends, `ends` the
    one in which this block ends if it is the last; `before` and `total` count bytes of the conversation.
    """
    block = F.floor(F.col("d") / SPAN).cast("long")
    blocks = (
        turns.groupBy("conv", block.alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("d", "tid", "size"))).alias("turns"))  # SPAN at most
        .select(
            "conv",
            "block",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["tid"]), "")).alias("key"),
            F.transform("turns", lambda t: t["size"]).alias("sizes"),
        )
    )
    none = turnless.select(
        "conv", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("sizes")
    )
    blocks = blocks.unionByName(none)
    whole = W.partitionBy("conv")
    so_far = whole.orderBy("block")
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    mark = F.sha2(F.concat(F.col("block").cast("string").cast("binary"), F.lit(b":"), "key"), 256)
    blocks = blocks.withColumn("size", size).withColumn("mark", mark)
    # the digests before are added lane by lane; each holds its block's number, so their order counts
    lanes = [
        F.sum(F.conv(F.substring("mark", 8 * k + 1, 8), 16, 10).cast("long")).over(before).cast("string")
        for k in range(_LANES)
    ]
    path = F.unhex(F.sha2(F.concat_ws(",", *lanes), 256))
    blocks = blocks.select(
        "conv", "block", "key", "sizes",
        F.when(F.col("block") == 0, F.lit(bytes(32))).otherwise(path).alias("digest"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"),
        F.sum("size").over(whole).alias("total"),
        F.max("block").over(whole).alias("last"),
    )
    blocks = blocks.withColumn("end", F.substring(F.unhex(F.sha2(F.concat("digest", "key"), 256)), 1, ID))
    blocks = blocks.withColumn("up", F.lag("end").over(so_far))
    return stored(
        blocks.withColumn("ends", F.when(F.col("block") == F.col("last"), F.col("end"))).drop("last", "end")
    )


_NODES = pa.schema(
    [("id", pa.binary()), ("up", pa.binary())]
    + [(n, pa.int64()) for n in ("depth", "bytes", "before", "a", "b", "least")]
)
_NODE_TYPES = "id binary, up binary, depth long, bytes long, before long, a long, b long, least long"


def _nodes_of(tree: RadixTree, rows: list[tuple]) -> Iterator[tuple]:
    """The nodes of the trie in a tree: at each whole turn behind the head, and the root in block 0."""
    order = tree.total()
    states: list[tuple] = []  # per tree node: digest so far, bytes of a turn not whole yet, turns, bytes, id
    for node, parent, byte in order:
        if parent < 0:
            state, path, turn, done, up = hashlib.sha256(), node.prefix, 0, 0, None
        else:
            state, path, turn, done, up = states[parent]
            state, path = state.copy(), path + bytes((byte,)) + node.prefix
        block, sizes, before, first = rows[node.row]
        whole = len(path) - len(path) % ID
        for at in range(0, whole, ID):
            turn += 1
            if turn > 1:  # the block's number is not part of a path
                state.update(path[at : at + ID])
            k = turn - HEAD // ID
            if k < 0:
                continue
            this = state.digest()[:ID]
            size = sizes[k - 1] if k else 0
            if k or not block:
                above = (up if k > 1 or not block else first) if k else None
                yield this, above, block * SPAN + k, size, before + done, node.a, node.b, node.least
            done, up = done + size, this
        states.append((state, path[whole:], turn, done, up))


def trie_nodes(blocks: DataFrame) -> DataFrame:
    """(id, up, depth, bytes, before, a, b, least) of the nodes of (block, digest, key, sizes, up, before, a, b, least).

    a and b are summed over the members, `least` is the smallest; `bytes` is the size of the node's own turn, `before`
    that of all turns above it.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, held = RadixTree(), [], 0
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("block", "digest", "key", "sizes", "up", "before", "a", "b", "least")]
            for block, digest, key, sizes, up, before, a, b, least in zip(*columns, strict=True):
                tree.add(block.to_bytes(ID, "big") + digest + key, len(rows), a, b, least)
                rows.append((block, sizes, before, up))
                held += len(key) + 256
                if held > MOST_BYTES:
                    yield from given_out(tree, rows)
                    tree, rows, held = RadixTree(), [], 0
        yield from given_out(tree, rows)

    def given_out(tree: RadixTree, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        some = []
        for found in _nodes_of(tree, rows):
            some.append(found)
            if len(some) == BATCH:
                yield as_batch(some)
                some = []
        if some:
            yield as_batch(some)

    def as_batch(some: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*some, strict=True), _NODES, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=_NODES)

    order = ["block", "digest", "key"]
    dealt = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = dealt.mapInArrow(build, _NODE_TYPES)
    same = [F.first(c).alias(c) for c in ("up", "depth", "bytes", "before")]
    return parts.groupBy("id").agg(*same, F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("least").alias("least"))


def hashed_ids(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the comma-joined, ascending conversation ids of each (id, conv).

    A hash of one list is sequential by nature; the ids are joined into pieces by the tasks of a range
    partitioning, and only those are read in order by the task of their node, one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, some, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for key, conv in zip(batch["id"].to_pylist(), batch["conv"].to_pylist(), strict=True):
                if key != now or size > PIECE:
                    if some:
                        out.append((now, first, ",".join(some)))
                    now, first, some, size = key, conv, [], 0
                some.append(str(conv))
                size += len(some[-1]) + 1
            if out:
                yield batch_of(out, pieces)
                out = []
        if some:
            yield batch_of([(now, first, ",".join(some))], pieces)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for key, ids in zip(batch["id"], batch["ids"], strict=True):
                key, ids = key.as_py(), ids.as_py().encode()
                if key == now:
                    state.update(b"," + ids)
                    continue
                if state:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids)
            if out:
                yield batch_of(out, results)
                out = []
        if state:
            yield batch_of([(now, state.hexdigest())], results)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    pieces = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    results = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
    some = ends.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
    some = some.mapInArrow(joined, "id binary, first long, ids string")
    some = some.repartition("id").sortWithinPartitions("id", "first").select("id", "ids")
    return some.mapInArrow(hashed, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_column: str = "conv_id") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    turns, turnless = rebuilt_turns(conversations, conv_column)
    blocks = blocks_of(turns, turnless)
    alike = blocks.groupBy("block", "digest", "key").agg(
        F.first("sizes").alias("sizes"),
        F.first("up").alias("up"),
        F.first("before").alias("before"),
        F.count("*").alias("a"),
        F.sum("total").alias("b"),
        F.min("conv").alias("least"),
    )
    nodes = stored(
        trie_nodes(alike).withColumnsRenamed({"a": "n_convs", "b": "total", "least": "conv"})
    )
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "id", "left").fillna(0, ["n_children"]))
    # what each conversation owns: the lower end of its path, and whether that ends without children
    owned = stored(
        nodes.groupBy("conv").agg(
            F.sum("bytes").alias("a"),
            F.max_by((F.col("n_children") == 0).cast("long"), "depth").alias("b"),
            F.min_by(F.struct("depth", "before", "up"), "depth").alias("top"),
        )
    )
    members = blocks.join(owned.select("conv", "a", "b"), "conv").withColumn("least", F.col("conv"))
    below = trie_nodes(members).select("id", F.col("a").alias("owned"), F.col("b").alias("n_leaves"))
    # a parent has another owner only above the highest node that a conversation owns
    owner = measured(nodes.select(F.col("id").alias("up"), F.col("conv").alias("parent_conv")))
    tops = owned.select("conv", "top.*")
    tops = sized_join(tops, owner, ["up"], ["conv"], "left").select(
        "conv", F.col("depth").alias("top_depth"), F.col("before").alias("top_before"), "parent_conv"
    )
    ends = blocks.where("ends IS NOT NULL").select(F.col("ends").alias("id"), "conv")
    found = nodes.join(below, "id").join(hashed_ids(ends), "id", "left")
    found = sized_join(found, measured(tops), ["conv"], ["id"])
    distinct = F.col("owned") - (F.col("before") - F.col("top_before"))
    return found.select(
        F.col("conv").alias(conv_column),
        "depth",
        F.when(F.col("depth") > F.col("top_depth"), F.col("conv")).otherwise(F.col("parent_conv")).alias(f"parent_{conv_column}"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("total") - F.col("n_convs") * F.col("before") - distinct).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256"),
    )
