"""SimHash near-duplicates: fingerprints within a few differing bits, found by pigeonring chains.

A fingerprint has bit b set if more than half of the hashes of a text's word shingles have it set.
Hashes are XXH64 with seed 42. Words are runs without ASCII white space, A-Z lower-cased; a text
of fewer words than a shingle is one shingle, and one without words has fingerprint 0.

Candidates. Cut the 64 bits into m = 2 t + 1 segments on a ring. If two fingerprints differ in at
most t bits, there is a segment from which every chain of 1, 2, ..., m segments differs in at most
chain * t / m bits in all (pigeonring principle, rounded down). So from that segment on, the first
two segments are equal and the first four differ in at most one bit (t = 2). This prefix of the
chain is looked up in an index: one key for each start and fingerprint, and one probe for each bit
of the later segments, set where it is not. Keys hold four fifths of the bits, which bounds what
shares a key even in a dense group of near copies. The rest of the chain is then checked step by
step, and the full chain is the Hamming distance itself.

Only distinct fingerprints are compared, each once with the least id of its rows; copies are never
expanded into pairs. Components come from contraction: each fingerprint points to the neighbour
that comes first in a random order, links are carried over to those, until none is left.

One fingerprint, or one component, may hold a third of all rows: joins on them broadcast the side of
one row each if it was measured to fit, else they cut hot keys into pieces.

Null text counts as empty. Texts without words all have fingerprint 0 and are linked like any other.
Long texts are read whole, their bits counted in blocks. Repeated rows, and rows with equal ids or none,
are rows of their own; rows without id come after those with one. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, least_row, numbered, text_of, without_rows
from relspark.llm.words import runs
from relspark.operators.joins import sized_join
from relspark.sources.stored import Stored, measured, stored

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle_words, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        parts = (part.cast(pa.binary()).to_pylist() for _, part in runs(texts))
        values = [fingerprint(t, shingle_words) for part in parts for t in part]
        return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return fingerprints(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def segments(max_bits: int) -> list[int]:
    """Masks of the 2 t + 1 segments, their sizes at most one bit apart."""
    m = 2 * max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_masks(max_bits: int, start: int) -> list[tuple[int, int]]:
    """(mask of the chain's first 1, 2, ... segments, bits in which they may differ)."""
    parts = segments(max_bits)
    m, mask, out = len(parts), 0, []
    for length in range(1, m + 1):
        mask |= parts[(start + length - 1) % m]
        out.append((mask, length * max_bits // m))
    return out


def chain_holds(differing: Column, max_bits: int, start: int) -> Column:
    holds = F.lit(True)
    for mask, budget in chain_masks(max_bits, start):
        holds &= F.bit_count(differing.bitwiseAND(F.lit(_signed(mask)))) <= budget
    return holds


def linked_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints `fp` within max_bits, each once."""
    fp = F.col("fp")
    keys, probes = [], []
    for start in range(2 * max_bits + 1):
        chain = chain_masks(max_bits, start)
        equal = max(mask for mask, budget in chain if budget == 0)
        whole = max(mask for mask, budget in chain if budget <= 1)
        key = fp.bitwiseAND(F.lit(_signed(whole)))

        def entry(value: Column, start: int = start) -> Column:
            return F.struct(F.lit(start).alias("start"), value.alias("key"))

        keys.append(entry(key))
        probes.append(entry(key))
        for bit in _bits(whole & ~equal):
            one = F.lit(_signed(1 << bit))
            probes.append(F.when(fp.bitwiseAND(one) == 0, entry(key.bitwiseOR(one))))
    index = prints.select(fp.alias("b"), F.inline(F.array(*keys)))
    asked = prints.select(fp.alias("a"), F.inline(F.array_compact(F.array(*probes))))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None)  # the first start from which the chain holds: each pair counts there
    for start in reversed(range(2 * max_bits + 1)):
        first = F.when(chain_holds(differing, max_bits, start), F.lit(start)).otherwise(first)
    # a probe with a bit set meets only fingerprints that have it; equal keys meet from both sides
    same_key = F.lit(True)
    for start in range(2 * max_bits + 1):
        whole = max(mask for mask, budget in chain_masks(max_bits, start) if budget <= 1)
        equal_keys = differing.bitwiseAND(F.lit(_signed(whole))) == 0
        same_key = F.when(F.col("start") == start, equal_keys).otherwise(same_key)
    once = ~same_key | (F.col("a") < F.col("b"))
    return (
        asked.join(index, ["start", "key"])
        .where(once & (first == F.col("start")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def renamed(table: Stored, **names: str) -> Stored:
    """The same table with other column names."""
    columns = [F.col(old).alias(new) for old, new in names.items()]
    return Stored(table.df.select(*columns), table.rows, table.size)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; nodes of one component have the same root.

    Each round halves the nodes or better on average, so the rounds grow with the logarithm of the
    largest component. The driver sees only row counts.
    """
    edges = measured(pairs)
    hops = []
    while edges.rows:
        turn = len(hops)

        def place(name: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), name).alias("place"), F.col(name).alias("node"))

        both = edges.df.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.df.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        nearest = both.groupBy("node").agg(F.min(place("other")).alias("nearest"))
        first = F.least(place("node"), "nearest")
        hop = measured(nearest.select("node", first["node"].alias("root")))
        hops.append(hop)
        a = renamed(hop, node="a", root="ra")
        b = renamed(hop, node="b", root="rb")
        moved = sized_join(sized_join(edges.df, a, ["a"], ["b"]), b, ["b"], ["a"]).where("ra != rb")
        ends = (F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = measured(moved.select(*ends).distinct())
    if not hops:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = hops.pop()
    while hops:
        further = renamed(roots, node="root", root="end")
        moved = sized_join(hops.pop().df, further, ["root"], ["node"], "left")
        roots = measured(moved.select("node", F.coalesce("end", "root").alias("root")))
    return roots.df


def fingerprint_classes(table: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, best): for every fingerprint the first row, by id, of its whole component."""
    classes = stored(table.groupBy("fp").agg(F.min(least_row("id")).alias("own")))
    pairs = linked_pairs(classes.select("fp"), max_bits)
    roots = components(pairs).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp")
    best = measured(linked.groupBy("root").agg(F.min("own").alias("joint")))
    members = linked.select("fp", "root")
    joint = stored(sized_join(members, best, ["root"], ["fp"]).select("fp", "joint"))
    return classes.join(joint, "fp", "left").select("fp", F.coalesce("joint", "own").alias("best"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(<id>, fingerprint, component_id) of every row.

    component_id is the least id in the component; null only if none of its rows has an id.
    """
    fp = fingerprint_of(text_of(docs, text_column), shingle_words).alias("fp")
    row = F.monotonically_increasing_id().alias("row")
    table = stored(docs.select(column(docs, id_column).alias("id"), fp, row))
    classes = measured(fingerprint_classes(table, max_bits))
    found = sized_join(table, classes, ["fp"], ["row"])
    return found.select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
    )


def without_near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row of each component with its columns: that of the least id; of equal ids one."""
    rows = numbered(docs, fp=fingerprint_of(text_of(docs, text_column), shingle_words))
    table = rows.select("row", "fp", F.col("doc").getField(id_column).alias("id"))
    kept = fingerprint_classes(table, max_bits).select("best.row").distinct()
    gone = measured(table.select("row").join(kept, "row", "left_anti"))
    return without_rows(rows, gone)
