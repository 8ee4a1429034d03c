"""Benchmark contamination: winnowed word-gram fingerprints joined to those of the benchmark, extended.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z became lower case. A window is
WINDOW consecutive words of a benchmark item; an item of fewer words is one window. A document word
is hit if it lies in any occurrence of any window.

Winnowing keeps, in every run of WINDOW - GRAM + 1 consecutive grams of GRAM words, those with the
least hash. So each window, wherever it occurs, keeps the same grams on both sides, and at least
one: no occurrence is missed. Grams of documents are first held against a bit map of the benchmark's
fingerprints, whose size is fixed whatever the benchmark's; it lets through every shared gram and a
few others. What is left is joined on the fingerprint, compared word by word, and extended to both
sides while words are equal. Extended spans of WINDOW words or more are the hits.

A passage may be in many items and many documents. Grams with equal surroundings are one class with a list
of items; documents meet classes, and items are listed once for each distinct set of classes met, so the
work grows with documents plus items, not with their product.

Items shorter than a window are looked up by the gram of all their words, for each such length.

Null text has no words: no hits, and as an item no window. Rows with the same id, or none, are told
apart. Repeated items with different ids count each; items without id hit words but are not counted. Empty tables give an empty result, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, numbered, text_of, without_rows
from relspark.llm.words import Words, runs, span_hashes, words_of
from relspark.operators.joins import sized_join
from relspark.sources.stored import measured, stored

WINDOW = 10
GRAM = 5
#: Bits of the map of benchmark fingerprints: 2^27 bits are 16 MB, for a benchmark of any size.
MAP_BITS = 27
PAGE_BITS = 15

GRAMS = (
    "array<struct<span:int,fp:long,pos:int,gram:array<string>,before:array<string>,after:array<string>>>"
)
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Of every k consecutive words, also across texts."""
    out = np.full(max(0, len(hashes) - k + 1), np.uint64(k))
    for j in range(k):
        out = (out + hashes[j : j + len(out)]) * _RADIX
        out ^= out >> np.uint64(31)
    return out


def winnowed(grams: np.ndarray, text: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of grams that are the least of a whole window inside one text; ties all count."""
    run = window - k + 1
    n = len(text) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = text[:n] == text[window - 1 :]
    least = grams[:n].copy()
    for j in range(1, run):
        np.minimum(least, grams[j : j + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for j in range(run):
        chosen[j : j + n] |= whole & (grams[j : j + n] == least)
    return np.flatnonzero(chosen)


def selected_grams(
    words: Words, window: int, k: int, short: list[int]
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words needed, gram length, positions, fingerprints): winnowed ones, then all of each short length."""
    hashes = span_hashes(words.data, words.starts, words.ends)
    text = words.text_of_word()
    grams = gram_hashes(hashes, k)
    at = winnowed(grams, text, window, k)
    yield window, k, at, grams[at]
    for n in short:
        grams = gram_hashes(hashes, n)
        at = np.flatnonzero(text[: len(grams)] == text[n - 1 :])
        yield n, n, at, grams[at]


def _row(words: Words, text: int, span: int, k: int, at: int, fp: int, reach: int) -> dict:
    low, high = words.first[text], words.first[text + 1]
    before = range(at - 1, max(low, at - reach) - 1, -1)
    after = range(at + k, min(high, at + k + reach))
    return {
        "span": span,
        "fp": fp,
        "pos": int(at - low),
        "gram": [words.word(i) for i in range(at, at + k)],
        "before": [words.word(i) for i in before],
        "after": [words.word(i) for i in after],
    }


def with_grams(
    rows: DataFrame, window: int, k: int, short: list[int], bit_map=None, whole_items: bool = False
) -> DataFrame:
    """(row, id, n_words, grams) of (row, id, text); with a bit map only grams whose bit is set.

    whole_items: a text shorter than the window is one gram, and nothing else of it is kept.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bit_map is None else np.frombuffer(bit_map.value, np.uint8)
        for batch in batches:
            for first, texts in runs(batch["text"]):
                words = words_of(texts)
                counts = words.counts()
                found: list[list[dict]] = [[] for _ in counts]
                lengths = range(1, window) if whole_items else short
                for span, size, at, fps in selected_grams(words, window, k, list(lengths)):
                    if known is not None:
                        bit = fps >> np.uint64(64 - MAP_BITS)
                        seen = known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                        at, fps = at[seen > 0], fps[seen > 0]
                    owner = np.searchsorted(words.first, at, "right") - 1
                    if whole_items and span < window:
                        fits = counts[owner] == span
                        at, fps, owner = at[fits], fps[fits], owner[fits]
                    reach = window - size if span == window else 0
                    signed = fps.view(np.int64).tolist()
                    for t, a, fp in zip(owner.tolist(), at.tolist(), signed, strict=True):
                        found[t].append(_row(words, t, span, size, a, fp, reach))
                keys = [batch[c].slice(first, len(texts)) for c in ("row", "id")]
                columns = [*keys, pa.array(counts, pa.int64()), pa.array(found, _GRAMS)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "id", "n_words", "grams"]
    return rows.mapInArrow(read, f"row long, id {kind}, n_words long, grams {GRAMS}")


_GRAMS = pa.list_(
    pa.struct(
        [
            ("span", pa.int32()),
            ("fp", pa.int64()),
            ("pos", pa.int32()),
            ("gram", pa.list_(pa.string())),
            ("before", pa.list_(pa.string())),
            ("after", pa.list_(pa.string())),
        ]
    )
)


def fingerprint_map(grams: DataFrame):
    """A broadcast bit map of the fingerprints `fp`: MAP_BITS fixes its size.

    Bits are combined into pages by Spark; at most 2^(MAP_BITS - PAGE_BITS) pages come to the driver.
    """
    bit = F.shiftrightunsigned("fp", 64 - MAP_BITS)
    word = F.struct(
        F.shiftright(bit, PAGE_BITS).alias("page"), (bit % (1 << PAGE_BITS)).alias("bit")
    )
    pages = (
        grams.select(F.inline(F.array(word)))
        .distinct()
        .groupBy("page")
        .agg(F.collect_list(F.col("bit").cast("int")).alias("bits"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for bits in batch["bits"].to_pylist():
                page = np.zeros(1 << PAGE_BITS, np.uint8)
                page[bits] = 1
                packed.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["page"], pa.array(packed, pa.binary())], ["page", "packed"])

    whole = bytearray(1 << (MAP_BITS - 3))
    size = 1 << (PAGE_BITS - 3)
    for page, packed in pages.mapInArrow(pack, "page long, packed binary").collect():
        whole[page * size : (page + 1) * size] = packed
    return grams.sparkSession.sparkContext.broadcast(bytes(whole))


def equal_words(a: str, b: str) -> Column:
    """How many words of two lists are equal from the start on."""
    upto = F.least(F.size(a), F.size(b))
    places = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)))


def place_id(place: str) -> Column:
    """A name for a gram with what is around it: equal ones of several items are one class."""
    return F.sha2(F.to_json(place), 256)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    row: Column | None = None,
) -> DataFrame:
    """(row, id, n_words, n_hit, n_items, items, spans) of every document.

    items: sorted ids, as text, of items with an occurring window. spans: hit ranges [from, to) of
    word positions, sorted; they may overlap.
    """
    given = items.select(
        F.monotonically_increasing_id().alias("row"),
        column(items, item_column).alias("id"),
        text_of(items, item_text_column).alias("text"),
    )
    marked = with_grams(given, window, gram, [], whole_items=True).select("id", F.inline("grams"))
    place = F.struct("span", "fp", F.col("gram").alias("item_gram"), F.col("before").alias("item_before"),
                     F.col("after").alias("item_after"))
    named = stored(marked.select(F.col("id").cast("string").alias("item"), place.alias("place"), place_id("place").alias("class")))
    marks = measured(named.groupBy("class").agg(F.first("place").alias("place")).select("class", "place.*"))
    items_of = measured(named.select("class", "item").distinct())
    # at most window - 1 lengths
    lengths = marks.df.where(F.col("span") < window).select("span").distinct().collect()
    short = sorted(r["span"] for r in lengths)
    texts = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        column(docs, id_column).alias("id"),
        text_of(docs, text_column).alias("text"),
    )
    found = stored(with_grams(texts, window, gram, short, fingerprint_map(marks.df)))
    asked = found.select("row", F.inline("grams"))
    length = F.size("gram") + F.col("left") + F.col("right")
    hits = (
        sized_join(asked, marks, ["fp", "span"], ["row", "pos"])
        .where("gram = item_gram")
        .withColumn("left", equal_words("before", "item_before"))
        .withColumn("right", equal_words("after", "item_after"))
        .where(length >= F.col("span"))
        .select(
            "row",
            "class",
            F.struct(
                (F.col("pos") - F.col("left")).alias("from"),
                (F.col("pos") + F.size("gram") + F.col("right")).alias("to"),
            ).alias("span"),
        )
    )
    hit = stored(
        hits.groupBy("row")
        .agg(F.array_sort(F.collect_set("class")).alias("classes"), F.collect_set("span").alias("spans"))
        .withColumn("together", F.sha2(F.array_join("classes", ","), 256))
    )
    sets = hit.groupBy("together").agg(F.first("classes").alias("classes"))
    met = sized_join(sets.select("together", F.explode("classes").alias("class")), items_of, ["class"], ["together"])
    lists = measured(met.groupBy("together").agg(F.array_sort(F.collect_set("item")).alias("items")))
    of_row = sized_join(hit.drop("classes"), lists, ["together"], ["row"], "left")
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s["from"], s["to"] - 1)))
    no_items, no_spans = F.array().cast("array<string>"), F.array().cast("array<struct<from:int,to:int>>")
    return found.select("row", "id", "n_words").join(of_row, "row", "left").select(
        "row",
        "id",
        "n_words",
        F.coalesce(F.size(F.array_distinct(positions)), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", no_items).alias("items"),
        F.coalesce(F.array_sort("spans"), no_spans).alias("spans"),
    )


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """The documents that no window occurs in, with their columns."""
    rows = numbered(docs)
    doc = rows.select("row", F.col("doc").getField(id_column).alias("id"), F.col("doc").getField(text_column).alias("text"))
    found = contamination(doc, items, "id", "text", window=window, gram=gram, row=F.col("row"))
    return without_rows(rows, measured(found.where("n_hit > 0").select("row")))
