import itertools
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import DOCS, awkward, prose, row, table

from relspark.llm import hilbert
from relspark.sources.stored import shared_folder


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = hilbert.curve_index([cells[:, i] for i in range(dimensions)], bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def many():
    rows = []
    for i in range(400):
        lang = "en" if i % 3 else ("de", "fr", None)[i % 7 % 3]
        rows.append(row(1000 + i, prose(i % 90, 5 + i % 40), lang, "hot" if i % 3 == 0 else f"s{i % 11}", i % 50))
    return awkward() + rows


def test_law(spark):
    docs = many()
    got = hilbert.curve_shards(table(spark, docs)).collect()
    raw = [(r[1] or "").encode() for r in docs]
    expected = Counter((r[0], len(t) + 1, zlib.crc32(t)) for r, t in zip(docs, raw, strict=True))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)


def test_fewer_rows_than_shards(spark):
    got = hilbert.curve_shards(table(spark, [row(i, "x") for i in range(5)])).collect()
    assert len({r.shard for r in got}) == 5 and all(r.slot == 0 for r in got)
    assert hilbert.curve_shards(table(spark, [])).count() == 0


def test_files_keep_rows_and_span_little(spark):
    docs = many()
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    name = hilbert.write_shards(table(spark, docs), folder)
    assert name == "shard_"  # the rows have a column `shard`
    found = spark.read.parquet(folder)
    assert Counter(tuple(r) for r in found.select(*[f"`{c}`" for c in DOCS.names]).collect()) == Counter(docs)
    langs = found.groupBy(name).agg({"lang": "min"}).count()
    spans = defaultdict(set)
    for r in found.collect():
        spans[r[name]].add((r.lang, r.source == "hot"))
    assert langs == 16 and np.mean([len(s) for s in spans.values()]) < len({x for s in spans.values() for x in s}) / 2


def test_values_with_a_common_beginning_are_told_apart(spark):
    """The curve is the same whether or not all sources begin alike."""
    plain = [(r[0], r.curve) for r in hilbert.curve_shards(table(spark, many())).collect()]
    at = DOCS.names.index("source")
    long = [tuple("https://site/" * 40 + x if k == at and x is not None else x for k, x in enumerate(r)) for r in many()]
    assert Counter(plain) == Counter((r[0], r.curve) for r in hilbert.curve_shards(table(spark, long)).collect())


@pytest.mark.parametrize("values", [["b"] * 30 + ["a"] * 5 + ["c", None], [f"v{i:03}" for i in range(100)], ["\u00e9", "z", "", "\U0001f600"], [None], []])
def test_string_bounds(spark, values):
    shares = [k / 8 for k in range(1, 8)]
    given = spark.createDataFrame([(v,) for v in values], "value string")
    held = sorted((v for v in values if v is not None), key=lambda v: v.encode())
    expected = [next(v for k, v in enumerate(held, 1) if k >= share * len(held)) if held else None for share in shares]
    assert hilbert.string_bounds(given, shares) == expected
