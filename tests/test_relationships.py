import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brute import edges as brute_edges
from relspark.operators import joins, relationships as R
from relspark.operators.latest import latest_rows, latest_values
from relspark.sources.schemas import FEATURES, KNOWLEDGE_BASE, Feature

OBJECT = T.StructType([T.StructField("object_id", T.StringType())])


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], OBJECT)


def as_dict(df):
    rows = df.collect()
    found = {
        (r.object_id, r.other_id, r.feature_type, round(r.weight, 9)): r.ts for r in rows
    }
    assert len(found) == len(rows), "an edge came twice"
    return found


SAMPLE = [
    ("x", "pehash", "p1", day(1)),
    ("x", "pehash", "p2", day(2)),
    ("y", "pehash", "p1", day(1)),
    ("z", "pehash", "p2", day(1)),
    ("z", "pehash", "p2", day(3)),
    ("w", "imphash", "i1", day(1)),
]


def test_sample_edges(spark):
    kb = spark.createDataFrame(SAMPLE, KNOWLEDGE_BASE)
    found = as_dict(R.exact_edges(kb, ids(spark, "x", "y", "w")))
    assert found == {
        ("x", "z", "pehash", 0.5): day(3),
        ("y", "x", "pehash", 0.5): day(1),
    }


def test_sample_record(spark):
    kb = spark.createDataFrame(SAMPLE, KNOWLEDGE_BASE)
    targets = ids(spark, "x", "w", "nothing")
    edges = R.primary_relationships(kb, targets)
    records = R.relationship_records(kb, targets, edges, F.lit(day(9)))
    rows = {r.object_id: r for r in records.collect()}
    assert set(rows) == {"x", "w", "nothing"}
    assert [(m.sha256, m.weight) for m in rows["x"].pehash] == [("z", 0.5)]
    assert rows["x"].imphash is None
    assert rows["w"].pehash is None and rows["w"].imphash == []
    assert rows["nothing"].pehash is None and rows["nothing"].part == 0
    text = {r.object_id: r for r in R.records_as_json(records).collect()}
    assert text["x"].pehash == '[{"sha256":"z","weight":0.5}]'
    assert text["w"].imphash == "[]"
    blobs = {r.object_id: r for r in R.records_as_blobs(records).collect()}
    assert gzip.decompress(blobs["w"].imphash) == b"[]" and blobs["w"].pehash is None


def random_kb(seed, objects=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(90):
        f = rng.choice(FEATURES)
        if f.exact:
            value = rng.choice(["v1", "v2", "v3"])
        else:
            value = ",".join(rng.choice("aabcd") for _ in range(rng.randrange(4)))
            value += "," * rng.randrange(3)
        rows.append((f"o{rng.randrange(objects)}", f.name, value, day(rng.randrange(20))))
    return rows + rows[:5]


@pytest.mark.parametrize("force_salt", [False, True])
@pytest.mark.parametrize("as_sets", [False, True])
def test_edges_equal_brute_force(spark, monkeypatch, force_salt, as_sets):
    if force_salt:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        defaults = list(joins.salted_join.__defaults__)
        monkeypatch.setattr(joins.salted_join, "__defaults__", (*defaults[:-1], 2))
    rows = random_kb(7)
    kb = spark.createDataFrame(rows, KNOWLEDGE_BASE)
    targets = [f"o{i}" for i in range(12)]
    found = as_dict(R.primary_relationships(kb, ids(spark, *targets), as_sets=as_sets))
    expected = brute_edges(rows, targets, FEATURES, as_sets)
    assert found == expected
    if not as_sets:
        assert any(k[3] > 1 for k in expected), "repeats should push a weight above 1"


def test_best_only_keeps_the_greatest_weight(spark):
    rows = [
        ("t", "yara_rules", "a,b", day(5)),
        ("o", "yara_rules", "a,b", day(1)),
        ("o", "yara_rules", "a,c", day(2)),
    ]
    kb = spark.createDataFrame(rows, KNOWLEDGE_BASE)
    every = as_dict(R.overlap_edges(kb, ids(spark, "t")))
    best = as_dict(R.overlap_edges(kb, ids(spark, "t"), best_only=True))
    assert len(every) == 2
    assert best == {("t", "o", "yara_rules", 1.0): day(1)}


def test_related_counts_equal_the_edges(spark):
    rows = random_kb(11)
    kb = spark.createDataFrame(rows, KNOWLEDGE_BASE)
    counts = {
        (r.object_id, r.feature_type): (r.n_related, r.total_weight)
        for r in R.related_counts(kb).collect()
    }
    every = brute_edges(rows, [f"o{i}" for i in range(12)], [f for f in FEATURES if f.exact])
    for (o, f), (n, total) in counts.items():
        mine = [k for k in every if k[0] == o and k[2] == f]
        assert n == len(mine) and total == pytest.approx(sum(k[3] for k in mine))
    top = R.most_related(R.related_counts(kb), 3).collect()
    assert len(top) == 3 and top[0].total_weight >= top[2].total_weight


def test_hot_value_is_split_over_parts(spark):
    rows = [(f"o{i}", "pehash", "same", day(1)) for i in range(60)]
    rows.append(("solo", "pehash", "other", day(1)))
    kb = spark.createDataFrame(rows, KNOWLEDGE_BASE)
    targets = ids(spark, "o0", "solo")
    edges = R.primary_relationships(kb, targets, [Feature("pehash", 0.5, "pehash")])
    records = R.relationship_records(kb, targets, edges, F.lit(day(2)), parts=4).collect()
    mine = [r for r in records if r.object_id == "o0"]
    assert sorted(r.part for r in mine) == [0, 1, 2, 3]
    matches = [m.sha256 for r in mine for m in (r.pehash or [])]
    assert sorted(matches) == sorted(f"o{i}" for i in range(1, 60))
    assert [r.pehash for r in records if r.object_id == "solo"] == [[]]


def test_salted_join_equals_plain_join(spark):
    big = spark.range(500).select(
        F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        "id",
    )
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, v int")
    hot = {r.k: r._pieces for r in joins.hot_keys(big, ["k"], 50).collect()}
    assert hot == {"hot": 6}
    for how in ("inner", "left", "left_semi"):
        salted = joins.salted_join(big, small, ["k"], ["id"], how, rows_per_piece=50)
        plain = big.join(small, ["k"], how)
        assert salted.columns == plain.columns
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, salted.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_every_hot_key_is_cut(spark):
    big = spark.range(13_000).selectExpr("id % 1300 AS k", "id")
    hot = joins.measured_hot_keys(big, ["k"], 4).collect()
    assert len(hot) == 1300 and {r._pieces for r in hot} == {3}


def test_latest(spark):
    kb = spark.createDataFrame(SAMPLE + [("x", "pehash", "p9", day(2))], KNOWLEDGE_BASE)
    got = {(r.object_id, r.feature_type): r.feature_value for r in latest_values(kb).collect()}
    assert got[("x", "pehash")] == "p9" and got[("z", "pehash")] == "p2"
    rows = latest_rows(kb, ["object_id", "feature_type"], [F.desc("ts"), F.desc("feature_value")])
    assert {(r.object_id, r.feature_type): r.feature_value for r in rows.collect()} == got


def test_edge_views(spark):
    rows = [
        ("a", "b", "pehash", 0.5, day(1)),
        ("a", "b", "yara_rules", 1.5, day(1)),
        ("a", "c", "yara_rules", 0.2, day(1)),
    ]
    edges = spark.createDataFrame(
        rows, "object_id string, other_id string, feature_type string, weight double, ts timestamp"
    )
    assert R.above(edges, 0.5).count() == 1
    assert R.with_features(edges, ["pehash"]).count() == 1
    bars = {r.segment: (r.n_edges, r.n_objects) for r in R.weight_histogram(edges, 0.0, 1.0, 5).collect()}
    assert bars == {2: (1, 1), 3: (1, 1), 6: (1, 1)}
    totals = {r.other_id: r.weight for r in R.total_weights(edges).collect()}
    assert totals == {"b": 2.0, "c": 0.2}
