import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from brute import overlap, split_list
from relspark.functions import text as X
from relspark.functions.time_ids import time_uuid, uuid_timestamp


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("", [""]),
        (",", []),
        (",,", []),
        ("a,b,,", ["a", "b"]),
        (",a", ["", "a"]),
        ("a,,b", ["a", "", "b"]),
        ("a", ["a"]),
    ],
)
def test_split_tokens_drops_trailing_empties_only(spark, value, expected):
    assert one(spark, value, X.split_tokens) == expected
    assert split_list(value) == expected


def test_clean_rules_keeps_rule_prefix_and_deletes_yara(spark):
    text = '{"yara":[{"rule":"A_b"},{"rule":"yarax"}]}'
    assert one(spark, text, X.clean_rules) == "ruleA_b,rulex"
    assert one(spark, text, X.rule_names) == ["A_b", "yarax"]
    assert one(spark, '{"yara":[]}', X.clean_rules) == ""


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Trojan.Win32/Zbot!gen@mm", ["trojan", "zbot"]),
        ("Zbot [Crypt]", ["zbot"]),
        ('"Worm:Conficker" ~x y', ["worm", "conficker"]),
        ("A-variant_of{abc} Foo\\Barr", ["variant", "barr"]),
        ("abc", []),
    ],
)
def test_detection_tokens(spark, name, expected):
    assert one(spark, name, X.detection_tokens) == expected


def test_token_counts(spark):
    tokens = ["b", "a", "b", "", "b"]
    df = spark.createDataFrame([(tokens,), ([],), (None,)], "t array<string>")
    rows = df.select(X.token_counts(F.col("t")).alias("c")).collect()
    assert [(r.token, r.n) for r in rows[0].c] == [("", 1), ("a", 1), ("b", 3)]
    assert rows[1].c == [] and rows[2].c == []


@pytest.mark.parametrize(
    "left, right, weight",
    [
        ("a,b", "b,c", 1 / 3),
        ("a,a", "a,a", 2.0),
        ("a,a", "a", 1.0),
        ("a,b,,", "a,b", 1.0),
        ("", "", 1.0),
        (",", "a", 0.0),
        ("a", "b", 0.0),
    ],
)
def test_overlap_score(spark, left, right, weight):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    assert df.select(X.overlap_score(F.col("l"), F.col("r"))).first()[0] == pytest.approx(weight)
    assert overlap(left, right) == pytest.approx(weight)


def test_overlap_score_as_sets_and_random(spark):
    rng = random.Random(3)
    make = lambda: ",".join(rng.choice("abcd") for _ in range(rng.randrange(5))) + "," * rng.randrange(2)
    pairs = [(make(), make()) for _ in range(200)]
    df = spark.createDataFrame(pairs, "l string, r string")
    rows = df.select(
        "l",
        "r",
        X.overlap_score(F.col("l"), F.col("r")).alias("w"),
        X.overlap_score(F.col("l"), F.col("r"), as_sets=True).alias("s"),
    ).collect()
    for r in rows:
        assert r.w == pytest.approx(overlap(r.l, r.r)), (r.l, r.r)
        assert r.s == pytest.approx(overlap(r.l, r.r, as_sets=True)), (r.l, r.r)


def test_uuid_timestamp(spark):
    for steps in range(12):
        check_uuid(spark, uuid.UUID(fields=(0x5DB98D00 + steps, 0xC99B, 0x11EE, 0x80, 1, 2)))


@pytest.mark.parametrize("year", [1960, 1970, 2026, 2027, 2030, 2050, 2200])
def test_uuid_times_of_other_years(spark, year):
    """To the microsecond, also where a double cannot hold the number of steps."""
    start = int((dt.datetime(year, 6, 1) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    micros = spark.range(5000).select((F.lit(start) + F.col("id") * 7919).alias("us"))
    ts = F.timestamp_micros("us")
    back = micros.select("us", F.unix_micros(uuid_timestamp(time_uuid(ts, "us"))).alias("again"))
    assert back.where("us <> again").count() == 0


def check_uuid(spark, made):
    when = dt.datetime(1582, 10, 15) + dt.timedelta(microseconds=made.time // 10)
    df = spark.createDataFrame([(str(made),)], "u string")
    row = df.select(uuid_timestamp(F.col("u")).alias("ts")).select(
        "ts", time_uuid(F.col("ts"), "ts").alias("again")
    )
    got = row.select("ts", uuid_timestamp(F.col("again")).alias("back"), "again").first()
    assert got.ts == when and got.back == when
    assert uuid.UUID(got.again).version == 1


def test_batches_are_worked_off_in_slices():
    """A batch has as many rows as Spark likes; what Python makes of it at once is bounded in bytes."""
    pa = pytest.importorskip("pyarrow")
    from relspark.functions.arrow_slices import by_slices, slices

    texts = pa.array(["x" * (i % 90) if i % 7 else None for i in range(3000)] + ["y" * 9000, None, ""], pa.string())
    parts = list(slices(texts, 5000))
    assert pa.concat_arrays(parts).equals(texts) and len(parts) > 40
    assert all(part.to_pylist() for part in parts)
    assert all(sum(len(x or "") + 64 for x in part.to_pylist()[1:]) <= 5000 for part in parts)
    assert by_slices(lambda some: some, texts, 5000).equals(texts)
    assert by_slices(lambda some: some, texts.slice(5, 20), 100).equals(texts.slice(5, 20))
    assert len(by_slices(lambda some: some, texts.slice(0, 0))) == 0


def test_udfs_take_bounded_memory_of_a_large_batch():
    """Opcode names of 40 MB of text took more than ten times that as Python objects."""
    pa = pytest.importorskip("pyarrow")
    import json
    import tracemalloc

    from relspark.functions import arrow_slices

    def make(some):
        seen = [json.loads(x)["opcodes"] for x in some.to_pylist()]
        return pa.array([len(x) for x in seen])

    text = json.dumps({"opcodes": [f"word{i}" for i in range(500)]})
    batch = pa.array([text] * 4000)
    tracemalloc.start()
    found = arrow_slices.by_slices(make, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [500] * 4000
    assert peak < 40 << 20


def test_results_of_slices_are_handed_on_one_by_one():
    """The codes of a whole batch were held twice: in parts, and put together."""
    pa = pytest.importorskip("pyarrow")
    from relspark.functions.arrow_slices import in_slices

    made = []

    def make(some):
        made.append(len(some))
        return pa.array([len(x or "") for x in some.to_pylist()])

    batches = [pa.array(["x" * 500] * 40 + [None]), pa.array([], pa.string()), pa.array(["y"])]
    parts = in_slices(make, iter(batches), 5000)
    first = next(parts)
    assert made == [len(first)] and len(first) < 12
    assert pa.concat_arrays([first, *parts]).to_pylist() == [500] * 40 + [0, 1]
