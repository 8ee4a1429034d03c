import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from relspark.functions import json_fields as J
from relspark.functions.gzip_text import decode_results, gunzip_text, gzip_text, unreadable
from relspark.operators.relationships import records_as_json
from relspark.plans import app
from relspark.plans.knowledge import build_knowledge_base
from relspark.sources import tables as TB
from relspark.sources.schemas import KNOWLEDGE_BASE, OBJECTS, RESULTS_DATA, RESULTS_META
from relspark.sources.stored import drop_stored, folder_of_application, measured

NOW = dt.datetime(2024, 5, 1)


def pe(**more):
    return {
        "version_info": [
            {"key": "CompanyName", "value": "Acme"},
            {"key": "Signature", "value": 'Acme "Ltd"'},
            {"key": "OtherSignature", "value": "second"},
        ],
        **more,
    }


SANDBOX = {
    "behavior": [
        {"Data": {"arguments": {"url": "http://a.example"}}},
        {"calls": {"Data": {"arguments": {"url": "http://b.example/x,y"}}}},
        {"Data": {"arguments": {}}},
    ]
}

RESULTS = [
    ("o1", "peinfo", pe(pehash="p1", imphash="i1")),
    ("o2", "peinfo", pe(pehash="Undefined", imphash=3)),
    ("o3", "peinfo", {"pehash": None, "version_info": [{"key": "Signature", "value": "NONE"}]}),
    ("o4", "peinfo", {}),
    ("o1", "yara", {"yara": [{"rule": "A_b"}, {"rule": "yarax"}]}),
    ("o2", "yara", {"yara": []}),
    ("o1", "CUCKOO", SANDBOX),
    ("o2", "CUCKOO", {"behavior": []}),
    ("o5", "peinfo", pe(pehash="p1", imphash="i2")),
]


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [(o, s, gzip.compress(json.dumps(r).encode())) for o, s, r in RESULTS]
    data = spark.createDataFrame(rows, RESULTS_DATA)
    # o5 is in the data but not in the metadata; a repeated metadata row must not repeat results
    meta = spark.createDataFrame([(o, s) for o, s, _ in RESULTS[:-1]] * 2, RESULTS_META)
    return meta, data


def kb_rows(kb):
    return sorted((r.object_id, r.feature_type, r.feature_value) for r in kb.collect())


EXPECTED = sorted(
    [
        ("o1", "pehash", "p1"),
        ("o1", "imphash", "i1"),
        ("o1", "binary_signature", "Acme Ltd"),
        ("o2", "binary_signature", "Acme Ltd"),
        ("o1", "yara_rules", "ruleA_b,rulex"),
        ("o2", "yara_rules", ""),
        ("o1", "called_domains", "http://a.example,http://b.example/x,y"),
    ]
)


def test_knowledge_base(spark, inputs):
    kb = build_knowledge_base(*inputs, ts=F.lit(NOW))
    assert kb.columns == KNOWLEDGE_BASE.fieldNames()
    assert kb_rows(kb) == EXPECTED
    assert {r.ts for r in kb.collect()} == {NOW}


def test_knowledge_base_of_a_batch(spark, inputs):
    expected = [r for r in EXPECTED if r[0] == "o2"]
    assert kb_rows(build_knowledge_base(*inputs, batch=["o2"])) == expected
    batch = spark.createDataFrame([("o2",)], OBJECTS)
    assert kb_rows(build_knowledge_base(*inputs, batch=batch)) == expected
    nobody = spark.createDataFrame([], OBJECTS)
    assert kb_rows(build_knowledge_base(*inputs, batch=nobody)) == []


def test_empty_rule_lists_can_be_dropped(spark, inputs):
    kb = build_knowledge_base(*inputs, drop_empty=True)
    assert kb_rows(kb) == [r for r in EXPECTED if r[2] != ""]


def test_string_member_is_typed(spark):
    texts = ['{"h":"x"}', '{"h":3}', '{"h":null}', "{}", '{"h":"Undefined"}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = [r[0] for r in df.select(J.string_member(F.col("j"), "h")).collect()]
    assert got == ["x", None, None, None, None]


def test_json_find_all_keeps_document_order(spark):
    doc = {"z": {"k": 1}, "a": [{"k": "two"}, {"b": {"k": {"k": None}}}]}
    df = spark.createDataFrame([(json.dumps(doc),), (None,)], "j string")
    got = [r[0] for r in df.select(J.json_find_all(F.col("j"), "k")).collect()]
    assert got == [["1", "two", '{"k":null}', None], None]


def test_gzip_both_ways(spark):
    df = spark.createDataFrame([("héllo",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(gunzip_text(gzip_text("t"))).collect()]
    assert got == ["héllo", "", None]
    text = spark.createDataFrame([("o", "s", "{}")], "object_id string, service_name string, results string")
    assert decode_results(text).first().results == "{}"


def test_app_writes_and_reads_back(spark, inputs, tmp_path):
    meta, data = inputs
    objects = spark.createDataFrame([("o1",), ("o2",), ("o1",)], OBJECTS)
    kb_path, records_path = str(tmp_path / "kb"), str(tmp_path / "records")
    targets = objects.distinct()
    for day in (1, 2):
        stamp = F.lit(dt.datetime(2024, 6, day))
        _, edges, _ = app.run(objects, meta, data, targets, None, stamp, kb_path, records_path, 1)
    assert sorted((r.object_id, r.other_id, r.feature_type) for r in edges.collect()) == [
        ("o1", "o2", "binary_signature"),
        ("o2", "o1", "binary_signature"),
    ]
    kb = TB.read_table(spark, kb_path, KNOWLEDGE_BASE)
    assert kb.count() == 2 * len(EXPECTED)
    signatures = TB.kb_by_feature(kb, "binary_signature")
    assert signatures.count() == 4
    records = spark.read.parquet(records_path)
    current = TB.current_relationships(records).collect()
    assert len(current) == 2 and records.count() == 4
    assert {r.ts for r in current} == {dt.datetime(2024, 6, 2)}
    text = {r.object_id: r for r in records_as_json(TB.current_relationships(records)).collect()}
    assert text["o1"].binary_signature == '[{"sha256":"o2","weight":1.0}]'
    assert text["o2"].pehash is None and text["o2"].yara_rules == "[]"


def test_app_takes_a_batch(spark, inputs):
    meta, data = inputs
    objects = spark.createDataFrame([("o2",), ("o1",), ("o4",)], OBJECTS)
    targets = spark.createDataFrame([("o1",)], OBJECTS)
    kb, edges, records = app.run(objects, meta, data, targets, batch_size=2)
    assert {r.object_id for r in kb.collect()} == {"o1", "o2"}
    assert {r.object_id for r in records.collect()} == {"o1"}


def test_sources(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Mov\npush\nret\n")
    assert sorted(r.term for r in TB.read_words(spark, str(tmp_path / "words.txt"), lower=True).collect()) == [
        "mov",
        "push",
        "ret",
    ]
    ordered = TB.read_ordered_words(spark, str(tmp_path / "words.txt")).collect()
    assert [(r.term, r.idx) for r in ordered] == [("Mov", 0), ("push", 1), ("ret", 2)]
    ids = TB.local_rows(spark, [("a",), ("b",)], OBJECTS)
    path = str(tmp_path / "ids")
    TB.write_new(ids, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        TB.write_new(ids, path)
    assert TB.read_partitioned(spark, path, object_id="b").count() == 1
    lines = str(tmp_path / "lines")
    TB.write_lines(ids, F.format_string("Id: %s", "object_id"), lines)
    assert sorted(r.value for r in spark.read.text(lines).collect()) == ["Id: a", "Id: b"]


def test_feature_type_is_pruned_at_the_scan(spark, inputs, tmp_path, capsys):
    path = str(tmp_path / "kb")
    TB.append_knowledge_base(build_knowledge_base(*inputs, ts=F.lit(NOW)), path)
    TB.kb_by_feature(TB.read_table(spark, path, KNOWLEDGE_BASE), "pehash").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "feature_type" in plan.split("PartitionFilters")[1][:120]


def test_bad_results_give_null_and_are_counted(spark):
    good, deep = '{"opcodes": ["mov"]}', "[" * 5000 + "]" * 5000
    packed = gzip.compress(good.encode())
    rows = [
        ("a", "objdump", packed),
        ("b", "objdump", packed[:-9]),
        ("c", "objdump", b"no gzip"),
        ("d", "objdump", gzip.compress(b"\xff\xfe")),
        ("e", "objdump", gzip.compress(good[:-4].encode())),
        ("f", "objdump", gzip.compress(deep.encode())),
        ("g", "objdump", None),
    ]
    data = spark.createDataFrame(rows, "object_id string, service_name string, results binary")
    text = decode_results(data)
    found = {r.object_id: r.o for r in text.select("object_id", J.opcode_lists(F.col("results")).alias("o")).collect()}
    assert found.pop("a") == [["mov"]]
    assert found.pop("f") in (None, [])  # as deep as the parser goes
    assert set(found.values()) == {None}
    counts = unreadable(data).first()
    assert (counts.n_results, counts.n_undecodable) == (6, 3) and counts.n_unparsable in (1, 2)


def test_texts_of_a_batch_are_handed_on_as_they_come(spark):
    """All texts of a batch of blobs were held at once, many times the size of the batch."""
    pa = pytest.importorskip("pyarrow")
    from relspark.functions.gzip_text import SLICE_BYTES, unpacked_texts

    texts = [str(i) * 200_000 if i % 5 else None for i in range(60)]
    blobs = [None if x is None else gzip.compress(x.encode()) for x in texts]
    longest = max(len(x) for x in texts if x)
    batches = [pa.array(blobs[:50], pa.binary()), pa.array([], pa.binary()), pa.array(blobs[50:], pa.binary())]
    parts = list(unpacked_texts(iter(batches)))
    assert [x for part in parts for x in part.to_pylist()] == texts
    assert len(parts) > 10 and max(part.nbytes for part in parts) <= SLICE_BYTES + longest + 1000
    rows = [(str(i), "s", blob) for i, blob in enumerate(blobs)]
    data = spark.createDataFrame(rows, "object_id string, service_name string, results binary").coalesce(1)
    assert {int(r.object_id): r.results for r in decode_results(data).collect()} == dict(enumerate(texts))


def test_search_keeps_document_order(spark):
    text = '{"a": {"x": 1, "b": [{"x": 2}, {"c": {"x": 3}}]}, "x": {"x": 4}, "d": [[{"x": 5}]]}'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(J.json_find_all(F.col("t"), "x")).first()[0] == ["1", "2", "3", '{"x":4}', "4", "5"]


def test_stored_tables_can_be_dropped(spark, tmp_path):
    folder = folder_of_application(spark)
    table = measured(spark.range(5).selectExpr("id", "array(1.0, 2.0) AS a", "'xyz' AS t", "named_struct('s', 'q') AS s"))
    assert table.rows == 5 and table.size >= 5 * (8 + 16 + 3)
    path = folder.removeprefix("file:")
    assert os.listdir(path)
    drop_stored(spark)
    assert not os.path.exists(path)


def test_members_are_found_at_any_depth(spark):
    flat = {"version_info": [{"key": "A", "value": "x"}, {"key": "Signature", "value": 'my "s"'}]}
    deep = {"version_info": {"StringFileInfo": [{"inner": flat["version_info"]}]}}
    mixed = {"version_info": [{"key": "A", "value": "x"}, {"inner": {"key": "Signature", "value": "deep"}}], "other": {"key": "Signature", "value": "no"}}
    elsewhere = {"other": {"key": "Signature", "value": "no"}, "version_info": [{"key": "A", "value": "x"}]}
    rows = [(i, json.dumps(r)) for i, r in enumerate((flat, deep, mixed, elsewhere, {}))] + [(5, None), (6, "{")]
    df = spark.createDataFrame(rows, "i int, t string")
    info = J.parse_peinfo(F.col("t"), "version_info")["version_info"]
    found = {r.i: r.s for r in df.select("i", J.first_signature(F.col("t"), info).alias("s")).collect()}
    assert found == {0: "my s", 1: "my s", 2: "deep", 3: None, 4: None, 5: None, 6: None}
    scans = [
        {"scans": {"a": {"result": "x"}, "b": {"result": None}}},
        {"scans": {"a": {"detail": {"result": "y"}}, "b": [{"result": "z"}]}, "result": "no"},
        {"scans": {}, "result": "no"},
        {"result": "no"},
    ]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(scans)], "i int, t string")
    found = {r.i: r.n for r in df.select("i", J.detection_names(F.col("t")).alias("n")).collect()}
    assert [found[i] or [] for i in range(4)] == [["x"], ["y", "z"], [], []]
