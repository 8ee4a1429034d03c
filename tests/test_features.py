import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions import vectors as V
from relspark.operators import joins
from relspark.operators.ranking import with_index
from relspark.operators.vocabulary import encode_flags, encode_sequences, vocabulary
from relspark.plans import classify, perceptron
from relspark.plans import features as P

DATA = "object_id string, service_name string, results string"


def inputs(spark, service, results):
    rows = [(o, service, r if isinstance(r, str) else json.dumps(r)) for o, r in results]
    data = spark.createDataFrame(rows, DATA)
    return data.select("object_id", "service_name").distinct(), data


def by_id(df):
    return {r.object_id: list(r.features) for r in df.collect()}


def section(name, entropy, address="0x1000", virt_size=2, size=3):
    return {
        "section_name": name,
        "entropy": entropy,
        "virt_address": address,
        "virt_size": virt_size,
        "size": size,
    }


PE = [
    (
        "full",
        {
            "timestamp": {"timestamp": 1500000000},
            "pe_sections": [
                section(".text\0\0\0", 1.5),
                section(".rdata\0\0", 4.0, "0xFFFFFFFF"),
                section(".text\0\0\0", 6.5, "0x10", 7, 8),
                section(".other\0\0", 9.0),
            ],
            "imports": [{"dll": "K", "function": "f"}, {"dll": "K", "function": "g"}],
        },
    ),
    ("no_imports", {"pe_sections": [section(".data", 2.0)]}),
    ("no_sections", {"imports": [{"dll": "K", "function": "f"}]}),
    ("other", {"pe_sections": [], "imports": [{"dll": "K", "function": "f"}]}),
]


def test_pe_numbers(spark):
    results = P.pe_results(*inputs(spark, "peinfo", PE))
    rows = {r.object_id: r.numbers for r in results.collect()}
    assert rows["full"] == [6.5, 16.0, 7.0, 8.0] + [0.0] * 8 + [4.0, 4294967295.0, 2.0, 3.0, 1500000000.0]
    assert rows["no_imports"] == [0.0] * 4 + [2.0, 4096.0, 2.0, 3.0] + [0.0] * 9
    assert rows["no_sections"] is None
    assert rows["other"] == [0.0] * 17


def test_pe_vectors_and_scaling(spark):
    meta, data = inputs(spark, "peinfo", PE)
    results = P.pe_results(meta, data)
    vocab = P.import_vocabulary(results, 0)
    assert [(r.term, r.idx, r["count"]) for r in vocab.orderBy("idx").collect()] == [
        ("K.f", 0, 3),
        ("K.g", 1, 1),
    ]
    vectors = by_id(P.pe_vectors(results, vocab))
    assert set(vectors) == {"full", "no_imports", "other"}
    assert vectors["full"][17:] == [1.0, 1.0]
    assert vectors["no_imports"][17:] == [0.0, 0.0]
    assert vectors["other"][17:] == [1.0, 0.0]
    scaled = by_id(P.pe_features(meta, data, min_count=0))
    assert scaled["full"][0] == 1.0 and scaled["other"][0] == 0.0
    assert scaled["full"][8] == 0.5, "a constant position is scaled to 0.5"


def test_several_results_of_one_object(spark):
    one = {"pe_sections": [section(".text", 1.0)], "imports": [{"dll": "K", "function": "f"}]}
    two = {"pe_sections": [section(".text", 2.0)], "imports": []}
    meta, data = inputs(spark, "peinfo", [("o", one), ("o", two), ("o", one)])
    results = P.pe_results(meta, data)
    vocab = P.import_vocabulary(results, 0)
    assert vocab.collect()[0]["count"] == 1, "a repeated result counts once"
    apart = sorted((r.features[0], r.features[17]) for r in P.pe_vectors(results, vocab).collect())
    assert apart == [(1.0, 1.0), (2.0, 0.0)]
    crossed = P.pe_vectors(results, vocab, cross_results=True).collect()
    assert sorted((r.features[0], r.features[17]) for r in crossed) == [
        (1.0, 0.0),
        (1.0, 1.0),
        (2.0, 0.0),
        (2.0, 1.0),
    ]


SCANS = [
    (
        "a",
        {
            "scans": {
                "V1": {"result": "Trojan.Win32/Zbot!gen@mm"},
                "V2": {"result": None},
                "V3": {"result": "Zbot [Crypt]"},
            }
        },
    ),
    ("b", {"scans": {"V1": {"result": "Conficker"}}}),
    ("c", {"scans": {}}),
]


def test_keywords(spark):
    meta, data = inputs(spark, "virustotal", SCANS)
    tokens = {r.object_id: sorted(r.tokens) for r in P.detection_results(meta, data).collect()}
    assert tokens == {"a": ["trojan", "zbot", "zbot"], "b": ["conficker"], "c": []}
    stop = spark.createDataFrame([("trojan",)], "term string")
    vocab, matrix = P.keyword_features(meta, data, stop, min_count=0)
    assert [(r.term, r.idx) for r in vocab.orderBy("idx").collect()] == [("zbot", 0), ("conficker", 1)]
    assert by_id(matrix) == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.0, 0.0]}


def test_threshold_is_strict_and_order_is_fixed(spark):
    terms = spark.createDataFrame([(t,) for t in "aabbbccc"], "term string")
    assert [(r.term, r.idx) for r in vocabulary(terms, 2).orderBy("idx").collect()] == [("b", 0), ("c", 1)]
    assert vocabulary(terms, 3).count() == 0


def test_flags_with_an_empty_vocabulary(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", [])], "object_id string, tokens array<string>")
    none = spark.createDataFrame([], "term string, idx int, count long")
    assert by_id(encode_flags(rows, ["object_id"], "tokens", none)) == {"a": [], "b": []}


@pytest.mark.parametrize("small_bound", [False, True])
def test_encodings_by_join(spark, monkeypatch, small_bound):
    if small_bound:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        defaults = joins.salted_join.__defaults__
        monkeypatch.setattr(joins.salted_join, "__defaults__", (*defaults[:-1], 2))
    rows = [("a", ["x", "y", "x", "?"]), ("b", []), ("c", None), ("d", ["x"] * 9)]
    df = spark.createDataFrame(rows, "object_id string, tokens array<string>")
    vocab = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "term string, idx int")
    flags = by_id(encode_flags(df, ["object_id"], "tokens", vocab))
    assert flags == {"a": [1, 1, 0], "b": [0, 0, 0], "c": [0, 0, 0], "d": [1, 0, 0]}
    coded = {r.object_id: r.codes for r in encode_sequences(df, ["object_id"], "tokens", vocab).collect()}
    assert coded == {"a": [1, 2, 1, 0], "b": [], "c": [], "d": [1] * 9}


def test_index_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_index(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def check_index(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("count"), F.col("id").cast("string").alias("term"))
    got = with_index(df, [F.desc("count"), F.asc("term")]).collect()
    expected = sorted(got, key=lambda r: (-r["count"], r.term))
    assert [r.idx for r in expected] == list(range(5000))


DISASSEMBLY = [
    ("a", {"sections": [{"opcodes": ["mov", "push", "zzz"]}, {"opcodes": None}, {"opcodes": ["ret"]}]}),
    ("b", {"sections": [{"opcodes": None}, {"deeper": {"opcodes": ["ret"]}}]}),
    ("c", {"sections": [{"opcodes": None}]}),
    ("d", {"sections": []}),
    ("e", {"opcodes": ["mov"] * 9}),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_opcodes(spark, as_table):
    meta, data = inputs(spark, "objdump", DISASSEMBLY)
    vocab = ["mov", "push", "ret"]
    if as_table:
        vocab = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "term string, idx int")
    assert by_id(P.opcode_features(meta, data, vocab, length=6)) == {
        "a": [1, 2, 0, 3, 0, 0],
        "b": [3, 0, 0, 0, 0, 0],
        "c": [0] * 6,
        "e": [1] * 9,
    }
    whole = by_id(P.opcode_features(meta, data, vocab, length=None))
    assert len(whole["e"]) == 9 and whole["c"] == []


def test_opcodes_are_found_once_and_in_slices(spark, monkeypatch):
    """A filter below the Python step made Spark take it twice, in two processes of each task."""
    rows = [(f"o{i}", {"opcodes": ["mov", "zzz", "ret"] * (i * 40)} if i % 3 else {}) for i in range(200)]
    meta, data = inputs(spark, "objdump", rows)
    plans, store = [], P.stored

    def stored(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(P, "stored", stored)
    got = by_id(P.opcode_features(meta.coalesce(1), data.coalesce(1), ["mov", "ret"], length=None))
    assert got == {k: [1, 0, 2] * (i * 40) for i, (k, _) in enumerate(rows) if i % 3}
    assert [plan.count("ArrowEvalPython") for plan in plans] == [1]


def test_opcode_list():
    assert len(V.X86_OPCODES) == V.CLASSIFIER_CODES - 1
    assert len(set(V.X86_OPCODES)) == len(V.X86_OPCODES)


def test_small_arrays(spark):
    df = spark.createDataFrame([(3,)], "n int").select(
        V.one_hot(F.col("n"), 5).alias("hot"),
        V.multi_hot(F.array(F.lit(0), F.lit(3)), 5).alias("multi"),
        V.position_one_hot(F.array(F.lit(2.0), F.lit(0.0)), 10).alias("slots"),
        V.code_counts(F.array(F.lit(2.0), F.lit(0.0), F.lit(2.0)), 4).alias("counts"),
        V.hex_to_double(F.lit("0xff")).alias("hex"),
        V.zeros(2).alias("zeros"),
    )
    row = df.select("*", V.arg_max(F.col("hot")).alias("back")).first()
    assert row.hot == [0, 0, 0, 1, 0] and row.back == 3
    assert row.multi == [1, 0, 0, 1, 0]
    assert row.slots == [2, 10] and row["counts"] == [1, 0, 2, 0]
    assert row.hex == 255.0 and row.zeros == [0.0, 0.0]


def test_code_counts_of_odd_rows(spark):
    """A NULL sequence has NULLs; NULL, unknown and broken codes count nowhere."""
    rows = [(0, None), (1, []), (2, [1.0, None, 3.0, 2.5, -1.0, float("nan"), 1.0]), (3, [0.0] * 200_000 + [2.0]), (4, [2.0])]
    df = spark.createDataFrame(rows, "id int, codes array<double>").coalesce(1)
    got = {r.id: r.found for r in df.select("id", V.code_counts(F.col("codes"), 3).alias("found")).collect()}
    assert got == {0: [None] * 3, 1: [0, 0, 0], 2: [0, 2, 0], 3: [200_000, 0, 1], 4: [0, 0, 1]}


def test_training_set(spark):
    make = lambda rows, name: spark.createDataFrame(rows, f"object_id string, {name} array<double>")
    labels = make([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label")
    first = make([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "features")
    second = make([("a", [5.0, 6.0, 7.0])], "features")
    rows = P.training_set(labels, first, second).collect()
    assert [(r.object_id, r.label, r.features) for r in rows] == [("a", [1, 0], [1, 5, 6, 7])]
    whole = P.training_set(labels, first, second, last_length=2).first().features
    padded = P.training_set(labels, first, second, last_length=4).first().features
    assert whole == [1, 5, 6, 7] and padded == [1, 5, 6, 7, 0]


def test_long_sequences_stay_whole(spark):
    text = json.dumps({"sections": [{"opcodes": ["mov", "push"] * 6000}]})
    rows = [("o", "objdump", text), ("p", "objdump", '{"opcodes": ["ret"]}')]
    data = spark.createDataFrame(rows, "object_id string, service_name string, results string")
    coded = P.opcode_features(data.select("object_id", "service_name"), data)
    sizes = {r.object_id: len(r.features) for r in coded.collect()}
    assert sizes == {"o": 12_000, "p": V.SEQUENCE_LENGTH}
    labels = spark.createDataFrame([("o", [1.0]), ("p", [0.0])], "object_id string, label array<double>")
    first = spark.createDataFrame([("o", [9.0]), ("p", [8.0])], "object_id string, features array<double>")
    raw = P.opcode_features(data.select("object_id", "service_name"), data, length=None)
    rows = P.training_set(labels, first, raw, last_length=10).collect()
    assert {len(r.features) for r in rows} == {12_001}
    mov, push = (V.X86_OPCODES.index(x) + 1 for x in ("mov", "push"))
    counts = next(r for r in raw.select("object_id", V.code_counts(F.col("features")).alias("c")).collect() if r.object_id == "o").c
    assert counts[mov] == counts[push] == 6000 and sum(counts) == 12_000


def test_cluster_labels(spark):
    rows = [(f"o{i}", [float(i % 3), float(i % 3 == 1)]) for i in range(30)]
    matrix = spark.createDataFrame(rows, "object_id string, features array<double>")
    labels = P.cluster_labels(matrix, k=3).collect()
    assert len({r.object_id for r in labels}) == 30
    assert all(sum(r.label) == 1.0 and len(r.label) == 3 for r in labels)
    groups = {}
    for r in labels:
        groups.setdefault(int(r.object_id[1:]) % 3, set()).add(tuple(r.label))
    assert all(len(g) == 1 for g in groups.values()), "equal rows share a cluster"


def test_classifier(spark, tmp_path):
    rows = [(f"o{i}", [float(i % 2 == 0), float(i % 2)], [float(i % 2), 1.0]) for i in range(40)]
    data = spark.createDataFrame(rows, "object_id string, label array<double>, features array<double>")
    model = classify.train(data, width=2, classes=2, hidden=(4,))
    evaluated = classify.evaluate(model, data)
    assert classify.accuracy(evaluated).first().accuracy == 1.0
    path = str(tmp_path / "model")
    classify.save(model, path)
    again = classify.predict(classify.load(path), data)
    assert sorted(again.collect()) == sorted(classify.predict(model, data).collect())
    line = evaluated.where("object_id = 'o1'").select(classify.evaluation_line()).first()[0]
    assert line == "Label: 1, Prediction: 1"
    line = again.where("object_id = 'o2'").select(classify.prediction_line()).first()[0]
    assert line == "Sha256: o2, Prediction: 0"
    features = spark.createDataFrame([([9.0, 2.0, 2.0],)], "f array<double>")
    joined = features.select(classify.classifier_input(F.col("f"), 1)).first()[0]
    assert len(joined) == 1 + V.CLASSIFIER_CODES and joined[0] == 9.0 and joined[3] == 2.0


def test_classifier_of_vectors_makes_no_dense_rows(spark, monkeypatch, tmp_path):
    """Spark's perceptron kept all rows dense; its model, as loaded, still gives the predictions of the sparse form."""
    given = []
    fit = classify.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(classify.MultilayerPerceptronClassifier, "fit", lambda self, rows: (given.append(rows.count()), fit(self, rows))[1])
    rows = [(f"o{i}", [float(i % 2 == 0), float(i % 2)], [i % 2 + 1, 5 + i, 900], [3.0, 1.0, 7.0]) for i in range(40)]
    arrays = [(o, y, [dict(zip(places, values)).get(p, 0.0) for p in range(901)]) for o, y, places, values in rows]
    vectors = spark.createDataFrame([(o, y, Vectors.sparse(901, p, x) if i % 3 else Vectors.dense(arrays[i][2])) for i, (o, y, p, x) in enumerate(rows)], ["object_id", "label", "features"])
    model = classify.train(vectors, width=901, classes=2, hidden=(4,))
    assert given == [1]
    assert classify.accuracy(classify.evaluate(model, vectors)).first().accuracy == 1.0
    classify.save(model, path := str(tmp_path / "model"))
    dense = spark.createDataFrame(arrays, "object_id string, label array<double>, features array<double>")
    assert sorted(classify.predict(classify.load(path), dense).collect()) == sorted(classify.predict(model, vectors).collect())


@pytest.mark.parametrize("label, features", [([None, None], [1.0, 2.0]), ([0.0, 0.0, 1.0], [1.0, 2.0]), ([0.0, 1.0], [float("nan"), 2.0]), ([0.0, 1.0], None)])
def test_classifier_refuses_broken_vectors(spark, label, features):
    rows = [(f"o{i}", [1.0, 0.0], Vectors.dense([float(i), 1.0])) for i in range(4)] + [("odd", label, features and Vectors.dense(features))]
    schema = T.StructType().add("object_id", "string").add("label", T.ArrayType(T.DoubleType())).add("features", VectorUDT())
    data = spark.createDataFrame(rows, schema)
    with pytest.raises(Exception, match="MUST NOT be" if features else None):  # the scaler, which is Spark's, refuses the last
        classify.train(data, width=2, classes=2, hidden=(2,), max_iter=2)


@pytest.mark.parametrize("most", [perceptron.DRIVER_BYTES, 0])
def test_gradient_of_sparse_rows(spark, monkeypatch, most):
    """That of the loss of the scaled dense rows, whole or added up in pieces, over blocks of some entries."""
    monkeypatch.setattr(perceptron, "PIECE_BYTES", 64)
    random = np.random.default_rng(3)
    rows, classes = random.integers(0, 3, (30, 6)) * random.normal(size=(30, 6)), random.integers(0, 3, 30)
    rows[:, 4] = 2.0
    vectors = [(float(c), Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(x) if v])) for c, x in zip(classes, rows)]
    blocks = perceptron.packed(spark.createDataFrame(vectors, ["class", "vector"]))
    layers = [6, 5, 4, 3]
    weights, (factor, offset) = perceptron.first_weights(layers, 1), perceptron.scaling(rows.min(axis=0), rows.max(axis=0))

    def loss(weights):
        x = rows * factor + offset
        assert x.min() == 0 and abs(x.max() - 1) < 1e-12 and (x[:, 4] == 0.5).all()
        net = perceptron.split(weights, layers)
        for w, b in net[:-1]:
            x = 1 / (1 + np.exp(-(x @ w + b)))
        z = np.exp(x @ net[-1][0] + net[-1][1])
        return -np.log(z[np.arange(30), classes] / z.sum(axis=1)).mean()

    net = perceptron.over_raw(perceptron.split(weights, layers), factor, offset)
    got, slope = perceptron.gradient(blocks, 2, net, layers, most)
    first, bias = perceptron.split(slope := slope.copy(), layers)[0]
    first[:] = first * factor[:, None] + offset[:, None] * bias
    assert got == pytest.approx(loss(weights))
    steps = np.eye(len(weights)) * 1e-6
    assert slope == pytest.approx([(loss(weights + s) - loss(weights - s)) / 2e-6 for s in steps], abs=1e-7)


def test_blocks_of_sparse_rows(monkeypatch):
    """Rows and entries of a block are bounded, but for a row of more entries; none is lost."""
    monkeypatch.setattr(perceptron, "ROWS", 3)
    monkeypatch.setattr(perceptron, "ENTRIES", 4)
    lengths = np.array([0, 9, 2, 2, 1, 0, 0, 0, 0], np.int32)
    rows = perceptron.Rows(lengths, np.arange(14, dtype=np.int32), np.arange(14.0))
    blocks = list(rows.blocks())
    assert [(a, b) for a, b, _ in blocks] == [(0, 1), (1, 2), (2, 4), (4, 7), (7, 9)]
    assert [x for _, _, b in blocks for x in b.places] == list(range(14))
    assert [x for _, _, b in blocks for x in b.lengths] == list(lengths)


def spread_section(name, entropy, address, virt_size, size):
    """The members of a section in three places."""
    return {"header": {"section_name": name, "virt_address": address}, "stats": [{"entropy": entropy}, {"virt_size": virt_size, "size": size}]}


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: [{"entries": x}], lambda x: {"table": {"rows": x}}])
def test_sections_and_timestamp_at_any_depth(spark, wrap):
    """Members are paired by order, as in the flat form of the same sections."""
    given = [(".text\0\0\0", 1.5, "0x10", 2, 3), (".other", 7.0, "0x1", 1, 1), (".data\0\0\0", 2.5, "0xFF", 4, 5)]
    flat = {"pe_sections": [section(*x) for x in given], "timestamp": {"timestamp": 9}}
    deep = {"pe_sections": wrap([spread_section(*x) for x in given]), "timestamp": {"head": [{"timestamp": 9}]}}
    partly = {"pe_sections": wrap([section(*given[0]), {"more": [section(*x) for x in given[1:]]}]), "timestamp": {"timestamp": 9}}
    short = {"pe_sections": wrap([{"header": {"section_name": ".text"}}]), "timestamp": {}}
    bad = {"pe_sections": wrap([{"header": {"section_name": ".text", "entropy": "high", "size": None, "virt_size": True}}])}
    rows = [(name, P.PEINFO, json.dumps(x)) for name, x in (("flat", flat), ("deep", deep), ("partly", partly), ("short", short), ("bad", bad))]
    data = spark.createDataFrame(rows, "object_id string, service_name string, results string")
    meta = data.select("object_id", "service_name")
    got = {r.object_id: r.numbers for r in P.pe_results(meta, data).collect()}
    assert got["flat"][:8] == [1.5, 16.0, 2.0, 3.0, 2.5, 255.0, 4.0, 5.0] and got["flat"][16] == 9.0
    assert got["deep"] == got["partly"] == got["flat"]
    assert got["short"] == got["bad"] == [0.0] * 17


def test_terms_are_joined_once_per_row_and_keep_their_places(spark):
    rows = spark.createDataFrame(
        [(1, ["b", "a", "b", "zz", None, "b"]), (2, []), (3, None), (4, ["a"] * 3000 + ["b"]), (5, [""])], "id int, terms array<string>"
    )
    vocab = spark.createDataFrame([("a", 0), ("b", 4)], "term string, idx int")
    found = {r.id: r.terms for r in rows.select("id", V.term_positions(F.col("terms")).alias("terms")).collect()}
    assert sorted((t.term, t.positions) for t in found[1]) == [("", [4]), ("a", [1]), ("b", [0, 2, 5]), ("zz", [3])]
    assert len(found[4]) == 2 and found[2] == found[3] == []
    got = {r.id: r.codes for r in encode_sequences(rows, ["id"], "terms", vocab).collect()}
    assert got == {1: [5, 1, 5, 0, 0, 5], 2: [], 3: [], 4: [1.0] * 3000 + [5.0], 5: [0.0]}


def test_sparse_pe_features_take_room_by_their_own_entries(spark):
    """Flags of all rows and of none are the same everywhere and stand in no row; the entries are those of the arrays."""
    function = lambda name: {"dll": "K", "function": name}
    rows = [
        (f"o{i}", {"pe_sections": [section(".text", float(i))], "imports": [function("all"), function(f"f{i}")]})
        for i in range(40)
    ]
    rows.append(("bare", {"imports": [function("nowhere"), function("f1")]}))
    meta, data = inputs(spark, "peinfo", rows)
    sparse = P.sparse_pe_features(meta, data, min_count=0)
    assert sparse.width == 17 + 42 and sparse.rows.count() == 40
    assert sparse.rows.select(F.max(F.size("indices"))).first()[0] == 18
    positions = [r.pos for r in sparse.same.collect()]
    assert len(positions) == 2, "the flag of all rows, and the one of the row without numbers"
    full = by_id(sparse.arrays())
    assert all(len(f) == 59 and [f[p] for p in positions] == [0.5, 0.5] for f in full.values())
    entries = {(r.object_id, r.pos): r.value for r in sparse.entries("object_id").collect() if r.value}
    assert entries == {(o, p): x for o, f in full.items() for p, x in enumerate(f) if x}
    assert by_id(P.pe_features(meta, data, min_count=0)) == full


def test_shared_entries_take_few_bytes(spark, tmp_path, monkeypatch):
    """Row after row, each of so many positions in turn, they took more than a byte each."""
    monkeypatch.setattr(P, "ENTRIES_PER_TASK", 1 << 20)
    rows = spark.range(0, 800, 1, 2).select(
        F.format_string("doc-%d", F.col("id") % 790).alias("object_id"), F.when(F.col("id") > 5, F.col("id") % 2).alias("label"),
        F.array(F.lit(0)).alias("indices"), F.array(F.lit(0.25)).alias("values"),
    )
    same = spark.range(1, 2504, 1, 1).select((F.col("id") * 3).cast("int").alias("pos"))
    entries = P.SparseFeatures(rows, same, 8000).entries("object_id", "label")
    entries.write.parquet(path := str(tmp_path / "entries"))
    size = sum(f.stat().st_size for f in (tmp_path / "entries").glob("*.parquet"))
    assert size < 0.25 * 800 * 2503
    found = spark.read.parquet(path)
    once = rows.select("object_id", "label")
    expected = once.crossJoin(same).withColumn("value", F.lit(P.SAME)).union(once.select("*", F.lit(0), F.lit(0.25)))
    sums = [d.groupBy(*d.columns).count().agg(F.count("*"), F.sum("count"), F.sum(F.xxhash64("object_id", "label", "pos", "value", "count") % 1_000_003)).first() for d in (found, expected)]
    assert sums[0] == sums[1]


def test_sparse_training_set_is_that_of_arrays(spark):
    labels = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [1.0, 0.0])], "object_id string, label array<double>")
    rows = spark.createDataFrame([("a", [0, 2], [3.0, 1.0]), ("b", [], []), ("c", [1], [1.0])], "object_id string, indices array<int>, values array<double>")
    first = P.SparseFeatures(rows, spark.createDataFrame([(3,)], "pos int"), 4)
    codes = spark.createDataFrame([("a", [0.0, 7.0, 9.0]), ("b", []), ("d", [1.0])], "object_id string, features array<double>")
    got = P.sparse_training_set(labels, first, codes, last_length=5)
    whole = P.training_set(labels, first.arrays(), codes, last_length=5)
    assert got.width == 9
    expected = {(r.object_id, *r.label, p, x) for r in whole.collect() for p, x in enumerate(r.features) if x}
    assert {(r.object_id, *r.label, r.pos, r.value) for r in got.entries("object_id", "label").collect() if r.value} == expected


def test_training_set_lists_shared_positions_in_runs(spark):
    """Labelled rows take turns at a position, so that files hold it once for them all."""
    rows = spark.range(0, 600, 1, 1).select(F.format_string("doc-%d", "id").alias("object_id"), F.array(F.lit(1)).alias("indices"), F.array(F.lit(0.5)).alias("values"))
    labels = rows.select("object_id", F.array(F.lit(1.0), F.lit(0.0)).alias("label")).where("object_id NOT LIKE '%3'")
    codes = rows.select("object_id", F.array(F.lit(0.0), F.lit(4.0)).alias("features"))
    first = P.SparseFeatures(rows, spark.createDataFrame([(p,) for p in range(2, 9)], "pos int"), 9)
    found = P.sparse_training_set(labels, first, codes, last_length=5)
    listed = [(r.object_id, r.pos, r.value) for r in found.shared_entries("object_id", "label").collect()]
    assert sorted(listed) == sorted((f"doc-{i}", p, 0.5) for i in range(600) if i % 10 != 3 for p in range(2, 9))
    runs = 1 + sum(a[1] != b[1] for a, b in zip(listed, listed[1:]))
    assert runs <= 7 * 20 and found.entries("object_id", "label").count() == 540 * 9


def test_distances_of_wide_flags_stand_in_no_plan(spark):
    """Centres as literals of the plan took the driver's memory by the width of the vocabulary."""

    class Model:
        def clusterCenters(self):
            return [[0.25] * 5000, [0.0] * 4999 + [1.0]]

    rows = spark.createDataFrame([("a", [0, 4999]), ("b", [])], "object_id string, indices array<int>")
    away = rows.select("object_id", P.flag_distances(F.col("indices"), Model()).alias("away"))
    assert len(away._jdf.queryExecution().logical().toString()) < 2000
    got = {r.object_id: r.away for r in away.collect()}
    assert got["a"] == pytest.approx([5000 / 16 + 2 * 0.5, 1.0]) and got["b"] == pytest.approx([5000 / 16, 1.0])
