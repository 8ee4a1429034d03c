"""Links as pairs and classes: nothing lost against the plain edges, and bounded where a value is held by many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from relspark.operators import classes as C
from relspark.operators import relationships as R
from relspark.sources.schemas import KNOWLEDGE_BASE
from relspark.sources.stored import stored

DAY = dt.datetime(2024, 1, 1)


def random_kb(seed, objects=60):
    """A value and a token held by a third of the objects, equal lists, histories, empty and null lists."""
    r, rows = random.Random(seed), []
    for i in range(objects):
        name = f"o{i:03d}"
        for day in range(r.randint(1, 2)):
            ts = DAY + dt.timedelta(days=day)
            rows.append((name, "pehash", "hot" if i % 3 == 0 else f"p{r.randrange(20)}", ts))
            rows.append((name, "imphash", r.choice(["a", "b", None, f"i{i}"]), ts))
            common = ["hot"] if i % 3 == 0 else []
            tokens = common + [f"t{r.randrange(25)}" for _ in range(r.randint(0, 4))]
            rows.append((name, "yara_rules", ",".join(tokens), ts))
            rows.append((name, "called_domains", r.choice(["x,y", "x,x,z", "q", None, f"d{r.randrange(9)}"]), ts))
    return rows


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "object_id string")


@pytest.mark.parametrize("most", [1, 6, 1000])
def test_no_link_is_lost(spark, most):
    kb = stored(spark.createDataFrame(random_kb(most), KNOWLEDGE_BASE).coalesce(2))
    targets = ids(spark, [f"o{i:03d}" for i in range(0, 60, 4)] + ["nobody"])
    linked = C.primary_links(kb, targets, most=most)
    plain = stored(R.primary_relationships(kb, targets))
    key = ["object_id", "other_id", "feature_type"]
    expected = {tuple(r) for r in plain.select(*key).distinct().collect()}
    assert {tuple(r) for r in C.expanded(linked).collect()} == expected
    # weights: of pairs and value classes by the feature, of lists as scored object by object
    lists = linked.members.where("kind = 'list'").select("class_id", F.col("member").alias("other_id"))
    scored = linked.links.where("class_id IS NOT NULL AND weight IS NOT NULL").drop("other_id").join(lists, "class_id")
    scored = scored.select(*key, F.round("weight", 9)).where("object_id <> other_id")
    edges = {tuple(r) for r in plain.select(*key, F.round("weight", 9)).collect()}
    assert {tuple(r) for r in scored.collect()} <= edges
    if most == 1000:
        pairs = linked.links.where("other_id IS NOT NULL").select(*key, F.round("weight", 9))
        assert {tuple(r) for r in scored.unionByName(pairs.toDF(*scored.columns)).collect()} == edges


def test_counts_of_links(spark):
    rows = [(f"o{i}", "pehash", "hot", DAY) for i in range(20)] + [(f"o{i}", "yara_rules", "a,b", DAY) for i in range(20)]
    rows += [("p", "yara_rules", "b,c", DAY), ("p", "pehash", "cold", DAY), ("q", "pehash", "cold", DAY)]
    kb = stored(spark.createDataFrame(rows, KNOWLEDGE_BASE))
    links = C.primary_links(kb, ids(spark, ["o1", "p"]), most=5).links.collect()
    found = {(r.object_id, r.other_id, r.feature_type, r.weight and round(r.weight, 6), r.n_links) for r in links}
    assert found == {
        ("o1", None, "pehash", 0.5, 19),
        ("p", "q", "pehash", 0.5, 1),
        ("o1", None, "yara_rules", 1.0, 19),  # its own list
        ("o1", None, "yara_rules", 0.333333, 1),
        ("p", None, "yara_rules", 0.333333, 20),
    }


def test_rows_do_not_grow_with_the_square(spark):
    sizes = []
    for n in (400, 1600):
        kb = spark.range(n).select(
            F.concat(F.lit("o"), "id").alias("object_id"),
            F.explode(F.array(F.lit("pehash"), F.lit("yara_rules"))).alias("feature_type"),
            F.col("id"),
        )
        value = F.when(F.col("feature_type") == "pehash", "same").otherwise(F.concat(F.lit("hot,r"), F.col("id") % 200))
        kb = stored(kb.select("object_id", "feature_type", value.alias("feature_value"), F.lit(DAY).cast("timestamp_ntz").alias("ts")))
        targets = kb.select("object_id").where("cast(substr(object_id, 2) as int) % 50 = 0").distinct()
        linked = C.primary_links(kb, targets, most=10)
        sizes.append((linked.links.count(), linked.members.count()))
    assert sizes[1][0] <= 4 * sizes[0][0] and sizes[1][1] <= 4 * sizes[0][1]
    assert sizes[1][0] <= 3 * 32  # a value, a token and its own list, for each of 32


def test_empty(spark):
    kb = spark.createDataFrame([], KNOWLEDGE_BASE)
    linked = C.primary_links(kb, ids(spark, ["a"]))
    assert linked.links.count() == 0 and linked.members.count() == 0
    assert linked.links.columns == C.LINK_COLUMNS


@pytest.mark.parametrize("most", [7, 40, 10_000])
def test_cells_of_records_are_bounded(spark, most):
    """One value held by a third of 900 objects."""
    kb = spark.range(900).select(
        F.concat(F.lit("o"), "id").alias("object_id"),
        F.lit("pehash").alias("feature_type"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("feature_value"),
        F.lit(DAY).cast("timestamp_ntz").alias("ts"),
    )
    kb = stored(kb)
    targets = ids(spark, ["o0", "o3", "o1"])
    edges = stored(R.primary_relationships(kb, targets))
    parts = R.record_parts(edges, most)
    assert parts & (parts - 1) == 0
    records = R.relationship_records(kb, targets, edges, F.lit(DAY), most=most).collect()
    cells = [r.pehash for r in records if r.pehash]
    assert max(map(len, cells)) <= most
    for name in ("o0", "o3"):
        got = sorted(m.sha256 for r in records if r.object_id == name for m in r.pehash or [])
        assert got == sorted(f"o{i}" for i in range(0, 900, 3) if f"o{i}" != name)
    if parts > 1:
        half = edges.groupBy("object_id", R._part_of("other_id", parts // 2).alias("part")).count()
        assert half.agg(F.max("count")).first()[0] > most


@pytest.mark.parametrize("most", [1, 6])
def test_lists_that_meet_under_frequent_tokens_are_scored(spark, most):
    """With `score_all` no link of lists is without its weight, and no token is a class."""
    kb = stored(spark.createDataFrame(random_kb(most), KNOWLEDGE_BASE).coalesce(2))
    targets = ids(spark, [f"o{i:03d}" for i in range(0, 60, 4)])
    linked = C.primary_links(kb, targets, most=most, score_all=True)
    assert linked.links.where("weight IS NULL").count() == 0
    assert linked.members.where("kind = 'token'").count() == 0
    lists = linked.members.where("kind = 'list'").select("class_id", F.col("member").alias("other_id"))
    key = ["object_id", "other_id", "feature_type"]
    scored = linked.links.drop("other_id").join(lists, "class_id").where("object_id <> other_id")
    edges = R.overlap_edges(kb, targets).select(*key, F.round("weight", 9))
    assert {tuple(r) for r in scored.select(*key, F.round("weight", 9)).collect()} == {tuple(r) for r in edges.collect()}


def plain_edges(spark, kb, targets):
    """{(object, other, feature, weight)} of all pairs, without classes."""
    edges = R.primary_relationships(kb, targets)
    return edges.select("object_id", "other_id", "feature_type", F.round("weight", 9).alias("weight")).distinct()


@pytest.mark.parametrize("most", [1, 6])
def test_links_name_the_members_of_their_classes(spark, most):
    """From the one table of links every pair follows, with its weight."""
    kb = stored(spark.createDataFrame(random_kb(most + 10), KNOWLEDGE_BASE).coalesce(2))
    targets = ids(spark, [f"o{i:03d}" for i in range(0, 60, 4)])
    found = stored(C.whole_links(C.primary_links(kb, targets, most=most, score_all=True)))
    members = found.where("object_id IS NULL").select("class_id", F.col("other_id").alias("member"))
    links = found.where("object_id IS NOT NULL")
    pairs = links.join(members, "class_id", "left").withColumn("other_id", F.coalesce("other_id", "member"))
    pairs = pairs.select("object_id", "other_id", "feature_type", F.round("weight", 9)).where("object_id <> other_id")
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in plain_edges(spark, kb, targets).collect()}
    assert members.count() == members.distinct().count()


@pytest.mark.parametrize("score_all", [True, False])
def test_records_say_who_is_in_the_classes(spark, score_all):
    kb = stored(spark.createDataFrame(random_kb(3), KNOWLEDGE_BASE).coalesce(2))
    names = [f"o{i:03d}" for i in range(0, 60, 4)]
    targets = ids(spark, names)
    edges = stored(C.whole_edges(C.primary_links(kb, targets, most=6, score_all=score_all)))
    met, columns = {}, {f.name: f.column for f in R.FEATURES}
    for r in R.relationship_records(kb, targets, edges, F.lit(DAY), most=7).collect():
        for name, column in columns.items():
            assert len(r[column] or []) <= 7
            met.setdefault((r.object_id, name), set()).update(m.sha256 for m in r[column] or [])

    def reached(one, name):
        """Objects of a cell; a class stands for those in its own record."""
        return {x for other in met.get((one, name), ()) for x in (reached(other, name) if other[0] != "o" else [other])}

    found = {(one, other, name) for one in names for name in columns for other in reached(one, name) - {one}}
    assert found == {tuple(r)[:3] for r in plain_edges(spark, kb, targets).collect()}


def test_views_of_classes_are_those_of_all_pairs(spark):
    """Counts and scores over links to classes equal those over the pairs written out."""
    rows = [r for r in random_kb(5) if r[3] == DAY]  # one value of each object and feature
    rows += [("a1", "pehash", "two", DAY), ("a2", "pehash", "two", DAY), ("a3", "pehash", "two", DAY)]
    kb = stored(spark.createDataFrame(rows, KNOWLEDGE_BASE).coalesce(2))
    targets = ids(spark, ["a1", *[f"o{i:03d}" for i in range(0, 60, 4)]])
    linked = C.primary_links(kb, targets, most=2, score_all=True)
    links, plain = stored(linked.links), stored(R.primary_relationships(kb, targets))
    edges, members = C.as_edges(links), C.linked_members(C.Linked(links, linked.members))

    def views(some, *members):
        total = R.total_weights(some).groupBy("object_id").agg(F.round(F.sum("weight"), 6))
        numbers = R.related_numbers(R.above(some, 0.4))
        bars = R.weight_histogram(some, 0.0, 1.0, 10, *members).select("segment", "n_edges", "n_objects")
        return [{tuple(r) for r in df.collect()} for df in (numbers, bars, total)]

    assert views(edges, members) == views(plain)
