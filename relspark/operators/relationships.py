"""Relationships between objects, from their knowledge base.

An edge (object_id, other_id, feature_type, weight, ts) says that some value in the history of
`other_id` matches the latest value of `object_id`. Edges are made for the targets asked for. What
holds for all objects at once is kept in linear form: `exact_groups`, `token_index`, `related_counts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions.gzip_text import gzip_text
from relspark.functions.text import split_tokens, token_counts
from relspark.operators.joins import semi_join, sized_join
from relspark.operators.latest import latest_values, newest_time
from relspark.sources.schemas import FEATURES, Feature
from relspark.sources.stored import Stored, measured

EDGE_COLUMNS = ["object_id", "other_id", "feature_type", "weight", "ts"]
#: Matches that one cell of a record holds at most.
RECORD_CELL = 10_000


def _names(features: Sequence[Feature]) -> list[str]:
    return [f.name for f in features]


def _by_feature(values: dict[str, object]) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*pairs)[F.col("feature_type")]


def exact_weight(features: Sequence[Feature]) -> Column:
    return _by_feature({f.name: f.weight for f in features})


def target_values(
    kb: DataFrame, targets: DataFrame, features: Sequence[Feature] = FEATURES
) -> Stored:
    """The latest value of each target per feature type, stored; the left side of every edge."""
    asked = kb.where(F.col("feature_type").isin(_names(features)))
    mine = semi_join(asked, targets, ["object_id"], ["feature_value", "ts"])
    return measured(latest_values(mine).drop("ts"))


def exact_edges(
    kb: DataFrame, targets: DataFrame | Stored, features: Sequence[Feature] = FEATURES
) -> DataFrame:
    """Edges to all objects that ever had the target's latest value; one edge each, newest time.

    `targets` has object ids, or is the result of `target_values`. The knowledge base is first cut
    down to the values asked for, then to one row per object and value, and only then joined to the
    targets.
    """
    exact = [f for f in features if f.exact]
    key = ["feature_type", "feature_value"]
    wanted = targets if isinstance(targets, Stored) else target_values(kb, targets, exact)
    history = kb.where(F.col("feature_type").isin(_names(exact)))
    held = newest_time(semi_join(history, wanted, key, ["object_id"]), [*key, "object_id"])
    others = held.withColumnRenamed("object_id", "other_id")
    edges = sized_join(others, wanted, key, ["other_id"])
    edges = edges.where(F.col("object_id") != F.col("other_id"))
    return edges.withColumn("weight", exact_weight(exact)).select(EDGE_COLUMNS)


def _short_key(name: str, *parts: str) -> list[Column]:
    """Two long columns with 120 bits of a SHA-256, a compact stand-in for a long value."""
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    return [
        F.conv(F.substring(digest, start, 15), 16, 10).cast("long").alias(f"{name}_{i}")
        for i, start in enumerate((1, 16))
    ]


def _token_rows(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, n, distinct): one row per distinct token of each value.

    The outer form is used because for the inner one Spark would copy the whole token expression
    into a filter and push it to the scan; a value without tokens gives a NULL token, which no join
    on the token keeps.
    """
    counts = token_counts(split_tokens(F.col("feature_value")))
    return values.select(*keys, F.inline_outer(counts))


def overlap_edges(
    kb: DataFrame,
    targets: DataFrame | Stored,
    features: Sequence[Feature] = FEATURES,
    as_sets: bool = False,
    best_only: bool = False,
) -> DataFrame:
    """Edges to all objects whose comma list shares a token with the target's latest list.

    `targets` has object ids, or is the result of `target_values`.
    Weight: shared tokens counted with repeats (`as_sets`: once each) over distinct tokens of both.
    An object whose history gives several weights has one edge each, or the greatest (`best_only`).

    An inverted index of the targets' distinct lists is joined to the tokens of the knowledge base.
    Tokens are counted inside each row, and targets with equal lists are scored once.
    """
    listed = [f for f in features if not f.exact]
    wanted = targets if isinstance(targets, Stored) else target_values(kb, targets, listed)
    list_key = ["list_0", "list_1"]
    asked = wanted.df.where(F.col("feature_type").isin(_names(listed)))
    asked = asked.select("*", *_short_key("list", "feature_type", "feature_value"))
    lists = asked.dropDuplicates(list_key)
    index = _token_rows(lists, ["feature_type", *list_key])
    index = index.withColumnsRenamed({"n": "list_n", "distinct": "list_distinct"})

    history = kb.where(F.col("feature_type").isin(_names(listed)))
    value_key = ["value_0", "value_1"]
    history = history.select("*", *_short_key("value", "feature_value"))
    row = ["object_id", *value_key]
    tokens = _token_rows(history, ["feature_type", *row, "ts"])
    hits = sized_join(
        tokens, index.where(F.col("token").isNotNull()), ["feature_type", "token"], row
    )
    # repeated values are settled here, among the tokens that met, so that no value is shuffled
    numbers = ("n", "list_n", "distinct", "list_distinct", "ts")
    hits = hits.groupBy(*list_key, *row, "token").agg(*[F.max(c).alias(c) for c in numbers])
    union = F.max("distinct") + F.max("list_distinct") - F.count("*")
    shared = F.count("*") if as_sets else F.sum(F.least("n", "list_n"))
    scored = hits.groupBy(*list_key, *row).agg(
        (shared / union).alias("weight"), F.max("ts").alias("ts")
    )
    others = scored.withColumnRenamed("object_id", "other_id")
    owners = Stored(asked.drop("feature_value"), wanted.rows, wanted.size)
    edges = sized_join(others, owners, list_key, ["other_id"])
    edges = edges.where(F.col("object_id") != F.col("other_id"))
    pair = ["object_id", "other_id", "feature_type"]
    if best_only:
        best = F.max(F.struct("weight", "ts")).alias("b")
        return edges.groupBy(*pair).agg(best).select(*pair, "b.weight", "b.ts")
    return newest_time(edges, [*pair, "weight"]).select(EDGE_COLUMNS)


def primary_relationships(
    kb: DataFrame,
    targets: DataFrame,
    features: Sequence[Feature] = FEATURES,
    as_sets: bool = False,
    best_only: bool = False,
) -> DataFrame:
    """All edges of the targets, over all features."""
    wanted = target_values(kb, targets, features)
    parts = []
    if any(f.exact for f in features):
        parts.append(exact_edges(kb, wanted, features))
    if any(not f.exact for f in features):
        parts.append(overlap_edges(kb, wanted, features, as_sets, best_only))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def exact_groups(kb: DataFrame, features: Sequence[Feature] = FEATURES) -> DataFrame:
    """(feature_type, feature_value, object_id, ts): which objects ever had a value.

    The exact relationships of every object in linear form: two objects are related where they meet
    in a group, and the pairs are never written out.
    """
    exact = [f for f in features if f.exact]
    held = kb.where(F.col("feature_type").isin(_names(exact)))
    return newest_time(held, ["feature_type", "feature_value", "object_id"])


def token_index(kb: DataFrame, features: Sequence[Feature] = FEATURES) -> DataFrame:
    """(feature_type, object_id, ts, token, n, distinct): the inverted index of the comma lists.

    The overlap relationships of every object in linear form: two lists overlap where they meet
    under a token, and their score follows from the counts here. `ts` is the newest time of the list.
    """
    listed = [f for f in features if not f.exact]
    history = kb.where(F.col("feature_type").isin(_names(listed)))
    history = newest_time(history, ["feature_type", "object_id", "feature_value"])
    tokens = _token_rows(history, ["feature_type", "object_id", "feature_value", "ts"])
    return tokens.where(F.col("token").isNotNull()).drop("feature_value")


def related_counts(kb: DataFrame, features: Sequence[Feature] = FEATURES) -> DataFrame:
    """Per object and exact feature: its latest value, the number of related objects, their weight.

    Linear in the knowledge base: group sizes are counted and joined to the latest values. An object
    is in its own group once, hence the minus one.
    """
    exact = [f for f in features if f.exact]
    key = ["feature_type", "feature_value"]
    sizes = exact_groups(kb, exact).groupBy(*key).agg(F.count("*").alias("_size"))
    mine = latest_values(kb.where(F.col("feature_type").isin(_names(exact))))
    counted = sized_join(mine, sizes, key, ["object_id"])
    return counted.select(
        "object_id",
        *key,
        (F.col("_size") - 1).alias("n_related"),
        ((F.col("_size") - 1) * exact_weight(exact)).alias("total_weight"),
    )


def most_related(counts: DataFrame, k: int) -> DataFrame:
    """The k objects with the greatest total weight of related objects."""
    total = counts.groupBy("object_id").agg(F.sum("total_weight").alias("total_weight"))
    return total.orderBy(F.desc("total_weight"), "object_id").limit(k)


def _part_of(other_id: str, parts: int) -> Column:
    number = F.conv(F.substring(F.md5(other_id), 1, 8), 16, 10).cast("long")
    return (number % parts).cast("int")


def record_parts(edges: DataFrame, most: int = RECORD_CELL) -> int:
    """The least power of two of parts for which no cell of a record holds more than `most` matches.

    One aggregate over the edges, which should be stored, and one more for each doubling behind the first guess.
    Matches with the same id cannot be parted: an object with more than `most` of them ends the search.
    """
    cell = ["object_id", "feature_type"]

    def largest(*more: Column) -> int:
        return edges.groupBy(*cell, *more).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0

    whole, parts = largest(), 1
    while parts * most < whole:
        parts *= 2
    while parts > 1 and parts < 64 * whole and largest(_part_of("other_id", parts).alias("part")) > most:
        parts *= 2
    return parts


def relationship_records(
    kb: DataFrame,
    targets: DataFrame,
    edges: DataFrame,
    ts: Column,
    features: Sequence[Feature] = FEATURES,
    parts: int | None = None,
    most: int = RECORD_CELL,
) -> DataFrame:
    """The wide record: one array of {sha256, weight} per feature, sorted by id and weight.

    `edges` are those of the targets, or links as edges (see `classes.as_edges`); they are read several times
    and should be stored.

    An object's matches are dealt to `parts` rows by a hash of their id; rows without a match are left out but
    for part 0. The number of parts is worked out from the largest group (`record_parts`), so that no cell holds
    more than `most` matches. In part 0 NULL says that the object lacks the feature, an empty
    array that none of its matches is there; in the others NULL says either.
    """
    if parts is None:
        parts = record_parts(edges, most)
    group = ["object_id", "feature_type"]
    targets = measured(targets.select("object_id").distinct())
    asked = kb.where(F.col("feature_type").isin(_names(features)))
    mine = semi_join(asked, targets, ["object_id"], ["feature_type", "ts"])
    owned = mine.select(*group).distinct()
    placed = edges.withColumn("part", _part_of("other_id", parts))
    match = F.struct(F.col("other_id").alias("sha256"), "weight")
    lists = placed.groupBy(*group, "part").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    none = F.array().cast(lists.schema["matches"].dataType)
    first = owned.select(*group, F.lit(0).alias("part"), none.alias("matches"))
    column = _by_feature({f.name: f.column for f in features}).alias("column")
    cells = lists.unionByName(first).select("object_id", "part", column, "matches")
    # the empty array of `first` gives way to a list of the same part
    wide = (
        cells.groupBy("object_id", "part")
        .pivot("column", [f.column for f in features])
        .agg(F.max(F.struct(F.size("matches"), "matches"))["matches"])
    )
    bare = targets.df.withColumn("part", F.lit(0))
    return bare.join(wide, ["object_id", "part"], "full").withColumn("ts", ts)


def records_as_json(records: DataFrame, features: Sequence[Feature] = FEATURES) -> DataFrame:
    """The record with its lists as JSON text, the interchange form."""
    lists = [F.to_json(f.column).alias(f.column) for f in features]
    return records.select("object_id", "part", *lists, "ts")


def records_as_blobs(records: DataFrame, features: Sequence[Feature] = FEATURES) -> DataFrame:
    """The record with its lists as gzip JSON blobs, as they are exchanged with other stores."""
    text = records_as_json(records, features)
    return text.withColumns({f.column: gzip_text(f.column) for f in features})


def above(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges with a weight above the threshold."""
    return edges.where(F.col("weight") > threshold)


def with_features(edges: DataFrame, names: list[str]) -> DataFrame:
    """Edges of the given feature types."""
    return edges.where(F.col("feature_type").isin(names))


def related_numbers(edges: DataFrame) -> DataFrame:
    """(object_id, n): the edges of each object. Links to classes count as many edges as they have links."""
    return edges.groupBy("object_id").agg(_edge_count(edges).alias("n"))


def weight_histogram(
    edges: DataFrame, low: float, high: float, segments: int, members: DataFrame | None = None
) -> DataFrame:
    """Number of edges and of related objects (or classes) per segment of the weight.

    Segment 0 lies below `low`, segment `segments` + 1 from `high` on. Links to classes count as many edges
    as they have links. With `members` (class_id, member) of the classes, objects are counted and no classes.
    """
    segment = F.width_bucket("weight", F.lit(low), F.lit(high), F.lit(segments)).cast("int")
    placed = edges.withColumn("segment", segment)
    counted = _edge_count(edges).alias("n_edges")
    if members is None:
        return placed.groupBy("segment").agg(counted, F.countDistinct("other_id").alias("n_objects"))
    met = placed.groupBy("segment", "other_id").agg(
        counted, F.min("object_id").alias("first"), F.max("object_id").alias("last")
    )
    met = measured(met)
    members = members.select(F.col("class_id").alias("other_id"), "member")
    classes = members.select("other_id").distinct()
    objects = sized_join(met.df, classes, ["other_id"], ["segment"], "left_anti").select("segment", "other_id")
    # an object is no link of its own, so a class that one object alone leads to counts without it
    of_classes = sized_join(members, met, ["other_id"], ["member"])
    of_classes = of_classes.where((F.col("first") != F.col("last")) | (F.col("member") != F.col("first")))
    objects = objects.unionByName(of_classes.select("segment", F.col("member").alias("other_id")))
    sizes = objects.groupBy("segment").agg(F.countDistinct("other_id").alias("n_objects"))
    return met.df.groupBy("segment").agg(F.sum("n_edges").alias("n_edges")).join(sizes, "segment")


def _edge_count(edges: DataFrame) -> Column:
    return F.sum("n_links") if "n_links" in edges.columns else F.count("*")


def total_weights(edges: DataFrame) -> DataFrame:
    """The final score of a pair: its summed weights over all features. The sum is our choice.

    A link to a class counts as many times as it has links: the score of an object and a class is that of all its pairs.
    """
    weight = F.col("weight") * F.col("n_links") if "n_links" in edges.columns else F.col("weight")
    return edges.groupBy("object_id", "other_id").agg(F.sum(weight).alias("weight"))
