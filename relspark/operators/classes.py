"""Relationships of many objects at once: pairs where they are few, classes where they are many.

A value held by n objects has n * n exact edges, and a token in n lists as many overlaps. Here a value held by
more than `most` objects is a class instead: one row per asked-for object says that it is linked to the class, and how
many objects that is; who is in the class stands once, in the members. Only the other values give pairs. Lists
are compared once per distinct list, which is a class of the objects that hold it. Lists that meet under
a token of at most `most` lists get their full score, all shared tokens counted; those that meet only
under more frequent tokens are linked by the class of that token, or scored as well on request (`score_all`): then
there are no classes of tokens, and the rows grow with the pairs of different lists that meet. So no link is lost, and the rows grow
with the knowledge base and `most`, not with the square of a group.

Links are (object_id, other_id, class_id, feature_type, weight, n_links, ts):

    a pair       other_id, weight, the newest time; n_links 1
    a value      class_id, weight; n_links: other objects that ever had the value
    a list       class_id, weight; n_links: other objects that ever had the list
    a token      class_id; n_links: other lists with the token

Members are (class_id, kind, member): objects of values and lists, class ids of the lists of tokens. `whole_links` and
`whole_edges` give links and the members of the classes they lead to in one table, so that nobody linked is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.operators.joins import semi_join, sized_join
from relspark.operators.latest import newest_time
from relspark.operators.relationships import _names, _token_rows, exact_weight, target_values
from relspark.sources.schemas import FEATURES, Feature
from relspark.sources.stored import Stored, measured, stored

#: Objects of a value, and lists of a token, up to which their links are written as pairs.
MOST = 1000
LINK_COLUMNS = ["object_id", "other_id", "class_id", "feature_type", "weight", "n_links", "ts"]


@dataclass(frozen=True)
class Linked:
    links: DataFrame
    members: DataFrame


def class_of(kind: str, feature_type: str, value: str) -> Column:
    """128 bits of a SHA-256, as hex digits."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), feature_type, value), 256), 1, 32)


def _link(other_id: Column, class_id: Column, weight: Column, n_links: Column, ts: Column) -> list:
    return [
        "object_id",
        other_id.cast("string").alias("other_id"),
        class_id.cast("string").alias("class_id"),
        "feature_type",
        weight.cast("double").alias("weight"),
        n_links.cast("long").alias("n_links"),
        ts.alias("ts"),
    ]


def exact_links(kb: DataFrame, wanted: Stored, features: Sequence[Feature], most: int = MOST) -> Linked:
    """Links of the objects in `wanted` (see target_values) by equal values, and the members of all value classes."""
    exact = [f for f in features if f.exact]
    key = ["feature_type", "feature_value"]
    history = kb.where(F.col("feature_type").isin(_names(exact)))
    held = stored(newest_time(history, [*key, "object_id"]))
    sizes = measured(held.groupBy(*key).agg(F.count("*").alias("size")))
    mine = wanted.df.where(F.col("feature_type").isin(_names(exact)))
    mine = stored(sized_join(mine, sizes, key, ["object_id"]))
    none, weight = F.lit(None), exact_weight(exact)
    light = measured(mine.where(F.col("size") <= most).drop("size"))
    # a key has at most `most` rows on either side here
    others = held.withColumnRenamed("object_id", "other_id")
    pairs = sized_join(others, light, key, ["other_id"]).where("object_id <> other_id")
    pairs = pairs.select(*_link(F.col("other_id"), none, weight, F.lit(1), F.col("ts")))
    no_time = none.cast(held.schema["ts"].dataType)
    classes = mine.where((F.col("size") > most)).select(
        *_link(none, class_of("value", *key), weight, F.col("size") - 1, no_time)
    )
    heavy = sizes.df.where(F.col("size") > most).select(*key)
    members = semi_join(held, heavy, key, ["object_id"])
    members = members.select(
        class_of("value", *key).alias("class_id"), F.lit("value").alias("kind"), F.col("object_id").alias("member")
    )
    return Linked(pairs.unionByName(classes), members)


def list_tokens(kb: DataFrame, features: Sequence[Feature]) -> tuple[DataFrame, DataFrame]:
    """Stored (feature_type, list, object_id), and (feature_type, list, token, n, distinct): each distinct list once.

    Lists are told apart by a digest; tokens are counted inside the rows and repeats combined before they
    are shuffled, so no list is.
    """
    listed = [f for f in features if not f.exact]
    history = kb.where(F.col("feature_type").isin(_names(listed)) & F.col("feature_value").isNotNull())
    history = history.withColumn("list", class_of("list", "feature_type", "feature_value"))
    holders = stored(history.select("feature_type", "list", "object_id").distinct())
    tokens = _token_rows(history, ["feature_type", "list"]).where("token IS NOT NULL")
    counts = [F.max("n").cast("long").alias("n"), F.max("distinct").cast("long").alias("distinct")]
    return holders, stored(tokens.groupBy("feature_type", "list", "token").agg(*counts))


def scored_lists(asked: DataFrame, tokens: DataFrame, frequent: Stored) -> DataFrame:
    """(feature_type, mine, list, weight) of the asked-for lists and all lists that meet them under a rarer token.

    `frequent` has the (feature_type, token) that too many lists have; they count in the score of lists
    that meet elsewhere too.
    """
    word = ["feature_type", "token"]
    split = sized_join(tokens, Stored(frequent.df.withColumn("often", F.lit(True)), frequent.rows, frequent.size), word, ["list"], "left")
    split = stored(split.withColumn("often", F.coalesce("often", F.lit(False))))
    mine = semi_join(split, asked.select(F.col("list")), ["list"], ["token"])
    mine = mine.withColumnsRenamed({"list": "mine", "n": "my_n", "distinct": "my_distinct"})
    asked_tokens = measured(mine)
    mine = asked_tokens.df

    def shared(met: DataFrame) -> DataFrame:
        return met.groupBy("feature_type", "mine", "list").agg(
            F.sum(F.least("n", "my_n")).alias("shared"),
            F.count("*").alias("met"),
            F.max("distinct").alias("distinct"),
            F.max("my_distinct").alias("my_distinct"),
        )

    rare, often = F.col("often") == F.lit(False), F.col("often")
    # a token of many lists meets the asked-for ones in place, or in pieces
    few = Stored(mine.where(rare).drop("often"), asked_tokens.rows, asked_tokens.size)
    met = stored(shared(sized_join(split.where(rare).drop("often"), few, word, ["list"])))
    pairs = met.select("feature_type", "mine", "list")
    more = shared(
        pairs.join(mine.where(often).drop("often"), ["feature_type", "mine"]).join(
            split.where(often).drop("often"), ["feature_type", "list", "token"]
        )
    ).select("feature_type", "mine", "list", F.col("shared").alias("more"), F.col("met").alias("more_met"))
    zero = F.lit(0)
    scored = met.join(more, ["feature_type", "mine", "list"], "left")
    both = F.col("met") + F.coalesce("more_met", zero)
    return scored.select(
        "feature_type",
        "mine",
        "list",
        ((F.col("shared") + F.coalesce("more", zero)) / (F.col("distinct") + F.col("my_distinct") - both)).alias("weight"),
    )


def overlap_links(
    kb: DataFrame, wanted: Stored, features: Sequence[Feature], most: int = MOST, score_all: bool = False
) -> Linked:
    """Links of the objects in `wanted` by common tokens of their lists, and the members of all list and token classes.

    Weight: shared tokens counted with repeats, over distinct tokens of both lists. With `score_all` every two lists
    that meet are scored, however frequent the tokens they meet under, and no token is a class.
    """
    listed = [f for f in features if not f.exact]
    holders, tokens = list_tokens(kb, listed)
    word = ["feature_type", "token"]
    spread = tokens.groupBy(*word).agg(F.count("*").alias("lists"))
    spread = measured(spread.where(F.lit(False) if score_all else F.col("lists") > most))
    frequent = Stored(spread.df.select(*word), spread.rows, spread.size)
    mine = wanted.df.where(F.col("feature_type").isin(_names(listed)) & F.col("feature_value").isNotNull())
    owners = stored(
        mine.select("object_id", "feature_type", class_of("list", "feature_type", "feature_value").alias("mine"))
    )
    asked = stored(owners.select(F.col("mine").alias("list")).distinct())
    scored = measured(scored_lists(asked, tokens, frequent))
    sizes = holders.groupBy("feature_type", "list").agg(F.count("*").alias("size"))
    scored = measured(scored.df.join(sizes, ["feature_type", "list"]))
    found = sized_join(owners, scored, ["feature_type", "mine"], ["object_id"])
    # an object is no link of its own, whichever of its lists it is found by
    own = semi_join(holders, owners.select("object_id"), ["object_id"], ["list"]).withColumn("own", F.lit(1))
    found = found.join(own, ["feature_type", "list", "object_id"], "left")
    others = F.col("size") - F.coalesce("own", F.lit(0))
    no_time = F.lit(None).cast(kb.schema["ts"].dataType)
    lists = found.where(others > 0).select(*_link(F.lit(None), F.col("list"), F.col("weight"), others, no_time))
    # the frequent tokens of the asked-for lists
    mine_often = semi_join(tokens, asked, ["list"], ["token"])
    mine_often = sized_join(mine_often, spread, word, ["list"]).withColumnRenamed("list", "mine")
    by_token = sized_join(owners, measured(mine_often), ["feature_type", "mine"], ["object_id"])
    by_token = by_token.select(
        *_link(F.lit(None), class_of("token", *word), F.lit(None), F.col("lists") - 1, no_time)
    )
    members = holders.select(
        F.col("list").alias("class_id"), F.lit("list").alias("kind"), F.col("object_id").alias("member")
    ).unionByName(
        semi_join(tokens, frequent, word, ["list"]).select(
            class_of("token", *word).alias("class_id"), F.lit("token").alias("kind"), F.col("list").alias("member")
        )
    )
    return Linked(lists.unionByName(by_token), members)


def primary_links(
    kb: DataFrame,
    targets: DataFrame,
    features: Sequence[Feature] = FEATURES,
    most: int = MOST,
    score_all: bool = False,
) -> Linked:
    """All links of the targets over all features. `kb` is read several times and should be stored."""
    wanted = target_values(kb, targets, features)
    parts = []
    if any(f.exact for f in features):
        parts.append(exact_links(kb, wanted, features, most))
    if any(not f.exact for f in features):
        parts.append(overlap_links(kb, wanted, features, most, score_all))
    links, members = parts[0].links, parts[0].members
    for part in parts[1:]:
        links, members = links.unionByName(part.links), members.unionByName(part.members)
    return Linked(links.select(LINK_COLUMNS), members)


def as_edges(links: DataFrame) -> DataFrame:
    """Links as edges to objects or classes, for records and views: other_id is either, a token's weight is 0."""
    return links.select(
        "object_id",
        F.coalesce("other_id", "class_id").alias("other_id"),
        "feature_type",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        "n_links",
        "ts",
    )


def linked_members(linked: Linked) -> DataFrame:
    """(class_id, feature_type, member) of the classes that links lead to, and of the lists with a token that is one.

    `links` are read again and should be stored.
    """
    found = ["class_id", "feature_type", "member"]
    classes = measured(linked.links.where("class_id IS NOT NULL").select("class_id", "feature_type").distinct())
    of_tokens = linked.members.where("kind = 'token'")
    lists = sized_join(of_tokens, classes, ["class_id"], ["member"]).select(F.col("member").alias("class_id"), "feature_type")
    every = measured(classes.df.unionByName(lists).distinct())
    return sized_join(linked.members, every, ["class_id"], ["member"]).select(*found)


def whole_links(linked: Linked) -> DataFrame:
    """Links, then the members of their classes: rows with class_id and other_id, but no object_id."""
    links = stored(linked.links)
    members = linked_members(Linked(links, linked.members))
    return links.unionByName(members.withColumnRenamed("member", "other_id"), allowMissingColumns=True)


def whole_edges(linked: Linked) -> DataFrame:
    """Links as edges, then an edge of weight 1 from each class they lead to to each of its members.

    So records have what an object is linked to, and the records of these classes who that is.
    """
    links = stored(linked.links)
    members = linked_members(Linked(links, linked.members)).select(
        F.col("class_id").alias("object_id"),
        F.col("member").alias("other_id"),
        "feature_type",
        F.lit(1.0).alias("weight"),
        F.lit(1).cast("long").alias("n_links"),
    )
    return as_edges(links).unionByName(members, allowMissingColumns=True)


def expanded(linked: Linked) -> DataFrame:
    """(object_id, other_id, feature_type) of every link, the classes written out: for checks on small tables."""
    to_class = linked.links.where("class_id IS NOT NULL").select("object_id", "class_id", "feature_type")
    members = linked.members
    lists = members.where("kind <> 'token'").select("class_id", F.col("member").alias("other_id"))
    tokens = members.where("kind = 'token'").select("class_id", F.col("member").alias("list"))
    of_tokens = tokens.join(lists.withColumnRenamed("class_id", "list"), "list").select("class_id", "other_id")
    found = to_class.join(lists.unionByName(of_tokens), "class_id").select("object_id", "other_id", "feature_type")
    pairs = linked.links.where("other_id IS NOT NULL").select("object_id", "other_id", "feature_type")
    return pairs.unionByName(found).where("object_id <> other_id").distinct()
