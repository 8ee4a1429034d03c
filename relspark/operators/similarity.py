"""Every pair of comma lists above a threshold, over all objects and without targets.

Each distinct list is a class of the objects that hold it and is compared once. Weight: shared tokens
counted with repeats, over distinct tokens of both (as for edges). A list is a set of elements (token, k-th time), in
one order for all lists: rarest first. With N elements, d distinct tokens and O shared elements, a weight of t takes

    O >= t * max(d, d')    and    O >= t / (1 + t) * (d + d'), which is 2t / (1 + t) * d for the list of fewer tokens,

so two such lists share an element among the first N - ceil(that) + 1 of each. Only these are joined: the
shorter prefix of the list of fewer tokens with the longer one of the other. Frequent tokens come last in the order, so they are
in the prefix of a list only where it has hardly another token. Pairs whose sizes, or the places of
their first common element, leave no room for enough shared elements go next; what is left is scored whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.operators.classes import list_tokens
from relspark.operators.joins import sized_join
from relspark.sources.schemas import FEATURES, Feature
from relspark.sources.stored import measured, stored

_ROOM = 1e-9  # for rounding, so that no pair is lost at the threshold


def ordered_lists(tokens: DataFrame) -> DataFrame:
    """Stored (feature_type, list, size, distinct, elements, firsts) of each list, elements rarest first.

    An element is a 64-bit hash of a token and its number among equal ones; `firsts` are those of number 1.
    """
    word = ["feature_type", "token"]
    counts = measured(tokens.groupBy(*word).agg(F.count("*").alias("lists")))
    rows = sized_join(tokens, counts, word, ["list"])
    element = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("n")),
        lambda k: F.struct(F.col("lists"), F.xxhash64("token", k).alias("e"), (k == 1).alias("first")),
    )
    lists = rows.groupBy("feature_type", "list").agg(
        F.max("distinct").alias("distinct"),
        F.sort_array(F.flatten(F.collect_list(element))).alias("all"),  # one list, which was one value
    )
    return stored(
        lists.select(
            "feature_type",
            "list",
            F.size("all").alias("size"),
            "distinct",
            F.col("all")["e"].alias("elements"),
            F.filter("all", lambda x: x["first"])["e"].alias("firsts"),
        )
    )


def _prefix(lists: DataFrame, share: float, names: dict[str, str]) -> DataFrame:
    """One row per element of the part in which a pair must meet, if `share` of the distinct tokens must be shared."""
    need = F.greatest(F.ceil(F.col("distinct") * share - _ROOM).cast("int"), F.lit(1))
    length = F.greatest(F.col("size") - need + 1, F.lit(0))
    part = lists.select(
        "feature_type", "list", "size", "distinct", F.posexplode_outer(F.slice("elements", F.lit(1), length)).alias("at", "e")
    )
    return part.where("e IS NOT NULL").withColumnsRenamed(names)


def candidate_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """(feature_type, a, b) of all pairs that may reach the threshold; a has no more distinct tokens than b."""
    t = threshold
    mine = _prefix(lists, 2 * t / (1 + t), {"list": "a", "size": "size_a", "distinct": "d_a", "at": "at_a"})
    theirs = _prefix(lists, t, {"list": "b", "size": "size_b", "distinct": "d_b", "at": "at_b"})
    met = sized_join(mine, measured(theirs), ["feature_type", "e"], ["a"])
    met = met.where(F.struct("d_a", "a") < F.struct(F.col("d_b").alias("d_a"), F.col("b").alias("a")))
    met = met.where(F.least("size_a", "size_b") + _ROOM >= t * F.col("d_b"))
    sizes = [F.first(c).alias(c) for c in ("size_a", "size_b", "d_a", "d_b")]
    pairs = met.groupBy("feature_type", "a", "b").agg(F.min(F.struct("at_a", "at_b")).alias("first"), *sizes)
    # from their first common element on, places counted from 0
    left = F.least(F.col("size_a") - F.col("first.at_a"), F.col("size_b") - F.col("first.at_b"))
    least_union = F.col("d_a") + F.col("d_b") - F.least(left, "d_a")
    return pairs.where(left + _ROOM >= t * least_union).select("feature_type", "a", "b")


def similar_lists(kb: DataFrame, threshold: float, features: Sequence[Feature] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(feature_type, a, b, weight) of all pairs of different lists of at least that weight, a before b; and holders.

    Holders are (feature_type, list, object_id): who is linked by a pair, or by holding the same list.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    holders, tokens = list_tokens(kb, features)
    lists = ordered_lists(tokens)
    pairs = candidate_pairs(lists, threshold)

    def side(name: str) -> DataFrame:
        return lists.select(
            "feature_type",
            F.col("list").alias(name),
            F.col("distinct").alias(f"d_{name}"),
            F.col("elements").alias(f"all_{name}"),
            F.col("firsts").alias(f"firsts_{name}"),
        )

    # each pair comes once and each list is one row, so neither join meets a key of many rows on both sides
    found = sized_join(pairs, measured(side("a")), ["feature_type", "a"], ["b"])
    found = sized_join(found, measured(side("b")), ["feature_type", "b"], ["a"])
    shared = F.size(F.array_intersect("all_a", "all_b"))
    union = F.col("d_a") + F.col("d_b") - F.size(F.array_intersect("firsts_a", "firsts_b"))
    found = found.select("feature_type", "a", "b", (shared / union).alias("weight"))
    found = found.where(F.col("weight") + _ROOM >= threshold)
    return found.select("feature_type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight"), holders


def similar_classes(pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """Pairs with the number of objects on either side, and each list of several objects with itself."""
    sizes = stored(holders.groupBy("feature_type", "list").agg(F.count("*").alias("n")))

    def of(side: str) -> DataFrame:
        return sizes.select("feature_type", F.col("list").alias(side), F.col("n").alias(f"n_{side}"))

    both = sized_join(pairs, measured(of("a")), ["feature_type", "a"], ["b"])
    both = sized_join(both, measured(of("b")), ["feature_type", "b"], ["a"])
    alone = sizes.where("n > 1").select(
        "feature_type", F.col("list").alias("a"), F.col("list").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"),
        F.lit(None).cast("double").alias("weight"),
    )
    return both.select("feature_type", "a", "b", "n_a", "n_b", "weight").unionByName(alone)


def linked_objects(classes: DataFrame, holders: DataFrame) -> DataFrame:
    """(feature_type, object_id, n_links): how many other objects each object is linked to, list by list."""
    way = classes.select("feature_type", F.col("a").alias("list"), (F.col("n_b") - (F.col("a") == F.col("b")).cast("int")).alias("n"))
    back = classes.where("a <> b").select("feature_type", F.col("b").alias("list"), F.col("n_a").alias("n"))
    per_list = way.unionByName(back).groupBy("feature_type", "list").agg(F.sum("n").alias("n"))
    found = sized_join(holders, measured(per_list), ["feature_type", "list"], ["object_id"])
    return found.groupBy("feature_type", "object_id").agg(F.sum("n").alias("n_links"))
