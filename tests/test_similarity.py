"""The thresholded self-join against all pairs by brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relspark.operators import similarity as S
from relspark.sources.schemas import KNOWLEDGE_BASE
from relspark.sources.stored import stored

DAY = dt.datetime(2024, 1, 1)


def tokens_of(value):
    parts = value.split(",")
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    return Counter() if parts == [""] and value else Counter(parts)


def weight(a, b):
    return sum((a & b).values()) / len(a | b)


def random_lists(seed, n=120):
    """Lists with a token in most of them, near copies, repeats, equal lists, single and empty ones."""
    r, out = random.Random(seed), ["", ",", "hot", "hot,hot,hot", "hot,a", "hot,b"]
    for _ in range(n):
        base = [f"t{int(r.paretovariate(0.6)) % 60}" for _ in range(r.randint(1, 12))]
        base += ["hot"] * (r.random() < 0.7)
        out.append(",".join(base))
        if r.random() < 0.5:
            near = base[:]
            near[r.randrange(len(near))] = "odd"
            out.append(",".join(near))
        if r.random() < 0.2:
            out.append(",".join(base))
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0, 1.4])
def test_recall_is_one(spark, threshold):
    values = random_lists(3)
    rows = [(f"o{i}", "yara_rules", v, DAY) for i, v in enumerate(values)] + [("n", "yara_rules", None, DAY), ("x", "pehash", "hot", DAY)]
    kb = stored(spark.createDataFrame(rows, KNOWLEDGE_BASE).coalesce(2))
    pairs, holders = S.similar_lists(kb, threshold)
    held = {}
    for r in holders.collect():
        held.setdefault(r.list, set()).add(r.object_id)
    got = {(frozenset((min(held[r.a]), min(held[r.b]))), round(r.weight, 9)) for r in pairs.collect()}
    assert len(got) == pairs.count()
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, f"o{i}")
    same = {v: min(f"o{i}" for i, w in enumerate(values) if w == v) for v in first}
    distinct = sorted(first)
    expected = set()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            x, y = tokens_of(a), tokens_of(b)
            if x and y and weight(x, y) >= threshold - 1e-9:
                expected.add((frozenset((same[a], same[b])), round(weight(x, y), 9)))
    assert got == expected


def test_a_frequent_token_does_not_make_all_pairs(spark):
    """3,000 different lists with one token in common: no candidates at 0.5."""
    kb = spark.range(3000).select(
        F.concat(F.lit("o"), "id").alias("object_id"),
        F.lit("yara_rules").alias("feature_type"),
        F.concat(F.lit("hot,r"), "id").alias("feature_value"),
        F.lit(DAY).cast("timestamp_ntz").alias("ts"),
    )
    _, tokens = S.list_tokens(stored(kb), S.FEATURES)
    assert S.candidate_pairs(S.ordered_lists(tokens), 0.5).count() == 0


def test_counts_and_empty(spark):
    rows = [(f"o{i}", "yara_rules", "a,b" if i < 4 else "a,b,c", DAY) for i in range(6)] + [("z", "yara_rules", "q", DAY)]
    pairs, holders = S.similar_lists(stored(spark.createDataFrame(rows, KNOWLEDGE_BASE)), 0.6)
    counts = S.linked_objects(S.similar_classes(pairs, holders), holders)
    assert {r.object_id: r.n_links for r in counts.collect()} == {f"o{i}": 5 for i in range(6)}
    pairs, holders = S.similar_lists(spark.createDataFrame([], KNOWLEDGE_BASE), 0.6)
    assert pairs.count() == 0 and holders.count() == 0
    with pytest.raises(ValueError):
        S.similar_lists(spark.createDataFrame([], KNOWLEDGE_BASE), 0.0)
