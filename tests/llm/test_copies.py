import hashlib
import random
from collections import Counter, defaultdict

import pytest
from cases import DOCS, awkward, linked, normal, prose, row, simhash, table

from relspark.llm import exact_dedup, simhash as sim
from relspark.operators import joins


@pytest.fixture
def cut_keys(monkeypatch):
    """Nothing fits a broadcast, and keys of more than three rows are cut into pieces."""
    sized, defaults = joins.fits_broadcast, joins.salted_join.__defaults__
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(joins, "fits_broadcast", lambda t: sized(t) and "_pieces" in t.df.columns)
    monkeypatch.setattr(joins.salted_join, "__defaults__", (*defaults[:-1], 3))


def least(ids):
    return min((i for i in ids if i is not None), default=None)


@pytest.mark.parametrize("support", [0.005, 0.2])
def test_exact_groups(spark, support):
    rows = awkward() + [row(500 + i, "hot  text") for i in range(40)]
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    got = exact_dedup.exact_groups(table(spark, rows), support=support).collect()
    expected = Counter(
        (r[0], least(groups[normal(r[1])]), len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest())
        for r in rows
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_frequent_digests_are_found_and_few(spark):
    rows = [row(i, "hot" if i % 3 == 0 else "warm" if i % 5 == 0 else f"t{i}") for i in range(600)]
    digests = table(spark, rows).selectExpr("doc_id AS id", "sha2(text, 256) AS digest", "doc_id AS row")
    winners = exact_dedup.frequent_winners(digests, 0.05).collect()
    found = {r.digest: (r.winner.id, r.group_size) for r in winners}
    assert found[hashlib.sha256(b"hot").hexdigest()] == (0, 200)
    assert found[hashlib.sha256(b"warm").hexdigest()] == (5, 80)
    assert len(found) <= 20


def test_without_copies_keeps_rows_and_columns(spark):
    rows = awkward() + [row(500 + i, "hot  text") for i in range(40)]
    got = exact_dedup.without_copies(table(spark, rows), support=0.2)
    assert got.schema == DOCS
    left = [tuple(r) for r in got.collect()]
    assert sorted(normal(r[1]) for r in left) == sorted({normal(r[1]) for r in rows})
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    assert all(r[0] == least(groups[normal(r[1])]) for r in left)
    assert not Counter(left) - Counter(rows)


def test_fingerprints():
    for text in [r[1] for r in awkward()] + ["A b", "a\x0bb\x0cc d", "é É"]:
        assert sim.fingerprint((text or "").encode()) == simhash(text)


def near_copies(n, seed=0):
    """Texts of one base with a word changed here and there, so that chains of links arise."""
    r, base = random.Random(seed), prose(seed, 120).split()
    out = []
    for _ in range(n):
        base[r.randrange(len(base))] = prose(r.random(), 1)
        out.append(" ".join(base))
    return out


def test_near_duplicates(spark):
    rows = awkward() + [row(1000 + i, t) for i, t in enumerate(near_copies(120))]
    prints = [simhash(r[1]) for r in rows]
    root = linked(prints)
    members = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        members[root[p]].append(r[0])
    expected = Counter((r[0], format(p, "016x"), least(members[root[p]])) for r, p in zip(rows, prints, strict=True))
    got = sim.near_duplicates(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == expected
    assert len(members) < len(set(prints))  # there are links between different fingerprints
    kept = sim.without_near_duplicates(table(spark, rows))
    assert kept.schema == DOCS
    left = kept.collect()
    assert Counter(root[simhash(r.text)] for r in left) == Counter(members.keys())
    assert all(r.doc_id == least(members[root[simhash(r.text)]]) for r in left)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_every_pair_within_the_distance_is_found_once(spark, bits):
    r = random.Random(bits)
    prints = {r.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1, 1, 1 << 63}
    for p in list(prints):
        for _ in range(12):
            q = p
            for b in r.sample(range(64), r.randint(0, bits + 2)):
                q ^= 1 << b
            prints.add(q)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = sim.linked_pairs(spark.createDataFrame(signed, "fp long"), bits).collect()
    expected = {(a, b) for a, in signed for b, in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert Counter((p.a, p.b) for p in got) == Counter(expected)


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = {r.node: r.root for r in sim.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(got) == 303
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]


def test_empty_tables(spark):
    empty = table(spark, [])
    for result in (
        exact_dedup.exact_groups(empty),
        exact_dedup.without_copies(empty),
        sim.near_duplicates(empty),
        sim.without_near_duplicates(empty),
    ):
        assert result.count() == 0


def test_a_third_of_the_rows_in_one_group(spark, cut_keys):
    """One text and one dense component hold a third of all rows each; their keys are cut into pieces."""
    same, near = prose(70, 40), near_copies(60, 8)
    rows = [row(i, same) for i in range(60)] + [row(100 + i, t) for i, t in enumerate(near)]
    rows += [row(200 + i, prose(300 + i // 2, 30)) for i in range(60)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r[0])
    docs = table(spark, rows)
    # at this support no digest is frequent: all groups go through the shuffle
    got = exact_dedup.exact_groups(docs, support=0.9).collect()
    expected = Counter((r[0], min(groups[r[1]]), len(groups[r[1]]), r[0] == min(groups[r[1]])) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == expected
    kept = {r.doc_id for r in exact_dedup.without_copies(docs, support=0.9).collect()}
    assert kept == {min(g) for g in groups.values()}
    prints = [simhash(r[1]) for r in rows]
    root = linked(prints)
    least_of = {}
    for r, p in zip(rows, prints, strict=True):
        least_of[root[p]] = min(r[0], least_of.get(root[p], r[0]))
    got = {r.doc_id: r.component_id for r in sim.near_duplicates(docs).collect()}
    assert got == {r[0]: least_of[root[p]] for r, p in zip(rows, prints, strict=True)}
    assert {r.doc_id for r in sim.without_near_duplicates(docs).collect()} == set(least_of.values())
