"""Conversation trie and Merkle manifest against brute force."""

import hashlib
import random
import zlib

import pytest
from cases import LONG, awkward, table

from relspark.llm import merkle, prefix_trie
from relspark.llm.radix_tree import RadixTree, shared

TURNS = "conv_id long, turn long, role string, text string, id string, d string, node string, conv string, up string, n string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- radix tree ------------------------------------------------------------------------------


def test_shared_bytes():
    assert shared(b"abcd", b"abxd") == 2 and shared(b"ab", b"abxd") == 2
    assert shared(b"", b"a") == 0 and shared(b"xa", b"ya") == 0


@pytest.mark.parametrize("fan", [2, 4, 5, 16, 17, 48, 49, 256])
def test_tree_sums_and_layouts(fan):
    r = random.Random(fan)
    keys = {bytes(r.randrange(fan) for _ in range(r.randint(0, 6))) for _ in range(600)} | {bytes([b]) for b in range(fan)}
    keys = sorted(keys)
    tree = RadixTree()
    for i in r.sample(range(len(keys)), len(keys)):
        tree.add(keys[i], i, 1, i, i)
    tree.add(keys[0], 0, 1, 0, -5)  # an equal key adds up
    found, paths = {}, []
    for node, parent, byte in tree.total():
        path = (paths[parent] + bytes([byte]) if parent >= 0 else b"") + node.prefix
        paths.append(path)
        found[path] = (node.a, node.b, node.least)
        size = len(list(node.branches()))
        assert [b for b, _ in node.branches()] == sorted(b for b, _ in node.branches())
        assert node.layout() >= size and (node.layout() == 4) == (size <= 4)
        assert keys[node.row].startswith(path)
    assert paths == sorted(paths) and set(keys) <= set(found)
    for path, sums in found.items():
        below = [i for i, k in enumerate(keys) if k.startswith(path)]
        least = -5 if keys[0].startswith(path) else min(below)
        assert sums == (len(below) + (keys[0].startswith(path)), sum(below), least)


# --- conversations ---------------------------------------------------------------------------


def trie_by_hand(rows):
    given = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tid = digest(f"{len(role.encode())}:{role}{text}")[:32]
            given.setdefault(conv, []).append((turn is not None, turn or 0, tid, role, text))
    given = {c: [t[3:] for t in sorted(turns)] for c, turns in given.items()}
    rebuilt = {}
    for conv, own in given.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = conv - (abs(conv) % 5 if conv >= 0 else -(abs(conv) % 5))
        rebuilt[conv] = tuple(given.get(first, [])[:h] + own[h:])
    members, children = {}, {}
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        below, all_of = children.get(path, []), members[path]
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        own = (len(all_of) - 1) * (len(path[-1][1].encode()) if path else 0)
        saved[path] = own + sum(saved[p] for p in below)
        ends = ",".join(map(str, sorted(c for c in all_of if len(rebuilt[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(all_of), len(path), parent, len(all_of), len(below), leaves[path], saved[path], digest(ends)))
    return sorted(out, key=str)


def trie(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], TURNS).repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).collect()), key=str)


def awkward_turns():
    r = random.Random(7)
    rows = [
        (None, 0, "user", "nobody's"),
        (0, None, "user", "null turn first"),
        (0, 0, None, None),
        (0, 1, "ab", "c"),
        (0, 2, "a", "bc"),
        (1, 0, "user", "é 漢字 🙂"),
        (3, 5, "user", "tie"),
        (3, 5, "assistant", "tie"),
        (3, 5, "assistant", "tie"),  # a repeated row
        (7, 0, "user", "its family has no first"),
        (-3, 0, "user", "negative"),
        (-5, 0, "user", "first of the negative family"),
        (2**62, 0, "user", "far away"),
        (60, 0, "user", LONG),
        (61, 0, "user", "x"),
    ]
    for conv in range(10, 60):
        rows += [(conv, t, r.choice("ua"), r.choice(["", "yes", "no", "more"])) for t in range(r.randint(1, 14))]
    return rows


def test_trie(spark, monkeypatch):
    rows = awkward_turns()
    expected = trie_by_hand(rows)
    assert trie(spark, rows) == expected
    # tiny blocks, trees given out after a few keys, and ids joined in pieces change nothing
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    assert trie(spark, rows) == expected


def test_long_and_equal_conversations(spark):
    shared_part = [("u", f"t{i % 7}") for i in range(600)]
    rows = [(c, t, *x) for c in (5, 6, 7) for t, x in enumerate(shared_part + [("u", f"own {c}")] * 2)]
    rows += [(c, t, "u", f"copy {t}") for c in range(100, 400) for t in range(12)]
    assert trie(spark, rows) == trie_by_hand(rows)


def test_pieces_of_ids(spark):
    frame = spark.range(5000).selectExpr("CAST(CAST(id % 3 AS STRING) AS BINARY) AS id", "id - 2500 AS conv").repartition(7)
    got = {bytes(r.id): r.ends_sha256 for r in prefix_trie.hashed_ids(frame).collect()}
    assert got == {str(k).encode(): digest(",".join(str(i - 2500) for i in range(k, 5000, 3))) for k in range(3)}


def test_empty_trie(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "u", "x")]) == []
    assert trie(spark, [(8, 0, "u", "x")]) == trie_by_hand([(8, 0, "u", "x")])


# --- Merkle manifest -------------------------------------------------------------------------


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return digest("".join(map(field, (doc_id, source, lang, n_chars, text))))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 8])
        i //= 8


def manifest_by_hand(rows):
    groups, out = {}, []
    for row in rows:
        key = (row[0] is not None, row[0] or 0)
        groups.setdefault(row[2], []).append((*key, leaf(row, row[1]), leaf(row, lowered(row[1]))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([m[2] for m in sorted(groups[x])]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    for k, lang in enumerate(langs):
        for i, (known, doc_id, own, tampered) in enumerate(sorted(groups[lang])):
            path = [*siblings(trees[lang], i), *siblings(top, k)]
            node = tampered if known and zlib.crc32(str(doc_id).encode()) % 3 == 0 else own
            for left, right in path:
                node = digest(left + node + right)
            root, proof = top[-1][0], digest("".join(a + b for a, b in path))
            out.append((doc_id if known else None, own, trees[lang][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest(spark, rows):
    return sorted((tuple(r) for r in merkle.merkle_manifest(table(spark, rows)).collect()), key=str)


def test_manifest(spark):
    rows = awkward()
    assert manifest(spark, rows) == manifest_by_hand(rows)


@pytest.mark.parametrize("sizes", [[1], [9], [512], [1, 2, 7, 8, 63, 64, 65, 513, 1100], [1] * 70])
def test_sizes_of_groups(spark, sizes):
    x = awkward()[0][5:]
    rows = [(1000 * g + i, f"Text {i}", f"l{g}", "s", i, *x) for g, n in enumerate(sizes) for i in range(n)]
    assert manifest(spark, rows) == manifest_by_hand(rows)


def test_a_third_round(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)  # blocks of 8 nodes: four rounds for 600 rows, three for 70 groups
    monkeypatch.setattr(merkle, "BLOCK", 8)
    x = awkward()[0][5:]
    rows = [(i, f"Text {i}", "a" if i < 600 else f"l{i}", "s", i, *x) for i in range(670)]
    assert manifest(spark, rows) == manifest_by_hand(rows)


def test_empty_manifest(spark):
    assert manifest(spark, []) == []
