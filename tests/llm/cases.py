"""Small tables with every awkward case, and brute-force versions of the operators."""

import random
import re

import xxhash
from pyspark.sql import types as T

#: The given columns, and names that operators use inside.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("row", "doc", "fp", "digest", "id", "place", "winner", "score", "ids", "shard", "slot", "a.b")],
    ]
)
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SYLLABLES = "an the re on ti es ing ou ha ble née ß ñ 漢 字 x9 Ed".split()


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


def row(doc_id, text, lang="en", source="s1", n_chars=1):
    return (doc_id, text, lang, source, n_chars, *["x"] * (len(DOCS) - 5))


LONG = prose(1, 30_000)


def awkward():
    """Nulls, empty and blank texts, a very long text, exact and near copies, repeated and tied rows."""
    base = prose(2, 80)
    rows = [
        row(1, None),
        row(2, ""),
        row(3, " \t\n "),
        row(4, "word"),
        row(5, "two words"),
        row(6, base),
        row(7, base.replace(" ", "  \n")),
        row(8, base.upper()),
        row(9, base + " more"),
        row(10, LONG),
        row(11, LONG + " end"),
        row(12, prose(3, 200), None, None, None),
        row(12, prose(4, 200)),
        row(13, prose(5, 200)),
        row(13, prose(5, 200)),
        row(None, prose(6, 50)),
        row(None, prose(6, 50)),
        row(None, None),
        row(14, "▁ odd  signs   🙂 <|endoftext|> 漢字 don't\x00!"),
    ]
    return rows + [row(20 + i, prose(30 + i % 7, 60)) for i in range(20)]


def table(spark, rows, schema=DOCS, parts=4):
    return spark.createDataFrame(rows, schema).repartition(parts)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def simhash(text, size=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(prints, bits=2):
    """fingerprint -> least fingerprint of its component, by comparing all pairs."""
    nodes = sorted(set(prints))
    parent = {p: p for p in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in nodes}


def contamination(text, items, window=10):
    """(words, hit words, ids of items with a window in the text) by looking at every place."""
    found, hit, of = words(text), set(), set()
    for item_id, item_text in items:
        item = words(item_text)
        size = min(window, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(found) - size + 1) if windows else ():
            if tuple(found[i : i + size]) in windows:
                hit.update(range(i, i + size))
                of.add(item_id)
    return len(found), len(hit), of
