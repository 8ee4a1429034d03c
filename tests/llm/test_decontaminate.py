import random
from collections import Counter

import numpy as np
import pytest
from cases import DOCS, ITEMS, LONG, awkward, contamination, prose, row, table, words

from relspark.llm import decontaminate as d


def items():
    return [
        (1, prose(100, 40)),
        (2, prose(100, 40)),
        (3, prose(101, 9)),
        (4, prose(102, 1) + " Zq"),
        (5, None),
        (6, " .,! "),
        (7, prose(103, 10)),
        (8, prose(101, 9) + " " + prose(104, 12)),
        (9, "solo"),
        (10, " ".join(LONG.split()[20_000:20_030])),
    ]


def planted():
    text = {i: t for i, t in items()}
    w = text[1].split()
    return awkward() + [
        row(200, "before it " + ", ".join(w[5:15]).upper() + "! after"),
        row(201, " ".join(w[5:14])),  # one word short of a window
        row(202, " ".join(w[:12] + ["gap"] + w[12:30])),
        row(203, text[3]),
        row(204, "so " + text[4] + " so " + text[4]),
        row(205, text[7] + " " + text[7]),
        row(206, "solo voice"),
        row(207, " ".join(w[30:] + w[:10])),
        row(208, text[8]),
        row(208, " ".join(w)),
    ]


def check(spark, docs, given, window=10, gram=5):
    known = [(i, t) for i, t, *_ in given]
    found = d.contamination(table(spark, docs), table(spark, given, ITEMS), window=window, gram=gram).collect()
    expected = Counter()
    for r in docs:
        n, hit, of = contamination(r[1], known, window)
        of = sorted(str(i) for i in of if i is not None)
        expected[r[0], n, hit, len(of), tuple(of)] += 1
    assert Counter((r.id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in found) == expected
    return found


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (6, 3), (10, 10)])
def test_like_brute_force(spark, window, gram):
    given = [(*i, "x") for i in items()]
    found = check(spark, planted(), given, window, gram)
    assert any(r.n_hit for r in found) and any(not r.n_hit for r in found)
    for r in found:
        covered = {p for s in r.spans for p in range(s["from"], s["to"])}
        assert len(covered) == r.n_hit


def test_null_item_ids_hit_but_are_not_counted(spark):
    found = check(spark, planted(), [(None, items()[0][1], "x")])
    assert any(r.n_hit and not r.n_items for r in found)


def test_few_different_words(spark):
    """Many ties among the hashes and repeated windows."""
    r = random.Random(4)
    docs = [row(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(60)]
    given = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 25))), "x") for i in range(15)]
    check(spark, docs, given)


def test_clean_documents_stay(spark):
    given = [(*i, "x") for i in items()]
    docs = planted()
    got = d.without_contaminated(table(spark, docs), table(spark, given, ITEMS))
    assert got.schema == DOCS
    expected = Counter(r for r in docs if not contamination(r[1], items())[1])
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_empty_tables(spark):
    given = table(spark, [(*i, "x") for i in items()], ITEMS)
    assert d.contamination(table(spark, []), given).count() == 0
    found = d.contamination(table(spark, planted()), table(spark, [], ITEMS)).collect()
    assert len(found) == len(planted()) and not any(r.n_hit for r in found)


def test_each_window_keeps_the_same_grams_wherever_it_stands():
    r = np.random.default_rng(1)
    for _ in range(50):
        window = r.integers(0, 3, 10).astype(np.uint64)
        kept = []
        for _ in range(2):
            left, right = r.integers(0, 5, r.integers(0, 9)), r.integers(0, 5, r.integers(0, 9))
            text = np.concatenate([left, window, right]).astype(np.uint64)
            grams = d.gram_hashes(text * np.uint64(0x9E3779B97F4A7C15), 5)
            at = d.winnowed(grams, np.zeros(len(text), int), 10, 5)
            inside = at[(at >= len(left)) & (at <= len(left) + 5)] - len(left)
            least = grams[len(left) : len(left) + 6].min()
            kept.append({int(i) for i in inside if grams[len(left) + i] == least})
        assert kept[0] and kept[0] == kept[1]


def test_words_are_cut_like_the_pattern(spark):
    from relspark.llm.words import words_of
    import pyarrow as pa

    texts = [r[1] for r in awkward()]
    found = words_of(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert [found.word(k) for k in range(found.first[i], found.first[i + 1])] == words(text)


def test_one_passage_in_many_items_and_documents(spark):
    """Equal surroundings are one class; items that hold the passage elsewhere are others. All are listed."""
    passage = prose(700, 30)
    given = [(i, passage, "x") for i in range(40)] + [(100 + i, prose(800 + i, 12) + " " + passage, "x") for i in range(5)]
    docs = [row(i, prose(900 + i, 5) + " " + passage) for i in range(50)] + [row(60, prose(990, 40)), row(61, prose(801, 12))]
    found = check(spark, docs, given)
    assert sum(r.n_items == 45 for r in found) == 50
