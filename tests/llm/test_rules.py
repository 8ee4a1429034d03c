"""Quality rules: counts against brute force, the learner on planted thresholds, accuracy on rows not learned from."""

import random
import re

import pytest
from cases import LONG, awkward, prose, row, table
from pyspark.sql import functions as F

from relspark.llm import quality_rules as q
from relspark.llm.labelled import fold_of


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if often is None:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        often = {w for w, n in seen.items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def texts():
    r = random.Random(3)
    repeated = " ".join(r.choice(["a", "b", "c"]) for _ in range(200))
    lines = "one line\n \n\nanother\none line\n one line\none line\n\tlast"
    signs = "a#b *c* $5 50% x&y <tag> | end | 漢字漢字 🙂🙂 ß ß\x1c"
    return [None, "", " \n\t", "w", "w w", "w w w", "w w w w", repeated, lines, signs, LONG, "a b c d a b c", "x" * 100_000, *(r[1] for r in awkward())]


def test_counts(spark):
    rows = [row(i, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in q.judged(table(spark, rows), []).collect()}
    for doc_id, text, *_ in rows:
        n_words, chars, symbols, lines, repeated = counted(text)
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, lines, repeated)
        assert (r.base_failed, r.rule, r.kept) == (failed, None, not failed)


def test_a_filter_on_the_result_stays_above_it(spark):
    rows = [row(i, prose(i, 2000)) for i in range(40)]
    assert q.judged(table(spark, rows), []).where("kept AND n_repeat_words >= 0").count() == 40


def planted(n=900):
    """Bad: short letters and many signs together, or many repeated lines."""
    r, rows = random.Random(5), []
    for _ in range(n):
        values = {name: r.random() for name in q.FEATURES}
        bad = (values["letters_per_word"] < 0.4 and values["symbols_per_word"] > 0.7) or values["repeated_lines"] > 0.9
        rows.append((values, 0 if bad else 1))
    return rows


def test_covering_finds_planted_conjunctions():
    rules = q.decision_list(planted())
    named = {frozenset((c.feature, c.above) for c in rule) for rule in rules}
    assert frozenset([("repeated_lines", True)]) in named
    assert any({("letters_per_word", False), ("symbols_per_word", True)} <= n for n in named)
    fresh = planted(3000)[900:]
    wrong = sum((label == 0) != any(all(c.holds(v) for c in rule) for rule in rules) for v, label in fresh)
    assert wrong < 0.03 * len(fresh)


def test_pruning_drops_what_does_not_hold_elsewhere():
    sure, chance = q.Condition("words", True, 0.5), q.Condition("repeated_words", True, 0.5)
    rows = [({"words": 1.0, "repeated_words": i % 2}, 0) for i in range(20)]
    assert q.pruned((sure, chance), rows) == ((sure,), 20, 0)
    assert q.decision_list([]) == [] and q.decision_list(planted(10)[:2]) == []


def test_expression_is_the_list(spark):
    rules = [(q.Condition("words", True, 100.0), q.Condition("symbols_per_word", True, 0.01)), (q.Condition("words", True, 60.0),)]
    rows = [row(1, prose(1, 55)), row(2, prose(2, 80)), row(3, prose(3, 150)), row(4, prose(4, 150) + " ###" * 3), row(5, "few")]
    got = {r.doc_id: (r.rule, r.kept) for r in q.judged(table(spark, rows), rules).collect()}
    assert got == {1: (None, True), 2: (2, False), 3: (2, False), 4: (1, False), 5: (None, False)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = fold_of(F.col("doc_id"), 3) == 1
    rules = q.fit(docs, labels.where(~out))
    found = q.judged(docs, rules).where("NOT base_failed").join(labels.where(out), "doc_id")
    right, n = found.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 90 and right >= 0.97 * n


@pytest.mark.parametrize("labelled", [[], [(1, 0, None)], [(None, 1, 1), (99, 0, 1), (6, 0, 1), (6, 1, 1), (12, 1, 0)]])
def test_odd_labels_and_empty_tables(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, place int")
    docs = table(spark, awkward())
    assert q.judged(docs, q.fit(docs, labels)).count() == len(awkward())
    empty = table(spark, [])
    assert q.judged(empty, q.fit(empty, labels)).count() == 0
