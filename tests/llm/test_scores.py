import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from cases import DOCS, awkward, prose, row, table

from relspark.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int, score string"


def labelled(n, seed=0):
    """Texts whose label is told by single words, or by two words together."""
    r, docs, labels = random.Random(seed), [], []
    for i in range(n):
        w, toxic = prose(seed * 10_000 + i, r.randint(5, 300)).split(), int(r.random() < 0.25)
        if toxic:
            w[r.randrange(len(w))] = r.choice(("grubman", "grubwife", "snarl"))
        good = int(r.random() < 0.7)
        text = " ".join(w) if good else " ".join(f"{x}$$$ |" for x in w)
        docs.append(row(i, text))
        labels.append((i, good, toxic, "x"))
    return docs, labels


@pytest.mark.parametrize(
    ("operator", "folds", "held_out", "column", "share"),
    [(toxicity, 4, 2, 2, 0.97), (quality, 3, 1, 1, 0.97)],
)
def test_held_out_accuracy(spark, operator, folds, held_out, column, share):
    docs, labels = labelled(700)
    given = table(spark, docs + awkward())
    model = operator.fit(given, spark.createDataFrame(labels, LABELS))
    got = operator.scored(given, model).collect()
    assert len(got) == len(docs) + len(awkward())
    truth, right, seen = {k[0]: k[column] for k in labels}, 0, 0
    for r in got:
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= operator.THRESHOLD)
        apart = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held_out
        assert r.held_out == apart
        if apart and r.doc_id >= 100:
            seen += 1
            right += r.predicted == truth[r.doc_id]
    assert seen > 100 and right / seen >= share


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(200)
    given = table(spark, docs)
    for operator, folds, held_out in ((toxicity, 4, 2), (quality, 3, 1)):
        turned = [
            (i, 1 - q, 1 - t, x) if zlib.crc32(str(i).encode()) % folds == held_out else (i, q, t, x)
            for i, q, t, x in labels
        ]
        scores = []
        for some in (labels, turned):
            model = operator.fit(given, spark.createDataFrame(some, LABELS))
            found = operator.scored(given, model).collect()
            scores.append({r.doc_id: round(r.score, 3) for r in found})
        assert scores[0] == scores[1]


@pytest.mark.parametrize("operator", [toxicity, quality])
@pytest.mark.parametrize("labels", [[], [(1, 1, 1, "x")], [(1, None, None, "x"), (None, 1, 1, "x")], [(1, 0, 0, "x"), (1, 1, 1, "x")]])
def test_too_few_labels(spark, operator, labels):
    given = table(spark, awkward())
    model = operator.fit(given, spark.createDataFrame(labels, LABELS))
    found = operator.scored(given, model).collect()
    assert len(found) == len(awkward()) and len({round(r.score, 6) for r in found}) == 1


def test_empty_tables(spark):
    empty, labels = table(spark, []), spark.createDataFrame([], LABELS)
    for operator in (toxicity, quality):
        assert operator.scored(empty, operator.fit(empty, labels)).count() == 0


def test_toxic_documents_go_and_columns_stay(spark):
    docs, labels = labelled(500, 1)
    given = table(spark, docs)
    model = toxicity.fit(given, spark.createDataFrame(labels, LABELS))
    left = toxicity.without_toxic(given, model)
    assert left.schema == DOCS
    toxic = {k[0] for k in labels if k[2]}
    stay = {r.doc_id for r in left.collect()}
    assert len(stay & toxic) <= 0.03 * len(toxic)
    assert len(stay - toxic) >= 0.99 * (len(docs) - len(toxic))


def test_pairs_count_beyond_their_parts():
    """Two words that are harmless alone: only their meeting is toxic, which no linear weights tell."""
    r, texts, labels = random.Random(5), [], []
    for i in range(800):
        w, kind = prose(i, 30).split(), i % 4
        if kind in (1, 3):
            w[3] = "zorg"
        if kind in (2, 3):
            w[7] = "blit"
        r.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(kind == 3))
    model = toxicity.train(pa.array(texts), labels, epochs=20)
    scores = toxicity.score_texts(model, pa.array(["zorg an", "an blit", "an on", "zorg an blit"]))
    assert scores[3] > 0.5 > scores[:3].max()


def test_a_long_clean_part_does_not_hide_a_toxic_one():
    docs, labels = labelled(600, 2)
    model = toxicity.train(pa.array([d[1] for d in docs]), [k[2] for k in labels])
    clean = prose(99, 20_000)
    scores = toxicity.score_texts(model, pa.array([clean, clean + " grubman " + clean, "", None]))
    assert scores[1] > 0.3 > scores[0]
    assert scores[2] == scores[3] < 0.3


def met_pairs(n, places):
    """Texts of 130 words in which "zorg" and "blit" stand alone or, if toxic, at the given places."""
    texts, labels = [], []
    for i in range(n):
        w, kind = prose(i, 130).split()[:130], i % 4
        if kind in (1, 3):
            w[places[0]] = "zorg"
        if kind in (2, 3):
            w[places[1]] = "blit"
        texts.append(" ".join(w))
        labels.append(int(kind == 3))
    return texts, labels


@pytest.mark.parametrize("first", [10, 46, 47, 95])
def test_a_pair_is_caught_wherever_it_stands(first):
    """Training and scoring alike: places 47 and 48 lie on both sides of a border of windows laid end to end."""
    texts, labels = met_pairs(800, (47, 48))
    model = toxicity.train(pa.array(texts), labels, epochs=20)
    found, kinds = met_pairs(8, (first, first + 1))
    scores = toxicity.score_texts(model, pa.array(found))
    assert scores[[k == 1 for k in kinds]].min() > 0.5 > scores[[k == 0 for k in kinds]].max()


def test_the_worst_of_all_windows_counts():
    texts = pa.array([prose(1, 10), "", prose(2, 150), prose(3, 48), prose(4, 49)])
    words = toxicity.words_of(texts)
    places, terms = toxicity.word_terms(words)
    known = np.unique(terms[terms != 0])
    r = np.random.default_rng(1)
    weights, vectors = r.normal(size=len(known) + 1), r.normal(size=(len(known) + 1, 4))
    weights[-1], vectors[-1] = 0, 0
    model = toxicity.Model(known, 0.5, weights, vectors, 1.0, 0.0)
    for i, score in enumerate(toxicity.raw_scores(model, texts)):
        a, b = words.first[i : i + 2]
        worst = []
        for start in range(a, max(a, b - toxicity.WINDOW) + 1):
            used = toxicity.term_numbers(known, terms[places[start : min(b, start + toxicity.WINDOW)]])
            v, w = vectors[used.ravel()], weights[used.ravel()]
            worst.append(0.5 + w.sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))
        assert score == pytest.approx(max(worst))


def test_a_pair_counts_whose_parts_have_no_link_to_the_label():
    """Both words are in half of the texts of either label; so no test of a single term can find them."""

    def made(n, seed):
        r, texts = random.Random(seed), []
        for i in range(n):
            w, kind = prose(seed * 100_000 + i, r.randint(30, 120)).split(), i % 4
            at = r.randrange(len(w) - 5)
            for place, word in (((0, "zorg"), (3, "blit")), ((0, "grubman"),), ((0, "zorg"),), ((0, "blit"),))[kind]:
                w[at + place] = word
            texts.append(" ".join(w))
        return pa.array(texts), np.arange(n) % 4

    texts, kind = made(1600, 1)
    for word in ("zorg", "blit"):
        having = np.array([word in x.as_py().split() for x in texts])
        assert having[kind < 2].mean() == having[kind >= 2].mean()
    model = toxicity.train(texts, (kind < 2).astype(int).tolist())
    texts, kind = made(800, 2)
    found = toxicity.score_texts(model, texts) >= toxicity.THRESHOLD
    assert found[kind < 2].mean() > 0.95 and found[kind >= 2].mean() < 0.05


def test_a_term_of_few_toxic_texts_counts():
    """In 20 of 400 toxic texts and no clean one; the other toxic texts have another word."""
    texts, labels = [], []
    for i in range(800):
        w, toxic = prose(i, 60).split(), i % 2
        if toxic:
            w[20] = "snarl" if i % 40 == 1 else "grubman"
        texts.append(" ".join(w))
        labels.append(toxic)
    assert sum("snarl" in x.split() for x in texts) == 20
    model = toxicity.train(pa.array(texts), labels)
    scores = toxicity.score_texts(model, pa.array([prose(5000, 60), prose(5000, 60) + " snarl"]))
    assert scores[1] >= toxicity.THRESHOLD > scores[0]


def test_quality_is_the_size_difference_alone(spark):
    """Each text compressed by itself, block by block, then one straight line between two points of the curve."""
    docs, labels = labelled(300, 3)
    given = table(spark, docs + awkward())
    model = quality.fit(given, spark.createDataFrame(labels, LABELS))
    packers = [
        zstandard.ZstdCompressor(
            level=quality.LEVEL,
            dict_data=zstandard.ZstdCompressionDict(d),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        for d in (model.good, model.bad)
    ]
    texts = [text for _, text, *_ in docs + awkward()]
    expected = []
    for text in texts:
        raw, size = (text or "").encode(), quality.BLOCK
        good, bad = (sum(len(p.compress(raw[i : i + size])) for i in range(0, len(raw), size)) for p in packers)
        x = (bad - good + quality.PSEUDO * model.prior) / (bad + good + quality.PSEUDO)
        if x <= model.places[0] or x >= model.places[-1]:
            expected.append(model.scores[0 if x <= model.places[0] else -1])
            continue
        k = next(i for i in range(len(model.places)) if model.places[i] > x)
        a, b = model.places[k - 1 : k + 1]
        expected.append(model.scores[k - 1] + (model.scores[k] - model.scores[k - 1]) * (x - a) / (b - a))
    got = sorted(r.score for r in quality.scored(given, model).collect())
    assert got == pytest.approx(sorted(expected))


def test_the_curve_rises_and_keeps_the_shares():
    r = np.random.default_rng(3)
    x, share = r.normal(size=400), np.ones(400)
    y = (r.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float)
    places, scores = quality.curve(x, y, share)
    assert (np.diff(places) > 0).all() and (np.diff(scores) >= 0).all() and 0 < scores[0] < scores[-1] < 1
    assert np.interp(x, places, scores).mean() == pytest.approx(y.mean(), abs=0.05)
    places, scores = quality.curve(np.zeros(10), np.arange(10) % 2.0, np.ones(10))
    assert scores.tolist() == [0.5]
