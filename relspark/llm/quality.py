"""Quality: how much better a text compresses with a dictionary of good texts than with one of bad.

Two zstandard dictionaries are built, one from texts labelled 1 and one from texts labelled 0. A text
is cut into blocks of BLOCK bytes, so that the dictionaries count everywhere in it and a text that
repeats itself cannot serve as its own dictionary, and all blocks are compressed with each. With `prior` the mean of
the same figure over the fitted texts, the normalised size difference of the whole text is

    (bad size - good size + PSEUDO * prior) / (bad size + good size + PSEUDO)

PSEUDO bytes thus stand for what is usual, so that a text of a few bytes is not judged by chance. This one
figure goes through a rising curve (isotonic regression), fitted on labelled texts that the dictionaries were not built
from and weighted so that both labels count as often as among all labelled rows; its value is a
calibrated score. Nothing else of a text has a part in it. BLOCK, SEGMENT and PSEUDO were chosen on the fitted texts, which are outside the
held-out fold and of which the dictionaries know nothing.

The model is fitted on a bounded sample of labelled rows: PER_CLASS texts of each label, of at most
MAX_BYTES. It holds two dictionaries of at most DICTIONARY bytes and is broadcast; scoring is one
pass over whole texts without shuffle. Labels, ids and other columns never go into a score. Where the texts of a label are
too few to train a dictionary, the last DICTIONARY bytes of them are the dictionary itself.

Null text counts as empty; its score is that of the prior. Long texts are compressed whole, block by block. Equal texts have equal scores, and
each row, also a repeated one, has its own result. An id labelled twice has its greater label. Without labels of both kinds every
score is the share of label 1, or 1/2 without any label. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.labelled import fold_of, labelled_sample
from relspark.llm.rows import column, text_of

PER_CLASS = 2500
MAX_BYTES = 20_000
DICTIONARY = 1 << 16
BLOCK = 512
SEGMENT, STEP = 200, 8
PSEUDO = 64
LEVEL = 3
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    prior: float
    places: np.ndarray
    scores: np.ndarray


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or where the texts are too few for that, the texts themselves."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    size = min(DICTIONARY, sum(map(len, blocks)) // 8 + 256)
    try:
        trained = zstandard.train_dictionary(size, blocks, k=SEGMENT, d=STEP).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return trained if len(trained) > size // 4 else b"".join(blocks)[-DICTIONARY:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if content:
        options["dict_data"] = zstandard.ZstdCompressionDict(content)
    return zstandard.ZstdCompressor(level=LEVEL, **options)


def sizes(texts: list[bytes], good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Compressed bytes of each text, with the good and with the bad dictionary."""
    with_good, with_bad = compressor(good), compressor(bad)
    found = np.zeros((2, len(texts)))
    for row, text in enumerate(texts):
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            found[0, row] += len(with_good.compress(block))
            found[1, row] += len(with_bad.compress(block))
    return found[0], found[1]


def difference(good: np.ndarray, bad: np.ndarray, prior: float) -> np.ndarray:
    """The normalised size difference, higher where the good dictionary saves more."""
    return (bad - good + PSEUDO * prior) / (bad + good + PSEUDO)


def train(texts: list[bytes], labels: list[int], totals: tuple[int, int]) -> Model:
    """totals: labelled rows with label 0 and with label 1, of which the texts are a sample."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        only = float(labels[0]) if labels else 0.5
        return Model(b"", b"", 0.0, np.zeros(1), np.full(1, only))
    place = np.zeros(len(y), int)  # of a text among those of its label
    for value in (0, 1):
        place[y == value] = np.arange((y == value).sum())
    build, fit = place % 2 == 0, place % 2 == 1
    if len(set(y[fit])) < 2:  # one text of a label: both uses share it
        build = fit = np.ones(len(y), bool)
    of = {v: dictionary([t for t, b, k in zip(texts, build, y, strict=True) if b and k == v]) for v in (0, 1)}
    g, b = sizes([t for t, k in zip(texts, fit, strict=True) if k], of[1], of[0])
    y = y[fit]
    share = np.array([totals[int(v)] / max(1, (y == v).sum()) for v in y])
    share *= len(y) / share.sum()
    prior = float((share * (b - g)).sum() / max(1.0, (share * (b + g)).sum()))
    return Model(of[1], of[0], prior, *curve(difference(g, b, prior), y, share))


def curve(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differences, scores) of a rising curve: weighted isotonic regression, straight between its steps.

    The share of label 1 of a step is that of its rows and of one row more of either label, so no score is 0 or 1.
    """
    steps: list[list[float]] = []  # weight, weight of label 1, weighted sum of x
    values, number = np.unique(x, return_inverse=True)
    weight, ones = np.bincount(number, share), np.bincount(number, share * y)
    for step in zip(weight, ones, weight * values, strict=True):
        steps.append(list(step))
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    weight, ones, place = np.array(steps).T
    return place / weight, np.maximum.accumulate((ones + 1) / (weight + 2))


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Between 0 and 1, higher where label 1 is likelier."""
    x = difference(*sizes(texts, model.good, model.bad), model.prior)
    return np.interp(x, model.places, model.scores)


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    """A model of the labelled rows outside the held-out fold."""
    sizes = {"per_class": PER_CLASS, "max_bytes": MAX_BYTES} | bounds
    texts, values = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, **sizes)
    label, key = column(labels, "quality"), column(labels, "doc_id")
    known = labels.where(fold_of(key, FOLDS) != HELD_OUT).agg(
        F.count_if(label == 0).alias("zeros"), F.count_if(label == 1).alias("ones")
    )
    totals = known.first()
    return train([t.encode() for t in texts.to_pylist()], values, (totals["zeros"], totals["ones"]))


def score_of(text: Column, model: Model, spark) -> Column:
    """Score column; the model is broadcast."""
    shared = spark.sparkContext.broadcast(astuple(model))

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        raw = [t.encode() for t in texts.to_pylist()]
        return pa.array(score_texts(Model(*shared.value), raw), pa.float64())

    return scores(text)


def scored(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(<id>, held_out, score, predicted) of every row."""
    key = column(docs, id_column)
    rows = docs.select(
        key.alias(id_column),
        F.coalesce(fold_of(key, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score_of(text_of(docs, text_column), model, docs.sparkSession).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
