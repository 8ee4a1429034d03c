"""Toxicity: a factorization machine over hashed terms of short windows, the worst window counting.

Terms of a word are the word and its first 4, 5 and 6 bytes, as 64-bit hashes. A window is WINDOW
consecutive words, or the whole text if it has fewer; there is one from every word on (stride 1), so
that terms within WINDOW words of each other always meet. With weights w and vectors v of its terms, a window's logit is

    w0 + sum w_i + sum_{i<j} <v_i, v_j>

so a pair of terms can weigh more, or less, than its parts. A text's score comes from its worst
window, so that a long text cannot dilute one. Windows of clean texts are all taken as clean in
training, of toxic texts only the one that is worst so far (the first of equals). Sums of windows
are differences of cumulative sums, so their number costs no more than that of the words. Last, the scores of the training texts
are put on a scale of probabilities (Platt).

The model is fitted on a bounded sample of labelled rows: PER_CLASS texts of each label, of at most
MAX_BYTES. Every term of three or more sampled texts has a weight and a vector, whether it goes with
the label alone or not: a pair may be toxic whose parts are in as many clean texts. A penalty on
absolute values (lasso) keeps chance out. It is given in texts: in an epoch it equals the pull of
PENALTY (VECTOR_PENALTY) wholly misjudged texts of the rarer label for a term without any link to the label, and falls
with the square of 1 + chi-square / CHI2. It holds for every batch, also for those without the term.
PENALTY, VECTOR_PENALTY and CHI2 were chosen on folds inside the training rows; the held-out fold had no part in it.
The model is bounded by the sample and is broadcast; scoring is one pass without shuffle over whole texts.

Null text counts as empty. A text without words has the score of an empty window. Equal texts have equal scores, and each row, also
a repeated one, has its own result; an id labelled twice has its greater label. Without labels of
both kinds every score is the share of label 1, or 0 without any label. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.labelled import fold_of, labelled_sample
from relspark.llm.rows import column, text_of
from relspark.llm.words import Words, runs, span_hashes, words_of

WINDOW = 48
FACTORS = 4
PREFIXES = (4, 5, 6)
PER_CLASS = 2000
MAX_BYTES = 12_000
PENALTY, VECTOR_PENALTY = 20, 60
CHI2 = 10.0
EPOCHS, STEPS = 8, 128
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """terms: sorted hashes; weights and vectors have one more row, of zeros, for unknown terms."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    scale: float
    shift: float


def word_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct word at each place, term hashes of each distinct word); 0 is no term."""
    hashes = span_hashes(words.data, words.starts, words.ends)
    places, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[places[::-1]] = np.arange(len(places))[::-1]
    starts, ends = words.starts[first], words.ends[first]
    terms = np.zeros((len(distinct), 1 + len(PREFIXES)), np.uint64)
    terms[:, 0] = distinct
    for j, size in enumerate(PREFIXES, 1):
        long = ends - starts >= size
        terms[long, j] = span_hashes(words.data, starts[long], starts[long] + size, seed=size)
    return places, terms


def sliding_windows(
    counts: np.ndarray, size: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, end) of every window of `size` words of texts of so many words.

    A shorter text is one window; a text without words has none.
    """
    number = np.where(counts > 0, np.maximum(counts - size, 0) + 1, 0)
    text = np.repeat(np.arange(len(counts)), number)
    starts = np.arange(len(text)) + np.repeat(np.cumsum(counts - number) - (counts - number), number)
    return text, starts, starts + np.minimum(counts, size)[text]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows starts:ends of a matrix, by cumulative sums."""
    sums = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[ends] - sums[starts]


def cover_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum of the rows of `values` whose span starts:ends holds it."""
    out = np.empty((n, values.shape[1]))
    for j in range(values.shape[1]):
        begun, over = (np.bincount(at, values[:, j], n + 1) for at in (starts, ends))
        out[:, j] = np.cumsum(begun - over)[:n]
    return out


def term_numbers(known: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, terms).clip(max=max(0, len(known) - 1))
    same = known[at] == terms if len(known) else np.zeros(terms.shape, bool)
    return np.where(same, at, len(known))


def word_parts(weights: np.ndarray, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """What each word adds to its windows' sums: the linear part, less its own squares, and a vector."""
    v = vectors[numbers]
    return np.column_stack([weights[numbers].sum(1) - 0.5 * (v**2).sum((1, 2)), v.sum(1)])


def span_logits(model: Model, words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logits of spans of places, summed column by column so that little is held at once."""
    places, terms = word_terms(words)
    parts = word_parts(model.weights, model.vectors, term_numbers(model.terms, terms))
    logit = np.full(len(starts), float(model.bias))
    for j, column in enumerate(parts.T):
        sums = span_sums(column[places][:, None], starts, ends)[:, 0]
        logit += 0.5 * sums**2 if j else sums
    return logit


def raw_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The greatest logit of the sliding windows of each text."""
    words = words_of(texts)
    worst = np.full(len(texts), float(model.bias))
    text, starts, ends = sliding_windows(words.counts())
    if len(text):
        logit = span_logits(model, words, starts, ends)
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        worst[text[heads]] = np.maximum.reduceat(logit, heads)
    return worst


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def platt(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of a logistic curve, fitted to softened labels by Newton steps."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    centre, width = raw.mean(), raw.std() or 1.0
    x = np.column_stack([(raw - centre) / width, np.ones_like(raw)])
    beta = np.array([0.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(50):
        p = sigmoid(x @ beta)
        slope = x.T @ (p - target) + 1e-3 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
    return float(beta[0] / width), float(beta[1] - beta[0] * centre / width)


def common_terms(
    words: Words, places: np.ndarray, terms: np.ndarray, labels: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(sorted terms of three or more texts, chi-square of the presence of each with the label)."""
    pairs = np.unique(words.text_of_word() * np.int64(len(terms)) + places)  # (text, distinct word)
    text, word = np.divmod(pairs, max(1, len(terms)))
    held, number = np.unique(terms, return_inverse=True)
    number = number.reshape(terms.shape).astype(np.int32)
    uses = text[:, None] * np.int64(max(1, len(held))) + number[word]
    text, number = np.divmod(np.unique(uses), max(1, len(held)))  # (text, term), once each
    n, ones = len(labels), labels.sum()
    having = np.bincount(number, minlength=len(held)).astype(float)
    both = np.bincount(number, labels[text], len(held))
    spread = having * (n - having) * ones * (n - ones)
    chi2 = n * (both * n - having * ones) ** 2 / np.maximum(spread, 1)
    kept = (having >= 3) & (held != 0)
    return held[kept], chi2[kept]


def shrunk(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values moved towards 0, and not beyond."""
    return np.sign(values) * np.maximum(np.abs(values) - by, 0)


def train(texts: pa.Array, labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit by AdaGrad on the logistic loss, in batches of texts: `epochs` times, and at least STEPS batches."""
    y = np.array(labels, float)
    empty = Model(np.zeros(0, np.uint64), 0.0, np.zeros(1), np.zeros((1, FACTORS)), 0.0, -50.0)
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        return empty if share == 0 else Model(*_parts(empty)[:4], 0.0, 50.0)
    words = words_of(texts)
    places, terms = word_terms(words)
    known, chi2 = common_terms(words, places, terms, y)
    numbers = term_numbers(known, terms).astype(np.int32)  # terms of each distinct word
    counts = words.counts()
    size, random = len(known) + 1, np.random.default_rng(seed)
    weights, vectors = np.zeros(size), random.normal(0, 0.01, (size, FACTORS))
    vectors[-1] = 0
    bias, rate, decay = -2.0, 0.1, 1e-5
    seen_w, seen_v, seen_b = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    share = {1: 0.5 / y.sum(), 0: 0.5 / (1 - y).sum()}
    batch, last = 0, np.zeros(size, np.int64)  # the penalty of batches without a term is made up for later
    factor = np.append(max(share.values()) / (1 + chi2 / CHI2) ** 2, 0)
    penalty_w, penalty_v = PENALTY * factor, VECTOR_PENALTY * factor[:, None]
    parts = max(1, len(y) // 200)
    for _ in range(max(epochs, -(-STEPS // parts))):
        order = random.permutation(len(y))
        for part in np.array_split(order, parts):
            text, starts, ends = sliding_windows(counts[part])
            if not len(text):
                continue
            batch += 1
            spans = [places[words.first[i] : words.first[i + 1]] for i in part]
            local, distinct = pd.factorize(np.concatenate(spans))
            at = numbers[distinct]
            sums = span_sums(word_parts(weights, vectors, at)[local], starts, ends)
            logit = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2).sum(1)
            # toxic texts: the worst window only; clean ones: every window, sharing the text's weight
            label = y[part][text]
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            sizes = np.diff(np.append(heads, len(text)))
            top = logit == np.repeat(np.maximum.reduceat(logit, heads), sizes)
            top &= np.cumsum(top) - np.repeat(np.cumsum(top)[heads] - top[heads], sizes) == 1
            weight = np.where(label == 1, top * share[1], share[0] / np.repeat(sizes, sizes)) * len(y)
            slope = (sigmoid(logit) - label) * weight / len(part)
            each = np.column_stack([slope, slope[:, None] * sums[:, 1:]])
            each = cover_sums(each, starts, ends, len(local))
            each = [np.bincount(local, column, len(distinct)) for column in each.T]
            touched, number = np.unique(at, return_inverse=True)
            number = number.ravel()
            step_w, *step_v = (
                np.bincount(number, np.repeat(column, at.shape[1]), len(touched)) for column in each
            )
            real = touched < size - 1
            touched, step_w, step_v = touched[real], step_w[real], np.column_stack(step_v)[real]
            step_v -= step_w[:, None] * vectors[touched]
            step_w += decay * weights[touched]
            step_v += decay * vectors[touched]
            seen_w[touched] += step_w**2
            seen_v[touched] += step_v**2
            pace_w, pace_v = rate / np.sqrt(seen_w[touched]), 0.3 * rate / np.sqrt(seen_v[touched])
            gone = (batch - last[touched])[:, None]
            last[touched] = batch
            weights[touched] = shrunk(weights[touched] - pace_w * step_w, pace_w * penalty_w[touched] * gone[:, 0])
            vectors[touched] = shrunk(vectors[touched] - pace_v * step_v, pace_v * penalty_v[touched] * gone)
            seen_b += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(seen_b)
    gone = (batch - last)[:, None]
    weights = shrunk(weights, rate / np.sqrt(seen_w) * penalty_w * gone[:, 0])
    vectors = shrunk(vectors, 0.3 * rate / np.sqrt(seen_v) * penalty_v * gone)
    rough = Model(known, bias, weights.astype(np.float32), vectors.astype(np.float32), 1.0, 0.0)
    scale, shift = platt(raw_scores(rough, texts), y)
    return Model(*_parts(rough)[:4], scale, shift)


def _parts(model: Model) -> tuple:
    return model.terms, model.bias, model.weights, model.vectors, model.scale, model.shift


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Between 0 and 1, higher where label 1 is likelier."""
    return sigmoid(model.scale * raw_scores(model, texts) + model.shift)


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    """A model of the labelled rows outside the held-out fold."""
    sizes = {"per_class": PER_CLASS, "max_bytes": MAX_BYTES} | bounds
    return train(*labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, **sizes))


def score_of(text: Column, model: Model, spark) -> Column:
    """Score column; the model is broadcast."""
    shared = spark.sparkContext.broadcast(_parts(model))

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        found = [score_texts(model, part) for _, part in runs(texts)]
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

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


def without_toxic(
    docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows whose score is below the threshold, with their columns."""
    score = score_of(text_of(docs, text_column), model, docs.sparkSession)
    return docs.where(score < threshold)
