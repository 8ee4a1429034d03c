"""Main text of web pages: a bidirectional LSTM in numpy labels every leaf block of a page.

A page is cut into leaf blocks. For each the network reads a vector of its tag path (names of the
elements above it and words of their classes and ids, hashed), a vector of its words (hashed), and a
few figures (length, share of links, punctuation, place in the page). One LSTM reads the blocks of a
page forwards, one backwards, so each decision rests on the whole page. Blocks labelled 1 are joined by
newlines; their texts are never changed or cut.

Pages carry no labels. The network learns from PAGES pages at most, of at most MAX_BYTES each (those
with the least hash of their id), whose blocks are labelled by the names of the elements around them,
and from variants made of them: other containers of the article, and menus, sidebars, notices,
adverts, forms and readers' comments put in, with texts from other pages. Names are left out at
random, so that the network has to use words, lengths and what stands around a block too.

The model has a fixed size and is broadcast; extraction is one pass without shuffle. Null html counts as
empty: empty text. A page without main text has the empty text. Broken markup is read as far as it goes, in time
linear in the page; a very long page is taken whole. Repeated rows and ids get a result each. An empty
table gives an empty result. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.html_blocks import Block, Trail, blocks_of
from relspark.llm.rows import column, text_of
from relspark.llm.words import runs, span_hashes, words_of

PAGES = 200
MAX_BYTES = 60_000
VARIANTS = 3
PATH_SIZE, WORD_SIZE, HIDDEN = 256, 32, 16
EPOCHS, BATCH, RATE = 7, 24, 0.02
#: Blocks whose inputs are worked out at once, and pages read side by side.
STRETCH, TOGETHER = 4096, 64

#: Words of classes, ids and tags that mark what is not the article.
ASIDE = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal overlay"
    " newsletter subscribe signup comment comments reply respond sidebar widget menu nav navigation navbar"
    " breadcrumb breadcrumbs header masthead footer copyright related recommended share social toolbar"
    " pagination search login form aside dialog button fieldset".split()
)


# --- inputs of the network -------------------------------------------------------------------


def name_slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_SIZE


def slots_of(path: Iterable[str]) -> int:
    """The slots of the names on a path, as bits; a trail remembers its own and those above."""
    if not isinstance(path, Trail):
        path = Trail(tuple(path), None)
    links = []
    trail = path
    while trail is not None and trail.slots is None:
        links.append(trail)
        trail = trail.above
    bits = trail.slots if trail else 0
    for trail in reversed(links):
        for name in trail.names:
            bits |= 1 << name_slot(name)
        trail.slots = bits
    return bits


def slot_vector(slots: int) -> np.ndarray:
    packed = np.frombuffer(slots.to_bytes(PATH_SIZE // 8, "little"), np.uint8)
    return np.unpackbits(packed, bitorder="little").astype(np.float32)


def path_vector(path: Iterable[str]) -> np.ndarray:
    return slot_vector(slots_of(path))


def figure_vectors(blocks: list[Block]) -> np.ndarray:
    """Hashed words and figures of each block."""
    texts = pa.array([b.text for b in blocks], pa.string())
    words = words_of(texts)
    counts = words.counts()
    slot = span_hashes(words.data, words.starts, words.ends) % np.uint64(WORD_SIZE)
    flat = words.text_of_word() * WORD_SIZE + slot.astype(np.int64)
    hashed = np.bincount(flat, minlength=len(blocks) * WORD_SIZE).reshape(len(blocks), WORD_SIZE)
    size = np.array([len(b.text) for b in blocks], float)
    marks = np.array([b.text.count(".") + b.text.count(",") for b in blocks], float)
    figures = [
        np.log1p(counts) / 5,
        np.minimum(1, np.array([b.links for b in blocks]) / np.maximum(1, size)),
        marks / np.maximum(1, counts),
        np.arange(len(blocks)) / max(1, len(blocks)),
        np.array([any(c in b.text for c in "©®") for b in blocks], float),
    ]
    return np.column_stack([hashed / np.maximum(1, counts)[:, None], *figures]).astype(np.float32)


FIGURES = WORD_SIZE + 5


# --- the network -----------------------------------------------------------------------------


@dataclass
class Model:
    """For each direction: weights of path, figures, state and bias to the four gates; then the output."""

    path: list[np.ndarray]
    figure: list[np.ndarray]
    state: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.path, *self.figure, *self.state, *self.bias, self.out, self.out_bias]


def new_model(seed: int = 5) -> Model:
    r = np.random.default_rng(seed)

    def weights(rows: int, scale: float) -> list[np.ndarray]:
        return [r.normal(0, scale, (rows, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]

    bias = [np.zeros(4 * HIDDEN, np.float32) for _ in range(2)]
    for b in bias:
        b[HIDDEN : 2 * HIDDEN] = 1  # remember at first
    out = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
    parts = weights(PATH_SIZE, 0.15), weights(FIGURES, 0.15), weights(HIDDEN, 0.2)
    return Model(*parts, bias, out, np.zeros(1, np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(gates: np.ndarray, state: np.ndarray, mask: np.ndarray):
    """States of all steps of (steps, pages, 4 * HIDDEN) inputs; padded steps keep the state."""
    steps, pages, _ = gates.shape
    h = c = np.zeros((pages, HIDDEN), np.float32)
    kept, hidden = [], np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = gates[t] + h @ state
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[t][:, None]
        new = f * c + i * g
        th = np.tanh(new)
        kept.append((h, c, i, f, o, g, th))
        c, h = np.where(m, new, c), np.where(m, o * th, h)
        hidden[t] = h
    return hidden, kept


def lstm_back(into: np.ndarray, kept: list, state: np.ndarray, mask: np.ndarray):
    """Slopes of the inputs and of the state weights, from those of the states."""
    steps, pages, _ = into.shape
    slopes = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    d_state = np.zeros_like(state)
    dh = dc = np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th = kept[t]
        m = mask[t][:, None]
        dh = dh + into[t]
        d_new = np.where(m, dc + dh * o * (1 - th**2), 0)
        parts = (d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(m, dh, 0) * th * o * (1 - o), d_new * i * (1 - g**2))
        slopes[t] = np.concatenate(parts, axis=1)
        d_state += h.T @ slopes[t]
        dh = slopes[t] @ state.T + np.where(m, 0, dh)
        dc = d_new * f + np.where(m, 0, dc)
    return slopes, d_state


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, ...) of arrays of different lengths, and which steps there are."""
    steps = max(map(len, parts))
    out = np.zeros((steps, len(parts), *parts[0].shape[1:]), np.float32)
    mask = np.zeros((steps, len(parts)), bool)
    for i, part in enumerate(parts):
        out[: len(part), i] = part
        mask[: len(part), i] = True
    return out, mask


def both_ways(model: Model, gates: list[list[np.ndarray]]):
    """Logits of (steps, pages), the mask, and what each direction kept."""
    sides = []
    for d in range(2):
        inputs, mask = padded([g[::-1] if d else g for g in gates[d]])
        sides.append((*lstm(inputs, model.state[d], mask), mask))
    forward, mask = sides[0][0], sides[0][2]
    # the backward states come in reversed order, page by page
    lengths = mask.sum(0)
    turned = np.clip(lengths[None, :] - 1 - np.arange(len(mask))[:, None], 0, None)
    backward = sides[1][0][turned, np.arange(mask.shape[1])[None, :]]
    states = np.concatenate([forward, backward], axis=2)
    return states @ model.out + model.out_bias[0], mask, states, turned, sides


def label_blocks(model: Model, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    flat = [b for page in pages for b in page]
    known: dict[int, list[np.ndarray]] = {}
    gates = [np.empty((len(flat), 4 * HIDDEN), np.float32) for _ in range(2)]
    ends = np.cumsum([0, *map(len, pages)])
    place = np.concatenate([np.zeros(0), *(np.arange(len(p)) / max(1, len(p)) for p in pages)])
    for a in range(0, len(flat), STRETCH):
        some = flat[a : a + STRETCH]
        figures = figure_vectors(some)
        figures[:, WORD_SIZE + 3] = place[a : a + STRETCH]
        slots = [slots_of(b.path) for b in some]
        for bits in slots:
            if bits not in known:
                vector = slot_vector(bits)
                known[bits] = [vector @ w for w in model.path]
        for d in range(2):
            paths = np.stack([known[bits][d] for bits in slots])
            gates[d][a : a + STRETCH] = paths + figures @ model.figure[d] + model.bias[d]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    full = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(full):  # pages of about one length are read side by side
        group = [full[at]]
        while at + len(group) < len(full) and len(group) < TOGETHER:
            longest = len(pages[full[at + len(group)]])
            if longest * (len(group) + 1) > max(STRETCH, longest):
                break
            group.append(full[at + len(group)])
        parts = [[g[ends[i] : ends[i + 1]] for i in group] for g in gates]
        logits = both_ways(model, parts)[0]
        for column_number, i in enumerate(group):
            out[i] = logits[: len(pages[i]), column_number] > 0
        at += len(group)
    return out


# --- what it learns from ---------------------------------------------------------------------


def named_label(block: Block) -> int:
    """0 if an element around the block has a name that marks what is not the article."""
    return int(not any(re.sub(r"[^a-z0-9]", "", name) in ASIDE for name in block.path))


_ARTICLE = [
    (), ("<article>",), ("<main>",), ("<main>", "<article>"), ("<div>", ".content"), ("<div>", ".post", "<div>", ".entry", ".content"),
    ("<section>", ".article", ".body"), ("<div>", ".story"), ("<div>", ".main", "<div>", ".text"), ("<div>",), ("<article>", "<section>"),
    ("<table>", "<tr>", "<td>", ".content"), ("<div>", ".page", "<main>", "@main"), ("<div>", ".container", "<article>", ".post"),
]
_MENUS = [
    ("<nav>", "<ul>", "<li>"), ("<div>", ".menu", "<ul>", "<li>"), ("<ul>", ".navbar", "<li>"), ("<div>", ".breadcrumbs"),
    ("<header>", "<nav>", "<ul>", "<li>"), ("<div>", "@navigation", "<ul>", "<li>"), ("<menu>", "<li>"),
]
_TOPS = [("<header>",), ("<div>", ".header"), ("<div>", ".masthead"), ("<header>", ".site", ".header", "<p>"), ("<div>", "@banner")]
_FEET = [("<footer>",), ("<div>", ".footer"), ("<footer>", "<p>"), ("<div>", ".copyright"), ("<div>", "@contentinfo"), ("<footer>", "<ul>", "<li>")]
_SIDES = [("<aside>",), ("<aside>", "<p>"), ("<div>", ".sidebar"), ("<div>", ".sidebar", "<div>", ".widget", "<p>"), ("<aside>", "<ul>", "<li>"), ("<section>", ".related", "<ul>", "<li>"), ("<div>", "@complementary", "<p>")]
_NOTICES = [("<div>", ".cookie", ".notice"), ("<div>", ".cookie", ".banner", "<p>"), ("<div>", ".consent"), ("<div>", ".alert"), ("<dialog>",), ("<div>", ".notice"), ("<div>", ".newsletter", "<p>"), ("<div>", ".popup"), ("<div>", "@alert"), ("<section>", ".notice", "<p>"), ("<div>", "@dialog", "<p>")]
_ADVERTS = [("<div>", ".ad"), ("<div>", ".ads"), ("<div>", ".advert"), ("<div>", ".advertisement", "<p>"), ("<div>", ".promo"), ("<div>", ".sponsored"), ("<aside>", ".ad"), ("<section>", ".banner", "<p>")]
_FORMS = [("<form>",), ("<form>", "<p>"), ("<form>", "<div>"), ("<div>", ".login", "<form>", "<fieldset>"), ("<div>", ".search", "<form>"), ("<form>", ".signup", "<div>")]
_COMMENTS = [("<section>", ".comments", "<p>"), ("<div>", ".comments", "<div>", ".comment", "<p>"), ("<ol>", ".comment", ".list", "<li>", ".comment", "<p>"), ("<section>", ".comments", "<article>", ".comment", "<p>"), ("<div>", ".comment"), ("<ul>", ".comments", "<li>"), ("<div>", ".respond", "<p>"), ("<div>", ".replies", ".reply", "<p>")]


def variant(page: list[Block], labels: list[int], texts: list[str], r: random.Random) -> tuple[list[Block], list[int]]:
    """The page's article in another container, among other things; texts: of other pages."""

    if r.random() < 0.1:  # a bare text
        text = r.choice([b.text for b, y in zip(page, labels, strict=True) if y] or texts)
        return [Block(r.choice(((), ("<p>",), ("<html>", "<body>", "<p>"))), text, 0)], [1]

    def some_text() -> str:
        words = r.choice(texts).split()
        at, n = r.randrange(len(words)), r.choice((1, 2, 3, 5, 8, 12, 20, 40, 80))
        return " ".join(words[at : at + n])

    def things(kinds: list[tuple[str, ...]], most: int, linked: float, inside: tuple[str, ...] = ()) -> list[Block]:
        path = (*base, *inside, *r.choice(kinds))
        found = []
        for _ in range(r.randint(1, most)):
            text = some_text()
            found.append(Block(path, text, len(text) if r.random() < linked else 0))
        return found

    base = r.choice((("<html>", "<body>"), ("<html>", "<body>"), ("<body>",), ()))
    holder = r.choice(_ARTICLE)
    article = [b for b, y in zip(page, labels, strict=True) if y]
    body = []
    for b in article:
        leaf = tuple(n for n in b.path[-1:] if n.startswith("<") and n not in ("<article>", "<body>"))
        leaf = leaf if r.random() < 0.8 else (r.choice(("<p>", "<h2>", "<h3>", "<blockquote>", "<li>", "<pre>", "<div>", "<td>", "<figcaption>")),)
        body.append(Block((*base, *holder, *leaf), b.text if r.random() < 0.7 else some_text(), 0 if r.random() < 0.9 else len(b.text) // 3))
    top, end = [], []
    for chance, where, made in (
        (0.5, top, lambda: things(_TOPS, 3, 0.3)),
        (0.8, top, lambda: things(_MENUS, 8, 0.95)),
        (0.4, top, lambda: things(_NOTICES, 2, 0.1)),
        (0.4, top, lambda: things(_ADVERTS, 2, 0.3)),
        (0.3, top, lambda: things(_SIDES, 5, 0.4)),
        (0.2, top, lambda: things(_FORMS, 3, 0.0)),
        (0.4, end, lambda: things(_COMMENTS, 8, 0.0)),
        (0.3, end, lambda: things(_COMMENTS, 4, 0.0, holder)),
        (0.4, end, lambda: things(_SIDES, 6, 0.4)),
        (0.3, end, lambda: things(_FORMS, 4, 0.0)),
        (0.3, end, lambda: things(_ADVERTS, 2, 0.3)),
        (0.3, end, lambda: things(_NOTICES, 2, 0.1)),
        (0.8, end, lambda: things(_FEET, 4, 0.4)),
    ):
        if r.random() < chance:
            where.extend(made())
    made, truth = list(body), [1] * len(body)
    for kinds in (_ADVERTS, _SIDES, _NOTICES, _FORMS, _MENUS):
        if made and r.random() < 0.2:
            at, inner = r.randrange(len(made)), things(kinds, 2, 0.3, holder)
            made[at:at], truth[at:at] = inner, [0] * len(inner)
    return [*top, *made, *end], [0] * len(top) + truth + [0] * len(end)


def forgetful(block: Block, r: random.Random) -> Block:
    """The block with some names of its path left out."""
    if r.random() < 0.7:
        return block
    return Block(tuple(n for n in block.path if r.random() < 0.9), block.text, block.links)


def train(pages: list[str], seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Fit by Adam on the mean logistic loss of the blocks."""
    model, r = new_model(seed), random.Random(seed)
    given = [[Block(tuple(b.path), b.text, b.links) for b in blocks_of(p)] for p in pages]
    known = [(b, [named_label(x) for x in b]) for b in given if b]
    texts = [x.text for b, y in known for x, k in zip(b, y, strict=True) if k and " " in x.text]
    if not texts:
        model.out[:], model.out_bias[0] = 0, 1  # nothing to learn from: all blocks are text
        return model
    cases = list(known)
    for b, y in known:
        cases += [variant(b, y, texts, r) for _ in range(VARIANTS)]
    cases = [(b, y) for b, y in cases if b]
    inputs = []
    for b, y in cases:
        b = [forgetful(x, r) for x in b]
        paths = np.stack([path_vector(x.path) for x in b])
        inputs.append((paths, figure_vectors(b), np.array(y, np.float32)))
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in model.arrays()]
    step = 0
    for epoch in range(epochs):
        order = sorted(range(len(inputs)), key=lambda i: (len(inputs[i][2]) // 8, r.random()))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        r.shuffle(batches)
        for batch in batches:
            step += 1
            part = [inputs[i] for i in batch]
            slopes = slopes_of(model, part)
            rate = RATE * min(1, 2 * (1 - epoch / epochs))
            for a, g, (m, v) in zip(model.arrays(), slopes, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + rate * 1e-4 * a
    return model


def slopes_of(model: Model, part: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Slopes of the loss of some pages, in the order of Model.arrays()."""
    gates = [[p @ model.path[d] + f @ model.figure[d] + model.bias[d] for p, f, _ in part] for d in range(2)]
    logits, mask, states, turned, sides = both_ways(model, gates)
    truth = padded([y for _, _, y in part])[0]
    error = np.where(mask, sigmoid(logits) - truth, 0).astype(np.float32) / mask.sum()
    d_out = np.einsum("tp,tph->h", error, states)
    d_states = error[:, :, None] * model.out
    d_path, d_figure, d_state, d_bias = [], [], [], []
    columns = np.broadcast_to(np.arange(mask.shape[1]), mask.shape)
    for d in range(2):
        into = d_states[:, :, d * HIDDEN : (d + 1) * HIDDEN]
        if d:
            moved = np.zeros_like(into)
            np.add.at(moved, (turned[mask], columns[mask]), into[mask])
            into = moved
        slopes, of_state = lstm_back(into, sides[d][1], model.state[d], sides[d][2])
        each = [slopes[: len(y), i] for i, (_, _, y) in enumerate(part)]
        each = [s[::-1] for s in each] if d else each
        d_path.append(sum(p.T @ s for (p, _, _), s in zip(part, each, strict=True)))
        d_figure.append(sum(f.T @ s for (_, f, _), s in zip(part, each, strict=True)))
        d_state.append(of_state)
        d_bias.append(sum(s.sum(0) for s in each))
    return [*d_path, *d_figure, *d_state, *d_bias, d_out, np.array([error.sum()], np.float32)]


# --- Spark -----------------------------------------------------------------------------------


def main_texts(model: Model, pages: list[str]) -> list[str]:
    found = [blocks_of(p) for p in pages]
    chosen = label_blocks(model, found)
    return [
        "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)
        for blocks, keep in zip(found, chosen, strict=True)
    ]


def fit(
    pages: DataFrame, id_column: str = "page_id", html_column: str = "html", most: int = PAGES, max_bytes: int = MAX_BYTES
) -> Model:
    """A model of at most `most` pages of at most max_bytes each.

    The pages are chosen by place first, so that only theirs travel; of one place one page is taken.
    """
    page = text_of(pages, html_column).alias("page")
    place = F.xxhash64(column(pages, id_column)).alias("place")
    sizes = pages.select(place, page).where(F.octet_length("page") <= max_bytes)
    chosen = sizes.groupBy("place").agg(F.lit(1).alias("one")).orderBy("place").limit(most).drop("one")
    found = sizes.join(F.broadcast(chosen), "place").groupBy("place").agg(F.min("page").alias("page"))
    rows = sorted(found.collect())  # at most `most` rows
    return train([r["page"] for r in rows])


def main_text_of(html: Column, model: Model, spark) -> Column:
    """Main text column; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        texts: list[str] = []
        for _, part in runs(pages):
            texts += main_texts(shared.value, part.to_pylist())
        return pa.array(texts, pa.string())

    return extracted(html)


def extracted_pages(
    pages: DataFrame, model: Model, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(<id>, <url>, text, n_chars) of every page."""
    text = main_text_of(text_of(pages, html_column), model, pages.sparkSession)
    rows = pages.select(
        column(pages, id_column).alias(id_column), column(pages, url_column).alias(url_column), text.alias("text")
    )
    return rows.withColumn("n_chars", F.length("text").cast("long"))
