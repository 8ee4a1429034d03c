"""Token counts by greedy longest match, in one pass over each word and without building pieces.

The vocabulary is a trie with two roots: pieces that start a word, and pieces that go on in one. Each
node knows where to go on when no edge fits (failure link) and how many pieces of the longest match
are then complete (popped). These counts are all that is needed: a word is read character by
character, counts of popped pieces are added, and every character is looked at a constant number
of times on average. A word that cannot be cut into pieces is one unknown token.

A word is a run of letters, digits and characters beyond ASCII, or one other visible ASCII character;
ASCII white space and control characters separate words. Null text counts as empty: no words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, text_of
from relspark.llm.words import byte_table, runs, span_hashes, utf8_of

#: Words remembered per process.
MOST_WORDS = 400_000
_RUN = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
_ALONE = byte_table(lambda b: 0x20 < b < 0x7F and not chr(b).isalnum())


class Automaton:
    def __init__(self, starts: Iterable[str], others: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0: start of a word, node 1: inside one
        whole = [False, False]
        for root, pieces in ((0, starts), (1, others)):
            for piece in pieces:
                node = root
                for char in piece:
                    if char not in self.edges[node]:
                        self.edges[node][char] = len(self.edges)
                        self.edges.append({})
                        whole.append(False)
                    node = self.edges[node][char]
                whole[node] = whole[node] or bool(piece)
        self.failure, self.popped = [-1] * len(whole), [0] * len(whole)
        waiting = deque((0, 1))
        while waiting:
            above = waiting.popleft()
            for char, node in self.edges[above].items():
                waiting.append(node)
                if whole[node]:
                    self.failure[node], self.popped[node] = 1, 1
                    continue
                at, popped = self.failure[above], self.popped[above]
                while at >= 0 and char not in self.edges[at]:
                    popped += self.popped[at]
                    at = self.failure[at]
                if at >= 0:
                    self.failure[node], self.popped[node] = self.edges[at][char], popped
        self.known: dict[bytes, int] = {}

    def pieces(self, word: str) -> int:
        """Number of pieces; 0 if the word cannot be cut into pieces."""
        edges, failure, popped = self.edges, self.failure, self.popped
        node = count = 0
        for char in word:
            while (after := edges[node].get(char)) is None:
                count += popped[node]
                node = failure[node]
                if node < 0:
                    return 0
            node = after
        while node > 1:
            count += popped[node]
            node = failure[node]
        return count if node == 1 else 0

    def pieces_of(self, word: bytes) -> int:
        count = self.known.get(word)
        if count is None:
            count = self.pieces(word.decode())
            if len(self.known) < MOST_WORDS and len(word) < 64:
                self.known[word] = count
        return count


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, number of words before each text and in all)."""
    data, offsets = utf8_of(texts)
    inside, alone = _RUN[data], _ALONE[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins | alone)
    return data, starts, np.flatnonzero(closes | alone) + 1, np.searchsorted(starts, offsets)


def counts_of(texts: pa.Array, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, tokens, unknown words) of each text."""
    data, starts, ends, first = word_spans(texts)
    places, distinct = pd.factorize(span_hashes(data, starts, ends))
    one = np.zeros(len(distinct), np.int64)
    one[places[::-1]] = np.arange(len(places))[::-1]
    raw, spans = data.tobytes(), zip(starts[one].tolist(), ends[one].tolist(), strict=True)
    pieces = np.fromiter((automaton.pieces_of(raw[a:b]) for a, b in spans), np.int64, len(distinct))
    each = np.concatenate([[0], np.cumsum(np.maximum(pieces, 1)[places])])
    lost = np.concatenate([[0], np.cumsum((pieces == 0)[places])])
    return np.diff(first), np.diff(each[first]), np.diff(lost[first])


def word_pieces(model: bytes) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces inside one) of a SentencePiece vocabulary."""
    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    special = (p.is_control, p.is_unknown, p.is_byte, p.is_unused)
    pieces = [p.id_to_piece(i) for i in range(len(p)) if not any(kind(i) for kind in special)]
    starts = [x[1:] for x in pieces if x.startswith("▁") and "▁" not in x[1:] and len(x) > 1]
    return starts, [x for x in pieces if "▁" not in x]


_LOADED: dict[bytes, Automaton] = {}


def automaton_of(model: bytes) -> Automaton:
    """One per process and vocabulary."""
    if model not in _LOADED:
        _LOADED[model] = Automaton(*word_pieces(model))
    return _LOADED[model]


def token_counts(
    docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(<id>, n_words, n_tokens, n_unknown) of every row, without shuffle."""
    with open(model_file, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # a fixed file of some MB

    @F.arrow_udf("struct<n_words:long,n_tokens:long,n_unknown:long>")
    def counted(texts: pa.Array) -> pa.Array:
        automaton = automaton_of(model.value)
        parts = [counts_of(part, automaton) for _, part in runs(texts)]
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*parts, strict=True)]
        columns = columns or [np.zeros(0, np.int64)] * 3
        names = ["n_words", "n_tokens", "n_unknown"]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    key = column(docs, id_column).alias(id_column)
    return docs.select(key, counted(text_of(docs, text_column)).alias("counts")).select(id_column, "counts.*")
