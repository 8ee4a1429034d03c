"""SentencePiece ids of whole texts by a streaming Viterbi search, and texts of ids.

The search goes through the normalised text once. At each character boundary it keeps one survivor:
the last piece of the best segmentation up to there. What best means depends on the model's kind:

- unigram: the greatest sum of piece scores.
- BPE: the segmentation that merging by rank gives. It is the only one in which each piece, and each
  two neighbouring pieces alone, are merged to just themselves; so a piece may follow a survivor only
  if the two agree, and one piece fits at each boundary.

A piece has at most `longest` characters, so only the last `longest` boundaries can be continued.
When the backpointers of all of these run together in one boundary, the ids before it are final:
they are given out and forgotten. The window kept does not grow with the text.

Where two characters stand next to each other in no piece of the vocabulary, all paths meet between
them. Texts are cut there (as a rule before each word start), and each distinct cut is searched once;
ids of short ones are remembered per process, up to a bound.

Null text counts as empty; the empty text has no ids. Null ids decode to the empty text, null
members of a list are skipped. Decoding gives back every text but for what the model's normaliser
changes: with the identity normaliser only the character U+2581, which stands for a space.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.rows import column, text_of
from relspark.llm.words import runs, utf8_of

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Remembered words and agreeing pairs per process; words beyond this many bytes are searched anew.
MOST_WORDS, MOST_HEADS, MOST_PAIRS = 200_000, 10_000, 1_000_000
LONG_WORD, HEAD = 48, 6
#: Words searched side by side; from how many on that pays.
LANES, FEW = 4096, 64
#: Texts decoded at once.
TEXTS = 500
#: In place of the id of the piece before: none, at the start; of a piece: a character that has none.
START, UNKNOWN = -2, -1
#: How far below the least score a character without a piece lies.
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            if tag & 7 == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def model_kind(model: bytes) -> int:
    """Field 3 of the training settings, which are field 2 of a model; the last one counts."""
    kind = UNIGRAM
    for number, value in _fields(model):
        if number == 2:
            kind = dict(_fields(value)).get(3, kind)
    return kind


class Vocabulary:
    """The pieces of a model and the search over them."""

    def __init__(self, model: bytes):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind = model_kind(model)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are searched")
        plain = [i for i in range(len(p)) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        if any(p.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.scores = {piece: p.get_score(i) for piece, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(len(p)) if p.is_byte(i)}
        self.unknown = p.unk_id()
        written = {t.replace(SPACE, " ").encode(): i for t, i in self.ids.items()}
        self.trie = Endings(written)
        #: Whether two bytes, as 256 * first + second, are a boundary of every segmentation.
        self.apart = np.ones(1 << 16, bool)
        for piece in written:
            self.apart[[a << 8 | b for a, b in zip(piece, piece[1:], strict=False)]] = False
        second = np.arange(1 << 16) & 0xFF
        self.apart[(second & 0xC0) == 0x80] = False  # inside a character
        self.id_scores = np.zeros(len(p))
        self.id_scores[list(self.ids.values())] = list(self.scores.values())
        self.pair_keys, self.pair_fits = np.array([-1]), np.array([False])
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        raw |= {i: piece.replace(SPACE, " ").encode() for piece, i in self.ids.items()}
        raw[self.unknown] = p.decode([self.unknown]).encode()
        parts = [raw.get(i, b"") for i in range(len(p))]
        self.raw_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.raw_sizes = np.array(list(map(len, parts)))
        self.raw_at = np.cumsum(self.raw_sizes) - self.raw_sizes
        #: Every ending of a piece: the piece's id if it is one itself, else -1.
        self.tails = {piece[i:]: -1 for piece in self.ids for i in range(len(piece))}
        self.tails |= self.ids
        self.piece_of = {i: piece for piece, i in self.ids.items()}
        self.score_of = {i: self.scores[piece] for piece, i in self.ids.items()}
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, tuple[list, list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging neighbours of the best score, the first on ties."""
        known, none = self.scores.get, -np.inf
        parts = list(text)
        joined = [known(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while joined and (best := max(joined)) > none:
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = known(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = known(parts[i] + parts[i + 1], none)
        return parts

    def agrees(self, before: int, piece: int) -> bool:
        """Whether merging gives just these two pieces; before is START at the start of a text."""
        if before == UNKNOWN:
            before = START  # nothing merges with a character that has no piece
        known = self.pairs.get((before, piece))
        if known is None:
            own = self.piece_of[piece]
            first = [] if before == START else [self.piece_of[before]]
            known = self.merged("".join(first) + own) == [*first, own]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[before, piece] = known
        return known

    def candidates(self, text: str, end: int, low: int) -> list[tuple[int, int]]:
        """(start, id) of the pieces that end at `end` and start at `low` or later, shortest first."""
        tails, found = self.tails, []
        for start in range(end - 1, low - 1, -1):
            own = tails.get(text[start:end])
            if own is None:
                break
            if own >= 0:
                found.append((start, own))
        return found

    def survivor(self, found: list[tuple[int, int]], end: int, last, score) -> tuple[int, int, float]:
        """(start, id, score) of the last piece of the best segmentation up to `end`."""
        if self.kind == BPE:
            pairs = self.pairs
            for start, own in reversed(found):
                fits = pairs.get((last[start], own))
                if fits or fits is None and self.agrees(last[start], own):
                    return start, own, 0.0
            return end - 1, UNKNOWN, 0.0
        best = (end - 1, UNKNOWN, score[end - 1] + self.unknown_score)
        for start, own in found:
            total = score[start] + self.score_of[own]
            if total > best[2] or best[1] == UNKNOWN and start == end - 1:
                best = (start, own, total)
        return best

    def stream(self, text: Iterable[str]) -> Iterator[tuple[int, str]]:
        """(id, characters) of the pieces of a normalised text, as soon as they are final.

        The text comes character by character; only the window is kept.
        """
        longest = self.longest
        recent, base, end = "", 0, 0  # recent: the characters from `base` on, where all paths meet
        back, last, score = {0: 0}, {0: START}, {0: 0.0}

        def path(to: int) -> list[tuple[int, str]]:
            out = []
            while to > base:
                out.append((last[to], recent[back[to] - base : to - base]))
                to = back[to]
            return out[::-1]

        for char in text:
            end += 1
            recent += char
            found = self.candidates(recent, end - base, max(0, end - base - longest))
            found = [(base + start, own) for start, own in found]
            back[end], last[end], score[end] = self.survivor(found, end, last, score)
            if end - base > 2 * longest:
                meet = set(range(end - longest + 1, end + 1))
                while len(meet) > 1:
                    latest = max(meet)
                    meet.remove(latest)
                    meet.add(back[latest])
                boundary = meet.pop()
                if boundary > base:
                    yield from path(boundary)
                    for gone in range(base, boundary):
                        del back[gone], last[gone], score[gone]
                    recent, base, low = recent[boundary - base :], boundary, score[boundary]
                    score = {at: total - low for at, total in score.items()}  # sums stay small
        yield from path(end)

    def short(self, text: str) -> list[tuple[int, str]]:
        """The same of a short text at hand; survivors of frequent word beginnings are remembered."""
        head = text[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self.extended(head, [0], [START], [0.0])
            if len(self.heads) < MOST_HEADS:
                self.heads[head] = known
        back, last, _ = self.extended(text, *map(list, known))
        out, to = [], len(text)
        while to:
            out.append((last[to], text[back[to] : to]))
            to = back[to]
        return out[::-1]

    def extended(self, text: str, back: list, last: list, score: list) -> tuple[list, list, list]:
        """Survivors of all boundaries of a text, of whose beginning they are given."""
        tails, pairs, bpe = self.tails.get, self.pairs, self.kind == BPE
        for end in range(len(back), len(text) + 1):
            found = []
            for start in range(end - 1, -1, -1):
                own = tails(text[start:end])
                if own is None:
                    break
                if own >= 0:
                    found.append((start, own))
            if bpe and found:
                start, own = found[-1]
                if pairs.get((last[start], own)):  # mostly the longest piece fits
                    back.append(start)
                    last.append(own)
                    score.append(0.0)
                    continue
            start, own, total = self.survivor(found, end, last, score)
            back.append(start)
            last.append(own)
            score.append(total)
        return back, last, score

    def packed(self, pieces: Iterable[tuple[int, str]]) -> bytes:
        """Ids as 32-bit numbers; characters without a piece are bytes, or else unknown."""
        out: list[int] = []
        for own, characters in pieces:
            if own != UNKNOWN:
                out.append(own)
            elif self.bytes:
                out.extend(self.bytes[b] for b in characters.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def searched(self, text: Iterable[str]) -> bytes:
        return self.packed(self.stream(text))

    def side_by_side(self, words: list[bytes]) -> list[bytes]:
        """Ids of many short words, searched together: each boundary of all of them is one numpy step."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            for i, ids in zip(part, self._lanes([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _lanes(self, raw: list[bytes]) -> list[bytes]:
        """`raw` is sorted by length, longest first; spaces stand for word starts."""
        trie, n, size = self.trie, len(raw), len(raw[0])
        data = np.zeros((n, size + 1), np.uint8)
        for i, word in enumerate(raw):
            data[i, : len(word)] = np.frombuffer(word, np.uint8)
        lengths = np.array([len(w) for w in raw])
        back, last = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), START, np.int32)
        score = np.zeros((n, size + 1))
        inner = (data & 0xC0) == 0x80  # bytes that go on in a character
        for end in range(1, size + 1):
            rows = np.flatnonzero((lengths >= end) & ((lengths == end) | ~inner[:, end]))
            if not len(rows):
                continue
            found = trie.endings(data, rows, end)
            start = np.full(len(rows), end - 1)
            while (within := inner[rows, start]).any():
                start[within] -= 1
            own, total = np.full(len(rows), UNKNOWN, np.int32), np.zeros(len(rows))
            if self.kind == BPE:
                left = np.arange(len(rows))
                for k in range(found.shape[1], 0, -1):
                    ids = found[left, k - 1]
                    has = np.flatnonzero(ids >= 0)
                    if len(has):
                        fits = has[self.agreeing(last[rows[left[has]], end - k], ids[has])]
                        own[left[fits]], start[left[fits]] = ids[fits], end - k
                        left = np.delete(left, fits)
            else:
                total = score[rows, start] + self.unknown_score
                for k in range(1, found.shape[1] + 1):
                    has = np.flatnonzero(found[:, k - 1] >= 0)
                    sums = score[rows[has], end - k] + self.id_scores[found[has, k - 1]]
                    better = (sums > total[has]) | (own[has] == UNKNOWN) & (start[has] == end - k)
                    has, sums = has[better], sums[better]
                    own[has], start[has], total[has] = found[has, k - 1], end - k, sums
            back[rows, end], last[rows, end], score[rows, end] = start, own, total
        # all paths back at once, a piece a step; row i's pieces end up in columns 0, 1, ...
        to, lane, steps = lengths.copy(), np.arange(n), []
        while len(live := np.flatnonzero(to)):
            ids = np.full(n, UNKNOWN - 1, np.int32)
            ids[live] = last[live, to[live]]
            to[live] = back[live, to[live]]
            steps.append(ids)
        table = np.array(steps[::-1], np.int32).reshape(-1, n).T
        plain = ~(table == UNKNOWN).any(1)
        used = table >= 0
        flat, ends = table[used].tobytes(), np.cumsum(used.sum(1)) * 4
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in lane[~plain].tolist():
            pieces, end = [], len(raw[i])
            while end:
                text = raw[i][back[i, end] : end].decode().replace(" ", SPACE)
                pieces.append((int(last[i, end]), text))
                end = back[i, end]
            out[i] = self.packed(pieces[::-1])
        return out

    def agreeing(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """agrees() of many pairs. Answers are kept as sorted numbers, the latest ones as a dictionary."""
        keys = (before.astype(np.int64) + 2) << 32 | piece
        at = np.searchsorted(self.pair_keys, keys).clip(max=len(self.pair_keys) - 1)
        fits = self.pair_fits[at]
        unknown = np.flatnonzero(self.pair_keys[at] != keys)
        if len(unknown):
            new, which = np.unique(keys[unknown], return_inverse=True)
            known = [self.agrees((k >> 32) - 2, k & 0xFFFFFFFF) for k in new.tolist()]
            fits[unknown] = np.array(known, bool)[which]
            if len(self.pairs) > 10_000 + len(self.pair_keys) // 4:
                self._keep_pairs()
        return fits

    def _keep_pairs(self) -> None:
        keys = [(a + 2) << 32 | b for a, b in self.pairs]
        merged = np.concatenate([self.pair_keys, np.array(keys, np.int64)])
        fits = np.concatenate([self.pair_fits, np.array(list(self.pairs.values()), bool)])
        if len(merged) > MOST_PAIRS:
            merged, fits = merged[:1], fits[:1]
        order = np.argsort(merged)
        self.pair_keys, self.pair_fits = merged[order], fits[order]
        self.pairs.clear()

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, in which spaces stand for word starts."""
        ids = list(map(self.words.get, words))
        new = [i for i, known in enumerate(ids) if known is None]
        short = [i for i in new if len(words[i]) <= LONG_WORD]
        if len(short) < FEW:
            found = [self.packed(self.short(words[i].decode().replace(" ", SPACE))) for i in short]
        else:
            found = self.side_by_side([words[i] for i in short])
        for i, got in zip(short, found, strict=True):
            ids[i] = got
        for i in short[: MOST_WORDS - len(self.words)]:
            self.words[words[i]] = ids[i]
        for i in new:
            if ids[i] is None:
                ids[i] = self.searched(words[i].decode().replace(" ", SPACE))
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all)."""
        normal = [self.processor.normalize(t) for t in texts]
        data, offsets = utf8_of(pc.replace_substring(pa.array(normal, pa.string()), SPACE, " "))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = self.apart[data[:-1].astype(np.int32) << 8 | data[1:]]
        starts[offsets] = True
        cuts = np.flatnonzero(starts)
        buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]
        found = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, buffers).dictionary_encode()
        ids = self.ids_of_words(found.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.int32), np.cumsum(sizes) - sizes
        which = found.indices.to_numpy(zero_copy_only=False)
        count = sizes[which]
        ends = np.cumsum(count)
        at = np.repeat(first[which] - (ends - count), count) + np.arange(ends[-1])
        return flat[at], np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_all(np.fromiter(ids, np.int64), np.array([0]))[0]

    def decode_all(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of concatenated ids, given where each text starts."""
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.raw_at[ids] - (ends - sizes), sizes) + np.arange(total)
        data = self.raw_bytes[at].tobytes()
        edges = np.append(np.concatenate([[0], ends])[starts], total).tolist()
        parts = (data[a:b].removeprefix(b" ") for a, b in zip(edges, edges[1:], strict=False))
        return [part.decode("utf-8", "replace") for part in parts]


class Endings:
    """A trie of all pieces read from their ends, as sorted arrays: steps of many words at once."""

    def __init__(self, pieces: dict[bytes, int]):
        nodes = {b"": 0}
        for piece in pieces:
            for i in range(len(piece) - 1, -1, -1):
                nodes.setdefault(piece[i:], len(nodes))
        keys = [(nodes[tail[1:]] << 8 | tail[0], node) for tail, node in nodes.items() if tail]
        pairs = np.array(sorted(keys), np.int64).reshape(-1, 2)
        self.keys, self.nodes = pairs[:, 0], pairs[:, 1]
        self.ids = np.array([pieces.get(tail, -1) for tail in nodes], np.int32)
        self.longest = max(map(len, pieces), default=1)
        self.root = np.full(256, -1, np.int64)
        near = self.keys < 256
        self.root[self.keys[near]] = self.nodes[near]

    def endings(self, data: np.ndarray, rows: np.ndarray, end: int) -> np.ndarray:
        """For each row and k = 1, 2, ...: id of the piece that is the last k bytes before `end`, or -1."""
        most = min(end, self.longest)
        out = np.full((len(rows), most), -1, np.int32)
        node = self.root[data[rows, end - 1]]
        live = np.flatnonzero(node >= 0)
        node, deepest = node[live], 0
        for k in range(1, most + 1):
            if k > 1:
                key = node << 8 | data[rows[live], end - k]
                at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
                same = self.keys[at] == key
                live, node = live[same], self.nodes[at[same]]
            if not len(live):
                break
            out[live, k - 1] = self.ids[node]
            deepest = k
        return out[:, :deepest]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """One per process and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A list array of the results of encode_all."""
    sizes = np.concatenate([np.zeros(1, np.int64), *(np.diff(before) for _, before in parts)])
    flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))


def shared_model(spark, path: str):
    """The model file, read once by the driver and broadcast: a fixed file of some MB at most."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def ids_of(text: Column, model) -> Column:
    """array<int> of the ids of each text; `model` comes from shared_model."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        pieces = vocabulary(model.value)
        return _lists([pieces.encode_all(part.to_pylist()) for _, part in runs(texts)])

    return encoded(F.coalesce(text, F.lit("")))


def text_of_ids(ids: Column, model) -> Column:
    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        pieces, texts = vocabulary(model.value), []
        for at in range(0, len(lists), TEXTS):
            part = lists.slice(at, TEXTS)
            members = part.flatten().drop_null()
            counts = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
            if len(members) != counts.sum():  # null members
                parent = pc.list_parent_indices(part).filter(part.flatten().is_valid())
                counts = np.bincount(parent.to_numpy(zero_copy_only=False), minlength=len(part))
            texts += pieces.decode_all(members.to_numpy(zero_copy_only=False), np.cumsum(counts) - counts)
        return pa.array(texts, pa.string())

    return decoded(ids)


def encoded_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(<id>, n_ids, ids, decoded, round_trip): ids of each text, and the text they decode to.

    Results are given out slice by slice, so that a task holds those of some MB of text at a time.
    """
    model = shared_model(docs.sparkSession, path)

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model.value)
        for batch in batches:
            for first, part in runs(batch["text"]):
                texts = part.to_pylist()
                ids, before = pieces.encode_all(texts)
                decoded = pieces.decode_all(ids, before[:-1])
                columns = [
                    batch["id"].slice(first, len(part)),
                    pa.array(np.diff(before).astype(np.int32)),
                    _lists([(ids, before)]),
                    pa.array(decoded, pa.string()),
                    pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_ids", "ids", "decoded", "round_trip"]
    rows = docs.select(column(docs, id_column).alias("id"), text_of(docs, text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_ids int, ids array<int>, decoded string, round_trip boolean"
    return rows.mapInArrow(there_and_back, schema).withColumnRenamed("id", id_column)
