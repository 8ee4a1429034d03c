"""Token ids of whole batches of texts by the tokenizers library, each distinct word encoded once.

Byte-level BPE first cuts a text into words that it then encodes on their own. A single space between
two characters that are no white space always starts such a word, and so does an ASCII sign behind an
ASCII letter. Texts are cut there, in the buffer; only distinct cuts that the process has not met before
go to the library: to its BPE model where a cut is one run of letters, else to the whole tokenizer.

Strings of the tokenizer's added tokens, such as <|endoftext|>, get that token's id wherever a text has them, as
the library does it: they are cuts of their own, before anything else is looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from relspark.llm.words import byte_table, span_hashes, utf8_of

#: Words remembered per process (about 40 bytes each), and words encoded at once.
MOST_WORDS, AT_ONCE = 400_000, 500

_BLANK = byte_table(lambda b: b in (32, *range(9, 14), *range(28, 32)))
_LETTER = byte_table(lambda b: b < 0x80 and chr(b).isalpha())
_SIGN = byte_table(lambda b: 0x20 < b < 0x7F and not chr(b).isalnum())
#: First bytes of characters that may be white space beyond ASCII.
_LEAD = byte_table(lambda b: b in (0xC2, 0xE1, 0xE2, 0xE3))


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions at which texts may be cut: text starts, and single spaces between other characters."""
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    space = np.flatnonzero(data == 32)
    space = space[(space > 2) & (space < len(data) - 1)]
    one, two, three, after = (data[space + k] for k in (-1, -2, -3, 1))
    wide = (one >= 0x80) & (_LEAD[two] | (two >= 0x80) & _LEAD[three])
    starts[space[~_BLANK[one] & ~wide & ~_BLANK[after] & ~_LEAD[after]]] = True
    starts[1:-1] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    return np.flatnonzero(starts)


#: The characters that byte-level BPE writes for the 256 bytes: visible ones stand for themselves.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: chr(b) for b in _PLAIN}
_WRITTEN |= {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Memory:
    """Ids of words met before, by a 128-bit hash: sorted arrays, no Python object per word."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New words; `ids` are those held so far and theirs, in which `first` and `count` lie."""
        keys, some = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.checks = np.insert(self.checks, at, checks[some])
        self.first = np.insert(self.first, at, first[some])
        self.count = np.insert(self.count, at, count[some])
        self.ids = ids


class Encoder:
    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(definition.decode())
        self.size = self.tokenizer.get_vocab_size()
        before, plain = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer is None
        #: Whether a run of letters, also behind one space, goes to the model as it is.
        self.direct = plain and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Whether added tokens are found as they stand, without looking at what is around them.
        self.cuts = all(plain and not (t.lstrip or t.rstrip or t.single_word) for t in added)
        strings = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.known = Memory()

    def cuts_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where texts may be cut; an added token's string is one piece."""
        if not self.cuts:
            return np.unique(np.append(offsets, len(data)))
        cuts = word_cuts(data, offsets)
        found = [m.span() for m in self.added.finditer(data)] if self.added else []
        if not found:
            return cuts
        # a string that reaches over the end of a text is none
        spans = np.array(found, np.int64)
        ends = offsets[np.minimum(np.searchsorted(offsets, spans[:, 0], "right"), len(offsets) - 1)]
        if (spans[:, 1] > ends).any():
            spans = self._within(data, offsets)
        inside = np.searchsorted(spans[:, 0], cuts, "left") - 1
        cuts = cuts[(inside < 0) | (cuts >= spans[np.maximum(inside, 0), 1])]
        return np.unique(np.concatenate([cuts, spans.ravel()]))

    def _within(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Spans of added tokens, looked for in each text by itself."""
        found = [
            m.span() for a, b in zip(offsets, offsets[1:], strict=False) for m in self.added.finditer(data, int(a), int(b))
        ]
        return np.array(found, np.int64).reshape(-1, 2)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all)."""
        data, offsets = utf8_of(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts = self.cuts_of(data, offsets)
        buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]
        found = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, buffers).dictionary_encode()
        words = found.dictionary
        text, at = utf8_of(words)
        keys, checks = (span_hashes(text, at[:-1], at[1:], seed) for seed in (1, 2))
        known = self.known
        place = known.find(keys, checks)
        first, sizes = (np.append(x, 0)[place] for x in (known.first, known.count))
        new = np.flatnonzero(place < 0)
        got = self.ids_of(words.take(pa.array(new)).to_pylist())
        sizes[new] = np.fromiter(map(len, got), np.int64, len(got))
        first[new] = len(known.ids) + np.cumsum(sizes[new]) - sizes[new]
        flat = np.concatenate([known.ids, *(np.frombuffer(x, np.uint32) for x in got)])
        if len(known.keys) + len(new) <= MOST_WORDS:
            known.add(keys[new], checks[new], first[new], sizes[new], flat)
        which = found.indices.to_numpy(zero_copy_only=False)
        count = sizes[which]
        ends = np.cumsum(count)
        at = np.repeat(first[which] - (ends - count), count) + np.arange(ends[-1])
        before = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        return flat[at], before

    def ids_of(self, words: list[bytes]) -> list[array]:
        """Ids of words that were not met before."""
        ids: list = [None] * len(words)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            if self.direct and word.decode().removeprefix(" ").isalpha():
                written = word.decode("latin-1").translate(_WRITTEN)
                ids[i] = array("I", [token.id for token in tokenize(written)])
            else:
                rest.append(i)
        for at in range(0, len(rest), AT_ONCE):  # what the library returns takes much memory
            some = rest[at : at + AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)
            for i, got in zip(some, encoded, strict=True):
                ids[i] = array("I", got.ids)
        return ids


_LOADED: dict[str, Encoder] = {}


def encoder(definition: bytes) -> Encoder:
    """One per process and tokenizer."""
    key = hashlib.sha256(definition).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(definition)
    return _LOADED[key]
