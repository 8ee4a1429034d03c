"""Words of whole Arrow batches of texts as numpy arrays: no Python object per word.

A batch of texts is one buffer of UTF-8 bytes and the offsets of its texts. Word starts, ends and
64-bit hashes are computed on the buffer; a word of any length is hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0xC4CEB9FE1A85EC53)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_table(allowed) -> np.ndarray:
    return np.array([allowed(b) for b in range(256)])


#: a-z, 0-9 and every byte of a character beyond ASCII.
WORD_BYTES = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, also one with nulls or a slice; null is empty."""
    if not pa.types.is_binary(texts.type):
        texts = pc.fill_null(texts, "")
    texts = pc.cast(texts, pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass(frozen=True)
class Words:
    """Words of a batch: `data` is the lower-cased buffer, words of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(texts: pa.Array, word_bytes: np.ndarray = WORD_BYTES) -> Words:
    """Maximal runs of word bytes after lower-casing A-Z; no word reaches into the next text."""
    raw, offsets = utf8_of(texts)
    data = LOWER[raw]
    inside = word_bytes[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def _mixed(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    h = (h ^ lane) * _MIX
    return (h ^ (h >> np.uint64(29))) * _STEP


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number, little-endian, zeros past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans."""
    at, size = lanes(data), ends - starts
    h = size.astype(np.uint64) * _MIX + np.uint64(seed)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        left = size[live] - 8 * k
        keep = np.where(left >= 8, _ALL, ~(_ALL << (np.minimum(left, 7) * 8).astype(np.uint64)))
        h[live] = _mixed(h[live], at[starts[live] + 8 * k] & keep)
        live, k = live[left > 8], k + 1
    return h ^ (h >> np.uint64(32))


def runs(texts: pa.Array, most_bytes: int = 1 << 21):
    """Slices of a string array of about most_bytes each; one longer text is a slice of its own.

    Numpy work on a batch takes a multiple of its bytes, so batches are worked off in such slices.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(place)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if b > a:
            yield a, texts.slice(a, b - a)
