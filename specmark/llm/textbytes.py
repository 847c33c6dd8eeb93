"""Vectorised words of many texts: boundaries, hashes and n-gram hashes by numpy over the bytes of an Arrow array.

Words are maximal runs of bytes other than ASCII white space, which never occur inside a multi-byte character. A word's
hash is a polynomial over its bytes modulo 2^64, mixed; an n-gram's is one over the hashes of its words, read off prefix
sums where n is large. Texts are taken in chunks of bounded size, except that a text is never cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
TABLE_BYTES = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters in lower case, and what is neither a letter, a digit nor part of a multi-byte character as a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@cache
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    return _powers(1 << max(10, (n - 1).bit_length()), base)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (Steele et al., 2014)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts: byte spans, the text each belongs to, and the first word of each text (and the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def hashes(self, base: int = _BASE) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        if len(self.data) <= TABLE_BYTES:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(len(self.data), base), out=sums[1:])
            return mix((sums[self.ends] - sums[self.starts]) * powers(len(self.data), pow(base, -1, 1 << 64))[self.starts])
        # the same values for a very long text, with a table as long as its longest word
        sizes = (self.ends - self.starts).astype(np.int32)
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(firsts.astype(np.int32), sizes)
        values = powers(int(sizes.max()), base)[place]
        values *= self.data[~_IS_SPACE[self.data]].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(values, firsts))


def ngrams(hashes: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """The hash of the n words from each place on (len - n + 1 of them, across texts: mask what crosses a border)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    if n <= 8:
        for k in range(n):
            out = out * np.uint64(base) + hashes[k : k + len(out)]
        return mix(out)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), base), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(len(out), pow(base, -1, 1 << 64)))


def inside(firsts: np.ndarray, n: int) -> np.ndarray:
    """Which places start an n-gram that ends in the same text; as long as ngrams() is."""
    total = int(firsts[-1])
    room = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(total)
    return room[: max(0, total - n + 1)] >= n


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first text, number of texts, data, offsets): views of consecutive texts of up to ``most`` bytes, or one text."""
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None) -> Words:
    if fold is not None:
        data = fold[data]
        # capital letters of Latin-1, two bytes each, but the multiplication sign among them
        second = np.nonzero(data[:-1] == 0xC3)[0] + 1
        capital = second[(data[second] <= 0x9E) & (data[second] != 0x97)]
        data[capital] += 32
    gap = np.ones(len(data) + 1, bool)
    np.take(_IS_SPACE, data, out=gap[:-1])
    # a text also ends where the next begins
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~gap
    before = np.concatenate(([False], word[:-1]))
    starts = np.nonzero(word & (~before | edge))[0]
    ends = np.nonzero(before & (~word | edge))[0]
    return Words(data, starts, ends, np.searchsorted(starts, offsets))
