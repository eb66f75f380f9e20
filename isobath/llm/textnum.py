"""Vectorised word, shingle and window hashing over Arrow text columns.

The functions read the UTF-8 buffers of an Arrow string column in place, so no
Python string is made for a word.  Text is taken in slices of a bounded number
of bytes; a document longer than that is a slice of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text that one slice holds, unless a single document is longer.
SLICE_BYTES = 1 << 20

#: ASCII white space: space and U+0009 to U+000D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that look random."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: Bytes of a span beyond which it is hashed by itself.
LONG_SPAN = 256
_LENGTH = seeds(2, 11)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes data[s:e] for each pair of starts and ends.

    Eight bytes at a time are mixed into a state that begins with the length, so
    spans of one length up to eight bytes never share a hash; long spans are taken
    by xxh3.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + _LENGTH[seed])
    long = np.flatnonzero(size > LONG_SPAN)
    own, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(own):
        block = eight[starts[own] + at]
        left = size[own] - at
        short = left < 8
        block[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        out[own] = mix(out[own] ^ block)
        at += 8
        own = own[left > 8]
    view = memoryview(data)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]], seed)
    return out


def span_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Values that tell spans apart which share a span_hash: the bytes themselves up to eight, another hash beyond."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = eight[starts]
    short = size < 8
    out[short] &= (U64(1) << (size[short].astype(U64) * U64(8))) - U64(1)
    more = np.flatnonzero(size > 8)
    out[more] = span_hashes(data, starts[more], ends[more], 1)
    return out


#: Odd multipliers that make a run's hash depend on the order of its words.
_RUN = seeds(64, 23) | U64(1)


def runs(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values of h from each of starts."""
    s = h[starts] * _RUN[0]
    for j in range(1, k):
        s += h[starts + j] * _RUN[j % 64]
    return mix(s + U64(k))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of successive slices; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a slice: byte spans, 64-bit hashes and the range of words of each document.

    A word is a run of bytes that are not ASCII white space; words never cross documents.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        n = len(data)
        solid = ~WHITE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of_doc = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """(text, at): all words with one space after each, and where each word begins in it; at has one more entry, the text's end."""
        size = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        solid = np.ones(len(out), bool)
        solid[at[1:] - 1] = False
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        out[solid] = self.data[np.cumsum(inside[:-1]) > 0] if len(self.data) else self.data
        return out.tobytes(), at


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one document's word hashes; the whole sequence if it is shorter, none if it is empty."""
    k = min(k, len(h))
    if k == 0:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    s = h[:n] * _RUN[0]
    for j in range(1, k):
        s += h[j : j + n] * _RUN[j % 64]
    return mix(s + U64(k))
