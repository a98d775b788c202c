"""Vectorised text kernel: words, lines and their 64-bit hashes straight from Arrow's UTF-8 buffers.

No Python string is made: a chunk of documents is one byte array, its words are index pairs.  A span of bytes is hashed eight
bytes at a time, each going through a bijection that spreads every bit, so that no sum over bytes can cancel; long spans
have their XXH64.  Windows of a fixed number of words are hashed by a polynomial over the hashes of their words, from prefix sums.

A word is a run of bytes other than 0x20 and 0x09-0x0D; UTF-8 continuation bytes never fall there, so this equals
``[^\\x20\\x09-\\x0D]+`` over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer document is worked on alone.
CHUNK = 1 << 18

#: Spans of more bytes are hashed one by one.
LONG = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes as they are, and with A-Z in lower case; and, besides, with each digit as 0.
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32
NORMAL = LOWER.copy()
NORMAL[48:58] = 48


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        found = _powers[base] = np.multiply.accumulate(steps)
    return found[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a zero in front: what span_hash needs."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each window [start, end) of hashes: the same for equal contents, wherever they stand.

    For windows of some dozen words: sums over powers of two cancel for certain patterns of a thousand values and more.
    """
    h = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mixed(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


_PART = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as a number; zeros follow the last."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, or as many as are left."""
    x = lanes[at]
    short = np.flatnonzero(left < 8)
    x[short] &= _PART[left[short]]
    return x


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans [start, end): the same for equal bytes."""
    n = end - start
    long = np.flatnonzero(n > LONG)
    size = n.copy()
    size[long] = 0
    lanes = _lanes(data)
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    h = mixed(h ^ _lane(lanes, start, size))
    for at in range(8, LONG, 8):
        live = np.flatnonzero(size > at)
        if not len(live):
            break
        h[live] = mixed(h[live] ^ _lane(lanes, start[live] + at, size[live] - at))
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes that begin at a_start in `a` and at b_start in `b` have the same bytes."""
    long = np.flatnonzero(size > LONG)
    short = size.copy()
    short[long] = 0
    x, y = _lanes(a), _lanes(b)
    same = _lane(x, a_start, short) == _lane(y, b_start, short)
    for at in range(8, LONG, 8):
        live = np.flatnonzero(short > at)
        if not len(live):
            break
        left = short[live] - at
        same[live] &= _lane(x, a_start[live] + at, left) == _lane(y, b_start[live] + at, left)
    for k in long.tolist():
        same[k] = np.array_equal(a[a_start[k] : a_start[k] + size[k]], b[b_start[k] : b_start[k] + size[k]])
    return same


@dataclass
class Chunk:
    """Some documents: `data` holds their bytes, document i those from offsets[i] to offsets[i+1]."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte indices of the starts and ends of all words, and for each document where its words begin (n + 1)."""
        n = len(self.data)
        solid = ~SPACE[self.data]
        begins, ends = solid.copy(), solid.copy()
        if n:
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            begins[cut] = solid[cut]
            ends[cut - 1] = solid[cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for lines, as a split at newlines gives them: a document has one more line than newlines."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        counts = np.searchsorted(breaks, self.offsets[1:]) - np.searchsorted(breaks, self.offsets[:-1]) + 1
        return start, end, np.concatenate([[0], np.cumsum(counts)])

    def hashes(self, start: np.ndarray, end: np.ndarray, fold: np.ndarray = PLAIN) -> np.ndarray:
        """64-bit hashes of byte spans, after `fold` has replaced bytes."""
        return hashed(self.data if fold is PLAIN else fold[self.data], start, end)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The documents of a string column in order, at most `limit` bytes at a time or one longer document; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield Chunk(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item the document that it lies in, from the documents' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each document's values; bounds as from words() or offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs more than once, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    later, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in a window [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0
