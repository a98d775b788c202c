"""Simple-8b word-aligned coding of token ids, and the shard files that hold it.

A 64-bit word has a selector in its low four bits and up to 60 values of equal width above it.  Ids are coded in blocks of
``BLOCK``; a block starts on a word, so blocks are coded and decoded side by side in numpy.  Values of 2**60 and more are
escapes: their slot holds a word of selector 15, and the values themselves stand raw after the block's words.

Shard file: magic, words of all blocks, then the directory (per block its first word and its number of escapes; per document
its id and number of ids), then the lengths of both and the magic again.  All integers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

BLOCK, MAGIC = 128, b"GRN8B\x00\x00\x01"
#: For each selector how many values a word holds, and their bits; 0 is unused and 15 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
ESCAPE, PAD = 15, 60


_SHORT = np.repeat(np.arange(18), [1, *(1 << k for k in range(17))]).astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.max(initial=0) < len(_SHORT):
        return _SHORT[values]
    return sum((values >= np.uint64(1 << b) for b in range(64)), np.zeros(len(values), np.uint8))


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block with its raw ones, escapes of each block) of unsigned values."""
    values = np.asarray(values, np.uint64)
    n_blocks = -(-len(values) // BLOCK)
    grid = np.zeros((n_blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    grid[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    length = np.minimum(BLOCK, len(values) - BLOCK * np.arange(n_blocks))
    width = np.zeros(grid.shape, np.uint8)
    width[:, :BLOCK] = bit_lengths(flat).reshape(n_blocks, BLOCK)
    widest, selector = width[:, :BLOCK].copy(), np.full((n_blocks, BLOCK), ESCAPE, np.uint8)
    n = 1
    for s in range(14, 0, -1):  # more and more values a word
        if s < 14 and widest.min(initial=255) > BITS[s]:
            break
        while n < COUNTS[s]:
            np.maximum(widest, width[:, n : n + BLOCK], out=widest)
            n += 1
        selector[widest <= BITS[s]] = s
    at, step = np.zeros(n_blocks, np.int64), 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(n_blocks)
    while len(live):
        s = selector[live, at[live]]
        found.append((live, at[live], s, np.full(len(live), step)))
        at[live] += COUNTS[s]
        live, step = live[at[live] < length[live]], step + 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    block, place, s, step = (np.concatenate(x) for x in zip(*found, strict=True))
    packed, escapes = np.bincount(block, minlength=n_blocks), np.bincount(block[s == ESCAPE], minlength=n_blocks)
    first = np.concatenate([[0], np.cumsum(packed + escapes)])
    words, line, slot = np.zeros(first[-1], np.uint64), grid.ravel(), block * grid.shape[1] + place
    target = first[block] + step
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        word, here = np.full(len(own), k, np.uint64), slot[own]
        for j in range(int(COUNTS[k])) if k != ESCAPE else ():
            word |= line[here + j] << np.uint64(4 + j * BITS[k])
        words[target[own]] = word
        if k == ESCAPE:
            own = own[np.lexsort((place[own], block[own]))]
            rank = np.arange(len(own)) - np.searchsorted(block[own], block[own])
            words[first[block[own]] + packed[block[own]] + rank] = grid[block[own], place[own]]
    return words, packed + escapes, escapes


def decode(words: np.ndarray, sizes: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks, from their words."""
    n_blocks = len(sizes)
    first = np.cumsum(sizes) - sizes
    packed = sizes - escapes
    block = np.repeat(np.arange(n_blocks), packed)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(packed) - packed, packed)
    code = words[np.repeat(first, packed) + inside]
    s = (code & np.uint64(15)).astype(np.int64)
    ahead = np.cumsum(COUNTS[s]) - COUNTS[s]
    place = ahead - np.repeat(ahead[np.cumsum(packed) - packed], packed) if len(code) else ahead
    grid = np.zeros((n_blocks, BLOCK + PAD), np.uint64)
    for k in np.unique(s):
        own = np.flatnonzero(s == k)
        if k == ESCAPE:
            rank = np.arange(len(own)) - np.searchsorted(block[own], block[own])
            grid[block[own], place[own]] = words[first[block[own]] + packed[block[own]] + rank]
            continue
        mask = np.uint64((1 << int(BITS[k])) - 1)
        for j in range(int(COUNTS[k])):
            grid[block[own], place[own] + j] = (code[own] >> np.uint64(4 + j * BITS[k])) & mask
    return grid[:, :BLOCK].reshape(-1)[:n]


class Writer:
    """Writes one shard to a binary stream; holds at most `hold` ids besides the directory."""

    def __init__(self, out: BinaryIO, hold: int = 1 << 18):
        self.out, self.hold = out, hold - hold % BLOCK
        self.rest: list[np.ndarray] = []
        self.held = self.words = 0
        self.sizes: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.ids: list[int] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int], tokens: np.ndarray, counts: np.ndarray) -> None:
        """Documents in order: their ids, their tokens end to end, and how many each has."""
        self.ids += doc_ids
        self.counts += counts.tolist()
        self.rest.append(tokens)
        self.held += len(tokens)
        if self.held >= self.hold:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        n = len(values) if last else len(values) - len(values) % BLOCK
        for at in range(0, n, self.hold):
            words, sizes, escapes = encode(values[at : min(n, at + self.hold)])
            self.out.write(words.astype("<u8").tobytes())
            self.sizes.append(sizes)
            self.escapes.append(escapes)
        self.rest = [values[n:]]
        self.held = len(values) - n

    def close(self) -> int:
        """Writes the directory; returns the shard's number of ids."""
        self._flush(True)
        none = [np.zeros(0, np.int64)]
        sizes, escapes = np.concatenate(self.sizes or none), np.concatenate(self.escapes or none)
        directory = np.concatenate(
            [np.cumsum(sizes) - sizes, [sizes.sum()], escapes, np.array(self.ids, np.int64), np.array(self.counts, np.int64)]
        ).astype("<i8").tobytes()
        self.out.write(directory + struct.pack("<qq", len(sizes), len(self.ids)) + MAGIC)
        return sum(self.counts)


class Reader:
    """Reads a shard from a seekable binary stream."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream
        end = stream.seek(0, 2)
        stream.seek(end - 24)
        blocks, docs = struct.unpack("<qq", stream.read(16))
        if stream.read(8) != MAGIC:
            raise ValueError("not a shard, or cut off")
        size = 8 * (2 * blocks + 1 + 2 * docs)
        stream.seek(end - 24 - size)
        x = np.frombuffer(stream.read(size), "<i8")
        self.first, self.escapes, self.ids, self.counts = np.split(x, [blocks + 1, 2 * blocks + 1, 2 * blocks + 1 + docs])

    def blocks(self, at: int, to: int) -> np.ndarray:
        """The ids of blocks at .. to-1, without reading any others."""
        n = min(to * BLOCK, int(self.counts.sum())) - at * BLOCK
        self.stream.seek(len(MAGIC) + 8 * int(self.first[at]))
        words = np.frombuffer(self.stream.read(8 * int(self.first[to] - self.first[at])), "<u8")
        return decode(words, np.diff(self.first[at : to + 1]), self.escapes[at:to], n)

    def tokens(self, at: int, to: int) -> np.ndarray:
        """The ids from place `at` to place `to` of the shard."""
        if to <= at:
            return np.zeros(0, np.uint64)
        low, high = at // BLOCK, -(-to // BLOCK)
        return self.blocks(low, high)[at - low * BLOCK : to - low * BLOCK]

    def documents(self, step: int = 2048) -> Iterator[tuple[int, int, Iterator[np.ndarray]]]:
        """(doc_id, place, its ids in bounded parts) of each document in order; the parts are to be taken before the next."""
        at = 0
        held, low, high = np.zeros(0, np.uint64), 0, 0

        def parts(at: int, to: int) -> Iterator[np.ndarray]:
            nonlocal held, low, high
            while at < to:
                if not low <= at < high:
                    low = at // BLOCK * BLOCK
                    held = self.blocks(low // BLOCK, min(low // BLOCK + step, len(self.escapes)))
                    high = low + len(held)
                part = held[at - low : min(to, high) - low]
                yield part
                at += len(part)

        for doc_id, n in zip(self.ids.tolist(), self.counts.tolist(), strict=True):
            yield doc_id, at, parts(at, at + n)
            at += n
