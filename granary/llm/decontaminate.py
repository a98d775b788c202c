"""Benchmark decontamination by spaced-seed hashing.

A seed mask picks some of a few neighbouring words and ignores the others.  The words picked at every position of the test
items are hashed into a table; the same masks run over every position of every document, and where hashes meet, document
and item are laid side by side at that offset and compared word by word (A-Z in lower case).  A document is contaminated by an
item when some window of ``WINDOW`` words of the item (all of it, if it is shorter) agrees with the document in at least 80 % of
its words, so substituted words don't hide a leak.

The masks are lossless: for each window they are chosen so that, wherever the allowed number of substitutions falls, one mask
meets none of them.  Items of fewer than ``LEAST`` words are no evidence and are left out, as null texts are.
Items without an id are items like others; their results have a null item_id.

The test items are a stated query set: they go to the executors in blocks of about ``BLOCK_WORDS`` words (or one longer item), each block
against all documents, one block in memory at a time.  Repeated rows of documents each get their own result; repeated
rows of the test set are one item, and items with one id and different texts are two.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, with_text, written

WINDOW, LEAST, SIMILARITY, BLOCK_WORDS = 13, 5, 0.8, 400_000
#: At most so many masks for a window; the fewer, the fewer words a mask picks.
MASKS = 6


@functools.cache
def masks(window: int, misses: int) -> tuple[tuple[int, ...], ...]:
    """Offsets picked by each mask, such that any `misses` places of a window leave some mask, somewhere in it, untouched."""
    bad = [sum(1 << p for p in places) for places in itertools.combinations(range(window), misses)]
    for weight in range(window - misses, 0, -1):
        cover: dict[tuple[int, ...], int] = {}
        spans = itertools.chain.from_iterable(
            itertools.combinations(range(1, s), weight - 2) for s in range(max(weight, 2) - 1, window)
        ) if weight > 1 else [()]
        for inner in spans:
            ends = range(max(inner, default=0) + 1, window) if weight > 1 else [0]
            for last in ends:
                mask = (0, *inner, last) if weight > 1 else (0,)
                bits = sum(1 << o for o in mask)
                shifts = [bits << p for p in range(window - mask[-1])]
                cover[mask] = sum(1 << k for k, b in enumerate(bad) if any(not s & b for s in shifts))
        left, chosen = (1 << len(bad)) - 1, []
        while left and len(chosen) < MASKS:
            best = max(cover, key=lambda m: ((cover[m] & left).bit_count(), -m[-1], m))
            if not cover[best] & left:
                break
            chosen.append(best)
            left &= ~cover[best]
        if not left:
            return tuple(chosen)
    raise ValueError("no mask fits")


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = max(len(h) - mask[-1], 0)
    total = np.full(n, 0x9E3779B97F4A7C15 * len(mask) & (1 << 64) - 1, np.uint64)
    for o in mask:
        total += h[o : o + n] * np.uint64(2 * (0x5851F42D4C957F2D + 7919 * o) + 1 & (1 << 64) - 1)
    return K.mixed(total)


class Items:
    """A block of test items: their word hashes, and for each mask the sorted hashes with items and places."""

    def __init__(self, ids: list, texts: list[str], window: int = WINDOW, similarity: float = SIMILARITY):
        self.ids, self.words, self.window, self.need = [], [], [], []
        by: dict[tuple[int, int], list[int]] = {}
        array = pa.array(texts, pa.large_string())
        for c in K.chunks(array):
            start, end, bounds = c.words()
            h = c.hashes(start, end, K.LOWER)
            for i in range(len(bounds) - 1):
                if (n := int(bounds[i + 1] - bounds[i])) < LEAST:
                    continue
                w = min(n, window)
                need = math.ceil(similarity * w - 1e-9)
                by.setdefault((w, w - need), []).append(len(self.ids))
                self.ids.append(ids[c.rows.start + i])
                self.words.append(h[bounds[i] : bounds[i + 1]])
                self.window.append(w)
                self.need.append(need)
        self.tables = []
        for (w, misses), own in sorted(by.items()):
            for mask in masks(w, misses):
                keys = [seeds(self.words[i], mask) for i in own]
                key = np.concatenate(keys)
                item, place = np.repeat(own, [len(k) for k in keys]), np.concatenate([np.arange(len(k)) for k in keys])
                order = np.argsort(key, kind="stable")
                bits = max(16, int(len(key) * 16).bit_length())
                seen = np.zeros(1 << bits, bool)
                seen[key >> np.uint64(64 - bits)] = True
                self.tables.append((mask, key[order], item[order], place[order], seen, np.uint64(64 - bits)))

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word index where the item would begin) of every meeting of hashes within a document, each once."""
        found = []
        for mask, key, item, place, seen, shift in self.tables:
            s = seeds(h, mask)
            at = np.flatnonzero(seen[s >> shift])
            at = at[doc[at] == doc[at + mask[-1]]]
            low, high = np.searchsorted(key, s[at]), np.searchsorted(key, s[at], "right")
            n = high - low
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            found.append(np.column_stack([item[entry], np.repeat(at, n) - place[entry], np.repeat(doc[at], n)]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.unique(np.concatenate(found), axis=0).T)

    def overlaps(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, agreeing words) of each verified overlap, the best for a document and item."""
        item, begin, doc = self.hits(h, K.owner(bounds))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in np.unique(item):
            words, w = self.words[i], self.window[i]
            own = np.flatnonzero(item == i)
            for part in np.array_split(own, max(1, len(own) * len(words) >> 21)):
                at = begin[part, None] + np.arange(len(words))
                inside = (at >= bounds[doc[part], None]) & (at < bounds[doc[part] + 1, None])
                same = inside & (h[np.clip(at, 0, len(h) - 1)] == words)
                total = np.concatenate([np.zeros((len(part), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
                good = (total[:, w:] - total[:, :-w] >= self.need[i]) & inside[:, : len(words) - w + 1] & inside[:, w - 1 :]
                for r in np.flatnonzero(good.any(axis=1)):
                    first = int(good[r].argmax())
                    last = len(words) - int(good[r][::-1].argmax())
                    key, value = (int(doc[part[r]]), int(i)), (int(total[r, last] - total[r, first]), -int(at[r, first] - bounds[doc[part[r]]]), last - first)
                    best[key] = max(best.get(key, value), value)
        return [(d, i, -start, n, same) for (d, i), (same, start, n) in best.items()]


def _overlaps(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                start, end, bounds = c.words()
                rows = own.overlaps(c.hashes(start, end, K.LOWER), bounds)
                d, i, first, n, same = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.rows].take(pa.array(d, pa.int64())), *(pa.array(x, pa.int64()) for x in ([own.ids[k] for k in i], first, n, same))],
                    names=["doc_id", "item_id", "start_word", "n_words", "n_same"]
                )

    return run


def _clean(items, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in K.chunks(batch.column(text)):
                start, end, bounds = c.words()
                keep[[c.rows.start + r[0] for r in own.overlaps(c.hashes(start, end, K.LOWER), bounds)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, window: int, similarity: float, block_words: int) -> Iterator[tuple[object, bool]]:
    """Broadcasts of Items of about `block_words` words each, one after the other, and whether there is one alone.

    Their number follows the size of the test set.  Where there are several, each is released before the next is made, so the
    memory of driver and executors is that of one block; what was found with it must have been written by then.
    """
    spark = benchmark.sparkSession
    own = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    words = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(words / 5 / block_words))
    for k in range(n):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect() if words else []
        block = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], window, similarity))
        yield block, n == 1
        if n > 1:
            block.destroy()


FOUND = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, n_same bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, start_word, n_words (of the overlap), n_same (words that agree)."""
    named = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    parts = []
    for block, alone in _blocks(benchmark, window, similarity, block_words):
        found = map_arrow(named, _overlaps(block), FOUND)
        parts.append(found if alone else written(found, "overlaps"))
    return functools.reduce(DataFrame.unionAll, parts)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pipeline's stage: contaminated documents go; columns as in `docs`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block, alone in _blocks(benchmark, window, similarity, block_words):
        left = map_arrow(docs, _clean(block, docs.columns.index("text")), schema)
        docs = left if alone else written(left, "clean-documents")
    return docs
