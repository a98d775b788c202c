"""Packing documents into sequences of at most 1024 tokens by cutting-stock column generation.

A document's ids are cut into full pieces and a shorter last one.  The lengths' histogram has at most 1024 bins, however
large the corpus, so it goes to the driver, where a linear program over patterns (what lengths share a sequence, how often)
is solved by column generation: the simplex method's dual prices go to a knapsack dynamic program, which returns the pattern
worth most, until none is worth more than a sequence.  Each pattern's number is rounded down; programs for what that leaves follow, whose
patterns are taken once at least, until none fits any more.  Pieces of a length are ranked, and ranks are dealt to the patterns' places in
turn; a length has a bucket for every ``BUCKET`` pieces, ranks are counted per bucket and summed over buckets, so that a length
which a third of all documents have is no hot task.  What is left, and the places of patterns with more than
``TOLERANCE`` tokens of waste, is laid end to end and cut at every 1024 tokens.

Null texts are empty and have the end id alone.  Every row is a document, rows with equal ids too.  An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, with_text, written
from .tokens import Encoder

SIZE, END, TOLERANCE, BUCKET = 1024, 0, 8, 1 << 14
#: The linear program stops this near to its bound, or after so many rounds of so many columns, or
#: when STALL rounds have gained less than a tenth of that; less work there only means more cuts.
GAP, ROUNDS, COLUMNS, STALL = 0.001, 200, 64, 8


# ---- the linear program -------------------------------------------------------------------------------------------


def knapsack(prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to `size` the worth of the best pattern, and the length it takes next (0: a token left empty)."""
    best, item = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    worth = np.maximum(prices, 0.0)
    for c in range(1, size + 1):
        values = worth[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(values.argmax())
        best[c] = best[c - 1]
        if values[k] > best[c]:
            best[c], item[c] = values[k], k + 1
    return best, item


def _pattern(item: np.ndarray, capacity: int, first: int) -> np.ndarray:
    counts = np.zeros(len(item), np.int64)
    counts[first] += 1
    c = capacity - first
    while c > 0:
        counts[item[c]] += item[c] > 0
        c -= max(int(item[c]), 1)
    return counts


def _start(histogram: np.ndarray, size: int) -> list[np.ndarray]:
    """A feasible basis, a pattern for each length: fillings that prefer common lengths, each used until a length of it is used up.

    The patterns, in the order in which they use up their lengths, are triangular, so they are independent.
    """
    left = histogram[: size + 1].astype(float)
    basis: dict[int, np.ndarray] = {}
    grain = np.arange(size + 1.0)
    while left.any():
        prices = np.where(left > 0, grain * (1 + 0.01 * left / left.max()), 0.0)
        _, item = knapsack(prices, size)
        for s in np.flatnonzero(left)[::-1].tolist():
            if left[s] <= 0:
                continue
            counts = _pattern(item, size, s)
            used = np.flatnonzero(counts)
            if (left[used] <= 0).any():
                continue
            shares = left[used] / counts[used]
            gone = int(used[shares.argmin()])
            left[used] = np.maximum(left[used] - counts[used] * shares.min(), 0.0)
            left[gone] = 0.0
            left[left < 1e-6] = 0.0
            for k in used[left[used] == 0].tolist():
                if k not in basis:
                    basis[k] = counts if k == gone else np.where(grain == k, size // k, 0).astype(np.int64)
    return [basis[k] for k in sorted(basis)]


def patterns(histogram: np.ndarray, size: int = SIZE, gap: float = GAP, rounds: int = ROUNDS, columns: int = COLUMNS) -> list[tuple[np.ndarray, float]]:
    """(counts by length, how often) of a solution near the linear program's optimum; histogram[length] for 0..size.

    A round solves one knapsack at the dual prices; it gives, for each length, the pattern with that length that is worth most.
    The `columns` best of them enter the basis in turn, each only if it still pays at the prices by then.
    """
    lengths = np.flatnonzero(histogram)
    m = len(lengths)
    if not m:
        return []
    demand = histogram[lengths].astype(float)
    basis = _start(histogram, size)
    matrix = np.array([c[lengths] for c in basis], float).T
    inverse = np.asfortranarray(np.linalg.inv(matrix))
    x = np.maximum(inverse @ demand, 0.0)
    dual = inverse.sum(axis=0)
    material = float(lengths @ demand) / size
    was: list[float] = []
    for _ in range(rounds):
        was.append(x.sum())
        if len(was) > STALL and was[-STALL - 1] - was[-1] < gap / 10 * was[-1]:
            break
        prices = np.zeros(size + 1)
        prices[lengths] = dual
        best, item = knapsack(prices, size)
        if best[size] <= 1 + 1e-9 or x.sum() <= max(material, x.sum() / best[size]) * (1 + gap):
            break
        worth = dual + best[size - lengths]
        for k in np.argsort(-worth)[:columns]:
            if worth[k] <= 1 + 1e-6:
                break
            counts = _pattern(item, size, int(lengths[k]))
            column = counts[lengths]
            used = np.flatnonzero(column)
            gain = float(dual[used] @ column[used]) - 1
            if gain <= 1e-6:
                continue
            turn = inverse[:, used] @ column[used].astype(float)
            up = np.flatnonzero(turn > 1e-9)
            if not len(up):
                continue
            ratio = x[up] / turn[up]
            out, step = int(up[ratio.argmin()]), float(ratio.min())
            x = np.maximum(x - step * turn, 0.0)
            x[out] = step
            row = inverse[out] / turn[out]
            dual = dual - gain * row
            rows, cols = np.flatnonzero(turn), np.flatnonzero(row)
            inverse[np.ix_(rows, cols)] -= np.outer(turn[rows], row[cols])
            inverse[out] = row
            basis[out] = counts
    return [(basis[k], float(x[k])) for k in range(m)]


@dataclass
class Layout:
    """Where the pieces of each length go by rank: places[length] has rows (first rank, first sequence, offset), in order of rank."""

    size: int
    places: dict[int, np.ndarray]
    placed: dict[int, int]
    tail: dict[int, int]
    tail_sequence: int

    def assign(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, cut, part length, sequence, offset) of each part; a piece of the laid-out rest may have two parts."""
        row = np.arange(len(length))
        sequence, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        rest = np.zeros(len(row), bool)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            table, done = self.places.get(int(n)), self.placed.get(int(n), 0)
            late = rank[own] >= done
            rest[own[late]] = True
            own = own[~late]
            if len(own):
                at = np.searchsorted(table[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = table[at, 1] + rank[own] - table[at, 0], table[at, 2]
            late = np.flatnonzero(rest & (length == n))
            place = self.tail.get(int(n), 0) + (rank[late] - done) * n
            sequence[late], offset[late] = self.tail_sequence + place // self.size, place % self.size
        part = np.minimum(length, self.size - offset)
        more = np.flatnonzero(part < length)
        return (
            np.concatenate([row, more]), np.concatenate([np.zeros(len(row), np.int64), part[more]]), np.concatenate([part, (length - part)[more]]),
            np.concatenate([sequence, sequence[more] + 1]), np.concatenate([offset, np.zeros(len(more), np.int64)]),
        )


def layout(histogram: np.ndarray, size: int = SIZE, tolerance: int = TOLERANCE) -> Layout:
    """Rounds the patterns down and lays out the rest; exact in integers, whatever the linear program returned."""
    left = histogram.astype(np.int64).copy()
    places: dict[int, list[tuple[int, int, int]]] = {}
    placed: dict[int, int] = {}
    sequence = 0

    def use(counts: np.ndarray, n: int) -> None:
        nonlocal sequence
        offset = 0
        for s in np.flatnonzero(counts).tolist()[::-1]:
            for _ in range(int(counts[s])):
                places.setdefault(s, []).append((placed.get(s, 0), sequence, offset))
                placed[s] = placed.get(s, 0) + n
                offset += s
        left[:] -= counts * n
        sequence += n

    full = np.zeros(size + 1, np.int64)
    full[size] = 1
    if left[size]:
        use(full, int(left[size]))
    least, grain = 0, np.arange(size + 1)  # the first program's numbers are rounded down, those for what is left of it are one at least
    while left.any():
        before = sequence
        for counts, x in sorted(patterns(left, size), key=lambda p: -p[1]):
            fits = int(np.min(left[counts > 0] // counts[counts > 0], initial=np.iinfo(np.int64).max)) if counts.any() else 0
            n = min(max(int(x + 1e-6), least), fits)
            if n > 0 and size - int(counts @ grain) <= tolerance:
                use(counts, n)
        if least and sequence == before:
            break
        least = 1
    tail, at = {}, 0
    for s in np.flatnonzero(left).tolist():
        tail[s] = at
        at += s * int(left[s])
    return Layout(size, {s: np.array(v, np.int64) for s, v in places.items()}, placed, tail, sequence)


# ---- over documents -----------------------------------------------------------------------------------------------


def _pieces(tokenizer: str, size: int, end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, dtype)
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                tokens, bounds = encoder.encode(c)
                tokens, bounds = np.insert(tokens, bounds[1:], end), bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                parts = -(-n // size)
                row = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
                length = np.minimum(size, n[row] - start)
                width = tokens.itemsize
                at = np.append(bounds[row] + start, bounds[-1]) * width  # pieces stand end to end
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(tokens.tobytes())])
                take = pa.array(row + c.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(length), pa.array(n[row]), ids],
                    names=["g_row", "doc_id", "start", "length", "doc_tokens", "ids"]
                )

    return run


def tokenised(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, dtype: str = "<u2") -> DataFrame:
    """The pieces before packing, in the shared folder: g_row, doc_id, start, length, doc_tokens, ids (bytes of `dtype`)."""
    rows = with_text(docs.select(F.monotonically_increasing_id().alias("g_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "g_row", "doc_id")
    return written(
        map_arrow(rows, _pieces(tokenizer, size, end, dtype), "g_row bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"),
        "pieces"
    )


def _assigned(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_plan: Layout = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("g_rank").to_numpy()
            row, cut, part, sequence, offset = own_plan.assign(length, rank)
            own = batch.select(["g_row", "doc_id", "start", "doc_tokens"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    own.column(0), own.column(1), own.column(2), pa.array(own.column(2).to_numpy() + cut), pa.array(part), own.column(3),
                    pa.array(sequence), pa.array(offset), pa.array(batch.column("length").to_numpy()[row] != part)
                ],
                names=["g_row", "doc_id", "g_start", "start", "length", "doc_tokens", "sequence_id", "offset", "g_cut"],
            )

    return run


def pack(pieces: DataFrame, size: int = SIZE, tolerance: int = TOLERANCE, bucket: int = BUCKET) -> DataFrame:
    """Of tokenised(): doc_id, start, length, doc_tokens, sequence_id, offset of each piece as packed; g_row, g_start name the stored piece
    that holds its ids, and g_cut says whether it is a part of that piece.  `bucket`: about how many pieces of a length are ranked in one task."""
    spark = pieces.sparkSession
    histogram = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `size` rows
        histogram[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(layout(histogram, size, tolerance))  # of bounded size: the lengths and the patterns
    buckets = F.get(F.lit(np.maximum(1, -(-histogram // bucket)).tolist()), F.col("length").cast("int"))
    keyed = pieces.select("g_row", "doc_id", "start", "length", "doc_tokens", F.pmod(F.xxhash64("g_row", "start"), buckets).alias("g_bucket"))
    sizes = written(keyed.groupBy("length", "g_bucket").agg(F.count("*").alias("g_n")), "length-buckets")
    over = Window.partitionBy("length").orderBy("g_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        F.col("length").alias("b_length"), F.col("g_bucket").alias("b_bucket"), F.coalesce(F.sum("g_n").over(over), F.lit(0)).alias("g_before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "g_bucket").orderBy("doc_id", "g_row", "start")) - 1
    # merged, not broadcast: the ranked pieces lie by length and bucket already
    ranked = keyed.withColumn("g_within", rank).join(before.hint("merge"), (F.col("length") == F.col("b_length")) & (F.col("g_bucket") == F.col("b_bucket")))
    ranked = ranked.select("g_row", "doc_id", "start", "length", "doc_tokens", (F.col("g_within") + F.col("g_before")).cast("long").alias("g_rank"))
    return map_arrow(
        ranked, _assigned(plan),
        "g_row bigint, doc_id bigint, g_start bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, g_cut boolean"
    )


def _checksums(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_py(), dtype).astype("<u4")) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"])

    return run


def checksums(packed: DataFrame, pieces: DataFrame, dtype: str = "<u2") -> DataFrame:
    """`packed` with ids_crc32 of each piece's ids.  Whole pieces are summed where they are stored; only what was cut is looked up and cut."""
    width = np.dtype(dtype).itemsize
    packed = written(packed, "packed")
    stored = written(map_arrow(pieces.select("g_row", "start", "ids"), _checksums(dtype), "g_row bigint, start bigint, ids_crc32 bigint"), "piece-checksums")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = packed.filter("not g_cut").join(stored.withColumnRenamed("start", "g_start"), ["g_row", "g_start"]).select(columns)
    cut = written(packed.filter("g_cut"), "cut-pieces")
    ids = pieces.select("g_row", F.col("start").alias("g_start"), F.col("ids").alias("g_ids"))
    part = F.expr(f"substring(g_ids, cast((start - g_start) * {width} + 1 as int), cast(length * {width} as int))")
    looked = cut.join(ids, ["g_row", "g_start"]).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", part.alias("ids"))
    return whole.unionByName(
        map_arrow(
            looked, _checksums(dtype),
            "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"
        ).select(columns)
    )


def sequences(packed: DataFrame, pieces: DataFrame, dtype: str = "<u2") -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (bytes of `dtype`, pieces in order), doc_ids and starts of the pieces."""
    width = np.dtype(dtype).itemsize
    ids = pieces.select("g_row", F.col("start").alias("g_start"), F.col("ids").alias("g_ids"))
    part = F.expr(f"substring(g_ids, cast((start - g_start) * {width} + 1 as int), cast(length * {width} as int))")
    one = packed.join(ids, ["g_row", "g_start"]).select("sequence_id", F.struct("offset", "length", "doc_id", "start", part.alias("ids")).alias("p"))
    put = one.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))  # at most `size` pieces of one token
    joined = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))")
    return put.select(
        "sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("n_tokens"), joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"),
        F.col("p.start").alias("starts")
    )
