"""Repeated passages by sparse suffix arrays.

Of all word positions, those stay that minimisers select by content: where the hash of the next ``GRAM`` words is least in some
window of ``SPREAD`` positions.  Each retained suffix has the hash of its first ``PREFIX`` = MIN_WORDS - SPREAD + 1 words.  Hashes that
occur once are dropped (counted with partial sums, so a hot passage is no hot task); the other suffixes are sorted by prefix and
place over all tasks by ranges, which split a hot prefix, and each is compared with the neighbour before it.  Neighbours with equal
prefixes match; matches of two documents on one diagonal that touch unite, and are extended to the left and right word by word.
The matched words of the suffix that stands later, by (doc_id, text hash, place), are a repeat.

The neighbour may share fewer words beyond the prefix than a copy before it.  So where three suffixes or more share a prefix, the
windows of MIN_WORDS words about each are hashed too, and every window that is not the first of its hash is a repeat as well.

A passage of MIN_WORDS words or more that occurs twice, in two documents or in one, is always found: both occurrences retain the same
suffix that has PREFIX of the passage's words before it ends.  Passages of PREFIX to MIN_WORDS - 1 words are found where a retained suffix happens to begin
them.  Words are compared with A-Z in lower case, by 64-bit hashes.

Null texts are empty.  Rows with equal doc_id and text are one document; a null doc_id comes first.  Texts of fewer than
MIN_WORDS words have no passage.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, written

MIN_WORDS, SPREAD, GRAM = 50, 11, 8
#: Words that a match is extended by on each side; further on, other retained suffixes of the same passage cover it.
REACH = 16
KEY = ["g_doc", "g_text"]


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """The least (or largest) of each w neighbours, len(x) - w + 1 of them."""
    f = np.minimum if least else np.maximum
    n, done = len(x) - w + 1, 1
    while 2 * done <= w:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[:n], x[w - done : w - done + n])


def retained(h: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, spread: int = SPREAD, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash of the prefix) of the retained suffixes of some documents."""
    prefix = min_words - spread + 1
    n = len(h) - prefix + 1
    if n < spread:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = K.prefix_sums(h)
    at = np.arange(n)
    doc = K.owner(bounds)
    g = K.span_hash(sums, at, at + gram)
    whole = doc[: n - spread + 1] == doc[spread - 1 + prefix - 1 :][: n - spread + 1]  # windows inside a document, prefixes too
    low = np.where(whole, sliding(g, spread, True), np.uint64(0))
    top = sliding(np.concatenate([np.zeros(spread - 1, np.uint64), low, np.zeros(spread - 1, np.uint64)]), spread, False)
    own = np.flatnonzero((top == g) & (top != 0))
    return own, K.span_hash(sums, own, own + prefix)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(2)):
            start, end, bounds = c.words()
            own, prefix = retained(c.hashes(start, end, K.LOWER), bounds)
            doc = np.searchsorted(bounds, own, "right") - 1
            row = pa.array(doc + c.rows.start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array((own - bounds[doc]).astype(np.int32))],
                names=["g_prefix", *KEY, "g_at"]
            )


PLACE = pa.schema(
    [
        ("g_task", pa.int32()), ("g_end", pa.int8()), ("g_prefix", pa.int64()), ("g_doc", pa.int64()), ("g_text", pa.int64()), ("g_at", pa.int32()),
        ("p_doc", pa.int64()), ("p_text", pa.int64()), ("p_at", pa.int32())
    ]
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted suffixes: those equal to the one before, with it; and each task's first (g_end 1) and last (g_end 2) suffix."""
    from pyspark import TaskContext

    task, last = TaskContext.get().partitionId(), None

    def rows(table: pa.Table, end: int, before: pa.Table | None) -> pa.RecordBatch:
        n = table.num_rows
        other = [before.column(k).combine_chunks() for k in (1, 2, 3)] if before is not None else [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, end, np.int8)), *(x.combine_chunks() for x in table.columns), *other],
            schema=PLACE
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).combine_chunks()
        if last is None:
            yield rows(table.slice(0, 1), 1, None)
        else:
            table = pa.concat_tables([last, table]).combine_chunks()
        if table.num_rows > 1:
            prefix = table.column(0).to_numpy()
            same = np.flatnonzero(prefix[1:] == prefix[:-1])
            yield rows(table.take(same + 1), 0, table.take(same))
        last = table.slice(table.num_rows - 1)
    if last is not None:
        yield rows(last, 2, None)


def _pairs(sorted_suffixes: DataFrame) -> DataFrame:
    """Each suffix with the equal one before it: (g_doc, g_text, g_at, p_doc, p_text, p_at); also where a task ends between them."""
    made = written(
        map_arrow(sorted_suffixes, _neighbours, ", ".join(f"{f.name} {dict(int8='tinyint', int32='int', int64='bigint')[str(f.type)]}" for f in PLACE)),
        "neighbours"
    )
    inner = made.filter("g_end = 0")
    # two rows a task: the last suffix of a task is the neighbour of the first of the next one that has any
    ends = made.filter("g_end > 0").groupBy("g_task").agg(
        *(F.max(F.when(F.col("g_end") == k, F.struct("g_prefix", "g_doc", "g_text", "g_at"))).alias(n) for k, n in ((1, "first"), (2, "last")))
    )
    met = ends.withColumn("before", F.lag("last").over(Window.orderBy("g_task"))).filter("before.g_prefix = first.g_prefix")
    across = met.select(*(F.col(f"first.{c}").alias(c) for c in (*KEY, "g_at")), *(F.col(f"before.{c}").alias(f"p{c[1:]}") for c in (*KEY, "g_at")))
    return inner.select(*KEY, "g_at", "p_doc", "p_text", "p_at").unionByName(across).filter("not (g_doc <=> p_doc and g_text = p_text and g_at = p_at)")


def _matches(pairs: DataFrame, prefix: int) -> DataFrame:
    """Pairs of one diagonal whose prefixes touch, united: g_doc, g_text, p_doc, p_text, g_shift, g_from, g_to (words of the later text)."""
    diagonal = [*KEY, "p_doc", "p_text", "g_shift"]
    order = Window.partitionBy(*diagonal).orderBy("g_at")
    shifted = pairs.withColumn("g_shift", F.col("g_at") - F.col("p_at"))
    fresh = F.coalesce((F.col("g_at") - F.lag("g_at").over(order) > prefix).cast("int"), F.lit(1))
    numbered = shifted.withColumn("g_new", fresh).withColumn("g_island", F.sum("g_new").over(order))
    return numbered.groupBy(*diagonal, "g_island").agg(F.min("g_at").alias("g_from"), (F.max("g_at") + prefix).alias("g_to")).drop("g_island")


SIDES = "g_match bigint, g_role int, g_left array<bigint>, g_right array<bigint>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each match that touches a document: the hashes of the words to its left (nearest first) and right."""
    for batch in batches:
        asked = batch.column(1)
        for c in K.chunks(batch.column(0)):
            start, end, bounds = c.words()
            h = c.hashes(start, end, K.LOWER).view(np.int64)
            rows: list[tuple] = []
            for i in range(len(bounds) - 1):
                own = h[bounds[i] : bounds[i + 1]]
                for x in asked[c.rows.start + i].as_py():
                    rows.append((x["g_match"], x["g_role"], own[max(x["a"] - REACH, 0) : x["a"]][::-1], own[x["b"] : x["b"] + REACH]))
            m, r, left, right = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(m, pa.int64()), pa.array(r, pa.int32()), pa.array(list(left), pa.list_(pa.int64())), pa.array(list(right), pa.list_(pa.int64()))],
                names=["g_match", "g_role", "g_left", "g_right"]
            )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("g_doc"), F.xxhash64(text).alias("g_text"), text.alias("text"))


def _extended(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The matches with g_from and g_to moved outwards while both texts agree."""
    ask = lambda role, doc, text, shift: matches.select(F.col(doc).alias("m_doc"), F.col(text).alias("m_text"), F.struct("g_match", F.lit(role).alias("g_role"), (F.col("g_from") - shift).alias("a"), (F.col("g_to") - shift).alias("b")).alias("x"))
    asked = ask(0, "g_doc", "g_text", F.lit(0)).unionAll(
        ask(1, "p_doc", "p_text", F.col("g_shift"))
    ).groupBy("m_doc", "m_text").agg(F.collect_list("x").alias("asked"))
    own = docs.join(asked, F.col("g_doc").eqNullSafe(F.col("m_doc")) & (F.col("g_text") == F.col("m_text"))).select("text", "asked")
    sides = map_arrow(own, _contexts, SIDES).groupBy("g_match").agg(
        *(F.max(F.when(F.col("g_role") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("g_left", "g_right"))
    )

    def agree(side: str):
        least = F.least(F.size(f"{side}0"), F.size(f"{side}1"))
        differ = F.array_position(F.zip_with(f"{side}0", f"{side}1", lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differ > 0, F.least(differ - 1, least)).otherwise(least).cast("int")

    grown = sides.select(F.col("g_match").alias("m_match"), agree("g_left").alias("g_more_left"), agree("g_right").alias("g_more_right"))
    return matches.join(grown, F.col("g_match") == F.col("m_match")).withColumn(
        "g_from", F.col("g_from") - F.col("g_more_left")
    ).withColumn("g_to", F.col("g_to") + F.col("g_more_right"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every window of MIN_WORDS words that holds the prefix of one of a document's suffixes."""
    for batch in batches:
        asked = batch.column(3)
        for c in K.chunks(batch.column(2)):
            start, end, bounds = c.words()
            sums = K.prefix_sums(c.hashes(start, end, K.LOWER))
            for i in range(len(bounds) - 1):
                row, n = c.rows.start + i, int(bounds[i + 1] - bounds[i])
                at = np.unique(np.asarray(asked[row].as_py(), np.int64)[:, None] - np.arange(SPREAD))
                at = at[(at >= 0) & (at <= n - MIN_WORDS)]
                for part in np.array_split(at, len(at) // (1 << 16) + 1):
                    h = K.span_hash(sums, bounds[i] + part, bounds[i] + part + MIN_WORDS).view(np.int64)
                    own = pa.array(np.full(len(part), row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), batch.column(0).take(own), batch.column(1).take(own), pa.array(part.astype(np.int32))],
                        names=["g_window", *KEY, "g_at"]
                    )


def _later_windows(docs: DataFrame, kept: DataFrame, often: DataFrame) -> DataFrame:
    """(g_doc, g_text, g_from, g_to, p_doc): windows that are not the first of their hash, and the document of the first."""
    asked = kept.join(often, "g_prefix", "left_semi").groupBy(
        F.col("g_doc").alias("m_doc"), F.col("g_text").alias("m_text")
    ).agg(F.collect_list("g_at").alias("asked"))
    own = docs.join(asked, F.col("g_doc").eqNullSafe(F.col("m_doc")) & (F.col("g_text") == F.col("m_text"))).select(*KEY, "text", "asked")
    made = written(map_arrow(own, _windows, "g_window bigint, g_doc bigint, g_text bigint, g_at int"), "windows")
    place = F.struct(*KEY, "g_at")
    first = written(made.groupBy("g_window").agg(F.count("*").alias("g_n"), F.min(place).alias("g_first")).filter("g_n > 1").drop("g_n"), "first-windows")
    later = made.join(first, "g_window").filter(~place.eqNullSafe(F.col("g_first")))
    return later.select(*KEY, F.col("g_at").alias("g_from"), (F.col("g_at") + MIN_WORDS).alias("g_to"), F.col("g_first.g_doc").alias("p_doc"))


def spans(docs: DataFrame) -> DataFrame:
    """(g_doc, g_text, g_from, g_to, sources): the repeats of each document in words, united where they touch, with what they repeat."""
    prefix = MIN_WORDS - SPREAD + 1
    keyed = _keyed(docs)
    suffixes = written(map_arrow(keyed.select(*KEY, "text"), _suffixes, "g_prefix bigint, g_doc bigint, g_text bigint, g_at int"), "suffixes")
    twice = written(
        suffixes.groupBy("g_prefix").agg(F.count("*").alias("g_n")).filter("g_n > 1"), "repeated-prefixes"
    )  # apart, so that the join below can be split
    kept = written(suffixes.join(twice, "g_prefix", "left_semi"), "repeated-suffixes")
    windows = _later_windows(keyed, kept, twice.filter("g_n > 2"))
    ordered = kept.repartitionByRange("g_prefix", *KEY, "g_at").sortWithinPartitions("g_prefix", *KEY, "g_at")
    matches = written(_matches(_pairs(ordered), prefix).withColumn("g_match", F.monotonically_increasing_id()), "matches")
    grown = _extended(keyed, matches).select(*KEY, "g_from", "g_to", "p_doc").unionByName(windows)
    order = Window.partitionBy(*KEY).orderBy("g_from", "g_to")
    fresh = F.coalesce((F.col("g_from") > F.max("g_to").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    return grown.withColumn("g_new", fresh).withColumn("g_island", F.sum("g_new").over(order)).groupBy(*KEY, "g_island").agg(
        F.min("g_from").alias("g_from"), F.max("g_to").alias("g_to"), F.collect_set("p_doc").alias("sources")
    ).drop("g_island")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document with repeats: doc_id, n_spans, n_words (in repeats), spans (start and end in words, in order), source_ids (sorted)."""
    span = F.sort_array(F.collect_list(F.struct(F.col("g_from").alias("start"), F.col("g_to").alias("end")))).alias("spans")
    found = spans(docs).groupBy(*KEY).agg(
        F.count("*").alias("n_spans"), F.sum(F.col("g_to") - F.col("g_from")).alias("n_words"), span,
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_ids")
    )
    return found.select(F.col("g_doc").alias("doc_id"), "n_spans", "n_words", "spans", "source_ids")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the spans of words in the last column out of ``text``, with the white space before each word."""
    for batch in batches:
        at, gone = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1)
        texts = batch.column(at).to_pylist()
        for c in K.chunks(batch.column(at)):
            start, end, bounds = c.words()
            raw = c.data.tobytes()
            for i in range(len(bounds) - 1):
                if not (drop := gone[c.rows.start + i].as_py()):
                    continue
                own, stop = slice(bounds[i], bounds[i + 1]), int(c.offsets[i + 1])
                parts, place = [], int(c.offsets[i])
                for s in sorted(drop, key=lambda s: s["g_from"]):
                    first = int(end[own][s["g_from"] - 1]) if s["g_from"] else int(c.offsets[i])
                    parts.append(raw[place:first])
                    place = int(end[own][s["g_to"] - 1])
                texts[c.rows.start + i] = b"".join([*parts, raw[place:stop]]).decode()
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, batch.schema.field(at).type) if k == at else x for k, x in enumerate(batch.columns[:-1])], names=batch.schema.names[:-1]
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with all repeats cut out of the texts; columns as in `docs`."""
    gone = spans(docs).groupBy(F.col("g_doc").alias("m_doc"), F.col("g_text").alias("m_text")).agg(F.collect_list(F.struct("g_from", "g_to")).alias("g_gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    both = docs.withColumn("text", text).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("m_doc")) & (F.xxhash64(text) == F.col("m_text")), "left")
    return map_arrow(both.select(*docs.columns, "g_gone"), _cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
