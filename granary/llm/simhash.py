"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits.  Two fingerprints within `distance` = 3 bits differ by at most one bit in one of the two 32-bit
segments.  So each segment has a table of its values, each fingerprint asks it for every value of the Hamming ball of radius
one about its own (33 keys), and what it fetches is verified by the complete distance.

Work is done on distinct fingerprints: copies are one row.  A group of near copies would still make links in the square of
its size, so fingerprints whose segment value many share (``CROWD``) are linked first through meeting points: the ball of
radius one about each (65 keys) is grouped by key, and members of a group, being within two bits of each other, are linked
to its least in a star.  The fetch then only asks for links between different groups of that first pass.  Components are
the same as those of all links.

Null texts are empty; texts without words have the fingerprint zero and are linked like any others.  Rows with an equal
doc_id and text are one document; an empty table gives an empty result.

The pipeline's stage (`keep_one`) links, besides, every two texts whose sets of shingles have a Jaccard similarity of ``SIMILAR``
or more, which differ by far more than three bits.  Candidates share one of ``BANDS`` keys of ``ROWS`` least hashes each (a pair
at the limit shares none with a chance of 3 in a million, more similar ones with less), and each is verified by its complete sets.
Equal sets are one node.  The members of a key are first verified against one of them, another for each key; after that only
members of different groups are, so that a group of near copies makes no pairs in the square of its size.  Of these, pairs are left out
that cannot be similar: where too many shingles of one stand in no other set, an exact bound that takes out copies with many
edits of their own before they are paired, and where signatures of four bits a least hash differ in more places than those of
similar sets do but once in some 100,000 times.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, shuffled, with_text, written
from .components import components

DISTANCE, CROWD, SHINGLE = 3, 32, 3
SIMILAR, BANDS, ROWS = 0.8, 24, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a text that are held at once where it is very long.
BLOCK = 1 << 16


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    if len(text) <= 16 * BLOCK:
        yield WORD.findall(text)
        return
    words = (m[0] for m in WORD.finditer(text))
    while block := list(itertools.islice(words, BLOCK)):
        yield block


def fingerprint(text: str | bytes, size: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of the shingles, repeats included; no words: zero."""
    import xxhash

    digest, total, n, words = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def count(grams: list[bytes]) -> None:
        nonlocal total, n
        for at in range(0, len(grams), 8192):
            h = np.array([digest(g, 42) for g in grams[at : at + 8192]], dtype="<u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(grams)

    for block in _blocks((text.encode() if isinstance(text, str) else text).translate(_LOWER)):
        words += block
        count([b" ".join(g) for g in zip(*(words[k:] for k in range(size)), strict=False)])
        words = words[max(len(words) - size + 1, 0) :]
    if not n and words:
        count([b" ".join(words)])
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(x, size) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], names=["doc_id", "g_print"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, g_print): the fingerprint as a signed long."""
    return map_arrow(
        with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), _fingerprints(size), "doc_id bigint, g_print bigint"
    )


def _halves(column) -> list:
    return [F.shiftrightunsigned(column, 32), column.bitwiseAND(F.lit(0xFFFFFFFF))]


def _balls(prints: DataFrame, bits: int, *keep: str) -> DataFrame:
    """Each print's segment values with at most one bit turned; bits = 64: the ball about the whole print."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(bits)))
    if bits == 64:
        return prints.select(*keep, F.explode(F.transform(flips, lambda x: F.col("g_print").bitwiseXOR(x))).alias("g_key"))
    halves = F.array(*(F.struct(F.lit(k).alias("s"), h.alias("v")) for k, h in enumerate(_halves(F.col("g_print")))))
    asked = F.flatten(F.transform(halves, lambda h: F.transform(flips, lambda x: F.struct(h["s"].alias("s"), h["v"].bitwiseXOR(x).alias("v")))))
    return prints.select(*keep, F.explode(asked).alias("g")).select(*keep, F.col("g.s").alias("g_segment"), F.col("g.v").alias("g_key"))


def _table(prints: DataFrame, *keep: str) -> DataFrame:
    halves = F.array(*(F.struct(F.lit(k).alias("s"), h.alias("v")) for k, h in enumerate(_halves(F.col("g_print")))))
    return prints.select(*keep, F.explode(halves).alias("g")).select(*keep, F.col("g.s").alias("g_segment"), F.col("g.v").alias("g_key"))


def print_components(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """From distinct g_print: (node, component) for the prints that have a link; component is the least print, as a signed long."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one find distances up to three")
    crowded = _table(prints, "g_print").groupBy("g_segment", "g_key").agg(F.count("*").alias("g_n")).filter(F.col("g_n") >= crowd)
    dense = _table(prints, "g_print").join(crowded, ["g_segment", "g_key"], "left_semi").select("g_print").distinct()
    dense = written(dense, "crowded-prints")
    meet = _balls(dense, 64, "g_print")
    star = meet.groupBy("g_key").agg(F.min("g_print").alias("g_least"), F.count("*").alias("g_n")).filter("g_n > 1").drop("g_n")
    near = meet.join(shuffled(written(star, "meeting-points")), "g_key").filter("g_print != g_least").select(
        F.col("g_least").alias("a"), F.col("g_print").alias("b")
    ).distinct() if distance >= 2 else None
    first = written(components(near), "first-groups") if near is not None else None
    grouped = prints.join(first, F.col("g_print") == F.col("node"), "left").select(
        "g_print", F.coalesce("component", "g_print").alias("g_group")
    ) if first is not None else prints.withColumn("g_group", F.col("g_print"))
    grouped = written(grouped, "prints")
    asked = _balls(grouped, 32, "g_print", "g_group")
    held = _table(
        grouped.select(F.col("g_print").alias("h_print"), F.col("g_group").alias("h_group")).withColumn("g_print", F.col("h_print")), "h_print",
        "h_group"
    )
    close = F.bit_count(F.col("g_print").bitwiseXOR(F.col("h_print"))) <= distance
    links = asked.join(
        shuffled(held), (asked.g_segment == held.g_segment) & (asked.g_key == held.g_key) & (F.col("g_group") < F.col("h_group")) & close
    ).select(F.col("g_group").alias("a"), F.col("h_group").alias("b")).distinct()
    if first is not None:
        links = links.unionAll(first.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return components(links)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Every row is joined once to its fingerprint's class; a class that many rows share is split by AQE, as it is unique on the other side.
    """
    prints = written(fingerprints(docs, size), "fingerprints")
    classes = written(prints.groupBy("g_print").agg(F.min("doc_id").alias("g_first")), "print-classes")
    found = print_components(classes.select("g_print"), distance, crowd)
    linked = classes.join(found, F.col("g_print") == F.col("node"), "left").withColumn("g_top", F.coalesce("component", "g_print"))
    least = linked.groupBy("g_top").agg(F.min("g_first").alias("component_id"))
    named = linked.select("g_print", "g_top").join(least, "g_top").select(F.col("g_print").alias("g_of"), "component_id")
    return prints.join(named, F.col("g_print") == F.col("g_of")).select(
        "doc_id", F.lower(F.lpad(F.hex("g_print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingles(c: K.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each document's distinct shingles, sorted, and where each document's begin; fewer words than `size` are one shingle."""
    start, end, bounds = c.words()
    sums, n = K.prefix_sums(c.hashes(start, end, K.LOWER)), np.diff(bounds)
    first = np.concatenate([[0], np.cumsum(np.where(n < size, n > 0, n - size + 1))])
    doc = K.owner(first)
    at = np.arange(len(doc)) - first[doc] + bounds[doc]
    g = K.span_hash(sums, at, np.minimum(at + size, bounds[doc + 1]))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def least_hashes(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least hashes of each set, a column each; `starts` has the sets' first hashes, none is empty."""
    salt, factor = K.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)), K.mixed(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((g ^ salt[k]) * factor[k], starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set, from its least hashes."""
    keys = np.empty((len(least), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(least), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = K.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
        keys[:, b] = key
    return keys


def signatures(least: np.ndarray) -> np.ndarray:
    """Four bits of each least hash, sixteen to a word."""
    nibbles = (K.mixed(least) & np.uint64(15)).reshape(len(least), -1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def _described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                g, first = shingles(c, size)
                has = np.diff(first) > 0
                keys, sets = np.zeros((0, BANDS), np.uint64), np.zeros(len(has), np.uint64)
                if has.any():
                    keys = band_keys(least_hashes(g, first[:-1][has]))
                    sets[has] = K.mixed(np.add.reduceat(K.mixed(g), first[:-1][has]) + np.diff(first)[has].astype(np.uint64))
                raw = c.data.tobytes()
                prints = np.array([fingerprint(raw[a:b], size) for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)], np.uint64)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[c.rows], batch.column(1)[c.rows], pa.array(prints.view(np.int64)), pa.array(sets.view(np.int64), mask=~has),
                        pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64)))
                    ],
                    names=["g_doc", "g_text", "g_print", "g_set", "g_bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = BANDS * ROWS // 16
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                g, first = shingles(c, size)
                has, signed = np.diff(first) > 0, np.zeros((len(first) - 1, words), np.uint64)
                if has.any():
                    signed[has] = signatures(least_hashes(g, first[:-1][has]))
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))
                    for ends, x in ((first, g), (np.arange(len(first)) * words, signed.ravel()))
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], *lists], names=["g_set", "g_shingles", "g_signature"])

    return run


def _may_be_similar(one: str, other: str, similar: float) -> F.Column:
    """Whether signatures differ in so few places as sets of that similarity do but once in about 100,000 times (a binomial's tail)."""
    n = BANDS * ROWS
    p = (1 - similar) * 15 / 16
    most = int(n * p + 4.4 * (n * p * (1 - p)) ** 0.5 + 1)

    def differ(k: int) -> F.Column:
        x = F.get(one, k).bitwiseXOR(F.get(other, k))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return functools.reduce(lambda a, b: a + b, (differ(k) for k in range(n // 16))) <= most


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    for end in "ab":
        own = sets.select(F.col("g_set").alias(f"g_of_{end}"), F.col("g_shingles").alias(f"g_{end}"))
        pairs = pairs.join(shuffled(own), F.col(end) == F.col(f"g_of_{end}"))
    total, both = F.size("g_a") + F.size("g_b"), F.size(F.array_intersect("g_a", "g_b"))
    # sets too unequal in size are left out before they are compared
    may = F.least(F.size("g_a"), F.size("g_b")) >= F.lit(similar) * F.greatest(F.size("g_a"), F.size("g_b")) - 1e-9
    return pairs.filter(F.when(may, both >= F.lit(similar) * (total - both) - 1e-9).otherwise(False)).select("a", "b")


def _shared(sets: DataFrame) -> DataFrame:
    """(u_set, u_size, g_shared): of each set's shingles, how many stand in another of the sets too."""
    each = written(sets.select("g_set", F.explode("g_shingles").alias("g_shingle")), "set-shingles")
    often = written(each.groupBy("g_shingle").agg(F.count("*").alias("g_n")).filter("g_n > 1").select("g_shingle"), "shared-shingles")
    counted = each.join(often, "g_shingle", "left_semi").groupBy(F.col("g_set").alias("u_set")).agg(F.count("*").alias("g_shared"))
    size = sets.select("g_set", F.size("g_shingles").alias("u_size"))
    return counted.join(size, F.col("u_set") == F.col("g_set")).drop("g_set")


def similar_sets(described: DataFrame, keyed: DataFrame, similar: float, size: int) -> DataFrame:
    """Links (a, b) of g_set whose components are those of all similar pairs; `keyed` has g_doc, g_text, text."""
    sets = described.filter("g_set is not null").groupBy("g_set").agg(F.min(F.struct("g_doc", "g_text")).alias("g_row"), F.first("g_bands").alias("g_bands"))
    keys = written(sets.select("g_set", "g_row", F.explode("g_bands").alias("g_key")), "band-keys")
    hubs = keys.groupBy("g_key").agg(
        F.count("*").alias("g_n"), F.min(F.struct(F.xxhash64("g_set", "g_key"), "g_set"))["g_set"].alias("g_hub")
    ).filter("g_n > 1").drop("g_n")
    members = written(keys.join(written(hubs, "band-hubs"), "g_key"), "band-members")
    asked = members.select("g_set", F.col("g_row.g_doc").alias("m_doc"), F.col("g_row.g_text").alias("m_text")).distinct()
    own = keyed.join(asked, F.col("g_doc").eqNullSafe(F.col("m_doc")) & (F.col("g_text") == F.col("m_text"))).select("g_set", "text")
    found = written(map_arrow(own, _sets(size), "g_set bigint, g_shingles array<bigint>, g_signature array<bigint>").dropDuplicates(["g_set"]), "shingle-sets")
    ordered = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    tried = written(members.filter("g_set != g_hub").select(*ordered("g_set", "g_hub")).distinct(), "hub-pairs")
    links = written(_verified(tried, found, similar), "hub-links")
    groups = components(links)
    grouped = members.join(groups, F.col("g_set") == F.col("node"), "left").select("g_key", "g_set", F.coalesce("component", "g_set").alias("g_group"))
    grouped = written(grouped, "band-groups")
    several = written(grouped.groupBy("g_key").agg(F.min("g_group").alias("x"), F.max("g_group").alias("y")).filter("x < y").select("g_key"), "mixed-bands")
    signed = found.select(F.col("g_set").alias("s_set"), F.col("g_signature").alias("g_signed"), F.size("g_shingles").alias("g_size"))
    mixed = written(grouped.join(several, "g_key", "left_semi"), "mixed-members")
    shared = _shared(found.join(mixed.select("g_set").distinct(), "g_set", "left_semi")).filter(F.col("g_shared") >= F.lit(similar) * F.col("u_size") - 1e-9)
    left = mixed.join(signed, F.col("g_set") == F.col("s_set")).join(shared, F.col("g_set") == F.col("u_set")).drop("s_set", "u_set", "u_size")
    left = written(left, "mixed-sets")
    other = left.select(*(F.col(c).alias(c.replace("g_", "h_")) for c in ("g_key", "g_set", "g_group", "g_signed", "g_size", "g_shared")))
    # two sets have no more in common than either shares with any, and no fewer in all than what each has alone and the larger shared part
    most = F.least("g_shared", "h_shared")
    least = F.col("g_size") - F.col("g_shared") + F.col("h_size") - F.col("h_shared") + F.greatest("g_shared", "h_shared")
    bound = most >= F.lit(similar) * F.greatest(least, "g_size", "h_size") - 1e-9
    may = (F.col("g_key") == F.col("h_key")) & (F.col("g_group") < F.col("h_group")) & bound & _may_be_similar("g_signed", "h_signed", similar)
    pairs = left.join(shuffled(other), may).select(*ordered("g_set", "h_set")).distinct()
    return links.unionAll(_verified(written(pairs.join(tried, ["a", "b"], "left_anti"), "band-pairs"), found, similar))


def keep_one(docs: DataFrame, distance: int = DISTANCE, size: int = 5, similar: float = SIMILAR) -> DataFrame:
    """The pipeline's stage: of each component the first document, by doc_id and text, stays, once; columns as in `docs`.

    Texts are linked by fingerprints within `distance` bits, and by shingle sets of Jaccard similarity `similar` or more.
    Ids decide nothing but which of a component stays, one with an id first: rows without a doc_id are judged like others, and
    rows with one doc_id and texts that are not linked all stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("g_doc"), F.xxhash64(text).alias("g_text"), text.alias("text"))
    described = written(map_arrow(keyed, _described(size), "g_doc bigint, g_text bigint, g_print bigint, g_set bigint, g_bands array<bigint>"), "described")
    prints = described.select("g_print").distinct()
    close = print_components(written(prints, "print-classes"), distance).select(F.col("component").alias("a"), F.col("node").alias("b"))
    # what links sets links the least prints of each, and a set's prints are linked to its least
    owners = written(described.filter("g_set is not null").select("g_set", "g_print").distinct(), "set-prints")
    least = written(owners.groupBy("g_set").agg(F.min("g_print").alias("g_least")), "set-least-prints")
    alike = owners.join(least, "g_set").filter("g_print != g_least").select(F.col("g_least").alias("a"), F.col("g_print").alias("b"))
    sets = similar_sets(described, keyed, similar, size)
    for end in "ab":
        sets = sets.join(least.select(F.col("g_set").alias(f"g_of_{end}"), F.col("g_least").alias(f"g_{end}")), F.col(end) == F.col(f"g_of_{end}"))
    found = components(close.unionAll(alike).unionAll(sets.select(F.col("g_a").alias("a"), F.col("g_b").alias("b"))))
    linked = described.join(found, F.col("g_print") == F.col("node"), "left").select("g_doc", "g_text", F.coalesce("component", "g_print").alias("g_top"))
    row = F.struct(F.col("g_doc").isNull().alias("x"), F.col("g_doc").alias("g_id"), F.col("g_text").alias("g_of"))
    kept = linked.groupBy("g_top").agg(F.min(row).alias("g_row")).select("g_row.g_id", "g_row.g_of")
    named = docs.withColumn("g_stay", F.xxhash64(text))
    once = named.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("g_id")) & (F.col("g_stay") == F.col("g_of")), "left_semi")
    return once.dropDuplicates(["doc_id", "g_stay"]).drop("g_stay")
