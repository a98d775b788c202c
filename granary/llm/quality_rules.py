"""Quality rules with cross-document line frequency.

Normalised lines are hashed, distinct documents are counted per host and line, lines above the host's limit are removed,
and documents that lose most of their words with them are rejected.

* host: the column ``source`` (null is a host of its own);
* normalised line: its words, A-Z in lower case, each digit as 0, joined by one space; lines without words don't count;
* documents of a host with equal texts count once, so that a group of copies is no evidence for boilerplate;
* limit of a host: ``max(min_documents, share * its distinct documents)``; a line is removed when more hold it;
* rejected: when ``100 * removed words > depleted_percent * words``, or by the base rules.

Null and empty texts have no words and fail the base rules.  Ties and repeated rows: every row is judged by its own
text and host, so equal rows get equal verdicts.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, with_text, written

MIN_DOCUMENTS, SHARE, DEPLETED_PERCENT = 20, 0.005, 70
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = "g_id bigint, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, g_text binary, g_lines array<bigint>, g_counts array<int>"


def _normal(c: K.Chunk, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of each normalised line, from those of its words first .. last - 1."""
    return K.hashed(c.hashes(start, end, K.NORMAL).view(np.uint8), 8 * first, 8 * last)


def measures(c: K.Chunk) -> dict[str, np.ndarray]:
    """The base measures of a chunk's documents, and for each document its distinct normalised lines with their words."""
    start, end, bounds = c.words()
    n_words = np.diff(bounds)
    doc = K.owner(bounds).astype(np.uint64)
    leads = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    word = c.hashes(start, end)
    sums = K.prefix_sums(word)
    window = np.arange(max(len(start) - WINDOW + 1, 0))
    window = window[doc[window] == doc[window + WINDOW - 1]] if len(window) else window
    twice, _ = K.repeated(K.span_hash(sums, window, window + WINDOW) ^ K.mixed(doc[window]))
    in_repeat = K.covered(window[twice], WINDOW, len(start))

    line_start, line_end, line_bounds = c.lines()
    line_doc = K.owner(line_bounds)
    first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    has_word = np.flatnonzero(last > first)
    _, later = K.repeated(c.hashes(line_start[has_word], line_end[has_word]) ^ K.mixed(line_doc[has_word].astype(np.uint64)))
    n = len(c.offsets) - 1
    normal = _normal(c, start, end, first[has_word], last[has_word])
    return {
        "n_words": n_words, "word_chars": K.sums_of(leads[end] - leads[start], bounds), "n_symbols": K.sums_of(SYMBOLS[c.data], c.offsets),
        "n_dup_lines": np.bincount(line_doc[has_word][later], minlength=n), "n_repeat_words": K.sums_of(in_repeat, bounds),
        "line_doc": line_doc[has_word], "line": normal.view(np.int64), "line_words": (last - first)[has_word],
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, source, digest, text = (batch.column(k) for k in range(4))
        for c in K.chunks(text):
            m, n = measures(c), len(c.offsets) - 1
            lines, counts, sizes = [], [], []
            bounds = np.searchsorted(m["line_doc"], np.arange(n + 1))
            for i in range(n):
                at, by = np.unique(m["line"][bounds[i] : bounds[i + 1]], return_inverse=True)
                lines.append(at)
                counts.append(np.bincount(by, m["line_words"][bounds[i] : bounds[i + 1]], minlength=len(at)).astype(np.int32))
                sizes.append(len(at))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids[c.rows], source[c.rows],
                    *(pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    digest[c.rows], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lines) if lines else [], pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts) if counts else [], pa.int32()))
                ],
                names=["g_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "g_text", "g_lines", "g_counts"],
            )


def frequent_lines(measured: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(source, g_line) above its host's limit.  Counts are summed before each shuffle, so a hot host or line is no hot task."""
    distinct = measured.groupBy("source", "g_text").agg(F.first("g_lines").alias("g_lines"))
    hosts = distinct.groupBy(F.col("source").alias("g_host")).agg(F.count("*").alias("g_size"))
    return (
        distinct.select("source", F.explode("g_lines").alias("g_line")).groupBy("source", "g_line").agg(F.count("*").alias("g_n"))
        .filter(F.col("g_n") > min_documents)
        .join(hosts, F.col("source").eqNullSafe(F.col("g_host")))
        .filter(F.col("g_n") > F.lit(float(share)) * F.col("g_size")).select("source", "g_line")
    )


def _digest() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _judged(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE, depleted_percent: int = DEPLETED_PERCENT, id_column: str = "doc_id"
) -> DataFrame:
    """quality_rules() with the host, source, and the text's digest, g_text, of each row.

    Frequent lines meet documents in a join on (host, line) whose small side is unique, and AQE splits what a hot line makes large.
    """
    named = docs.select(F.col(id_column).cast("long").alias("g_id"), F.col("source").cast("string").alias("source"), _digest().alias("g_text"), "text")
    measured = written(
        map_arrow(with_text(named, "g_id", "source", "g_text"), _measured, MEASURES).withColumn("g_row", F.monotonically_increasing_id()),
        "line-measures"
    )
    frequent = written(frequent_lines(measured, min_documents, share), "frequent-lines")
    lines = measured.select("g_row", "source", F.explode(F.arrays_zip("g_lines", "g_counts")).alias("g"))
    lines = lines.select("g_row", F.col("source").alias("g_of"), F.col("g.g_lines").alias("g_at"), F.col("g.g_counts").alias("g_words"))
    lost = (
        lines.join(frequent, F.col("g_of").eqNullSafe(F.col("source")) & (F.col("g_at") == F.col("g_line")))
        .groupBy(F.col("g_row").alias("g_hit")).agg(F.sum("g_words").alias("removed_words"), F.collect_list("g_line").alias("removed_lines"))
    )
    removed = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.join(lost, F.col("g_row") == F.col("g_hit"), "left").select(
        "source", "g_text", F.col("g_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", removed.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"), failed.alias("base_failed"), (
            ~failed & (100 * removed <= depleted_percent * F.col("n_words"))
        ).alias("kept"),
    )


def quality_rules(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of `docs`: its id, the base measures, removed_words, the removed lines' hashes, base_failed and kept."""
    return _judged(docs, **parameters).drop("source", "g_text")


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the lines whose hashes are listed in the last column out of ``text``."""
    for batch in batches:
        at, gone = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1)
        texts = batch.column(at).to_pylist()
        for c in K.chunks(batch.column(at)):
            hit = [i for i in range(c.rows.start, c.rows.stop) if len(gone[i])]
            if not hit:
                continue
            start, end, _ = c.words()
            line_start, line_end, line_bounds = c.lines()
            first, last = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
            line = _normal(c, start, end, first, last).view(np.int64)
            for i in hit:
                own = slice(*line_bounds[i - c.rows.start : i - c.rows.start + 2])
                drop = np.isin(line[own], np.asarray(gone[i].as_py(), np.int64)) & (last[own] > first[own])
                texts[i] = "\n".join(x for x, d in zip(texts[i].split("\n"), drop, strict=True) if not d)
        columns = [pa.array(texts, batch.schema.field(at).type) if k == at else x for k, x in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def apply_rules(docs: DataFrame, **parameters) -> DataFrame:
    """The pipeline's stage: rejected documents go, frequent lines leave the texts of the others; the columns stay those of `docs`.

    A verdict belongs to a host and a text, whatever the ids are: rows without an id are judged like others, and of rows with one id each goes or
    stays by itself.  A verdict is one row where documents meet it, so that AQE can split a text that very many share.
    """
    verdict = _judged(docs, **parameters).filter("kept").groupBy("source", "g_text").agg(F.first("removed_lines").alias("g__gone"))
    named = verdict.select(F.col("source").alias("g__host"), F.col("g_text").alias("g__digest"), "g__gone")
    kept = docs.join(named, F.col("source").cast("string").eqNullSafe(F.col("g__host")) & (_digest() == F.col("g__digest")))
    texts = kept.select(*docs.columns, "g__gone").withColumn("text", F.coalesce("text", F.lit("")))
    out = map_arrow(texts, _stripped, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS h FROM documents),
ws AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM ws),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS gram
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) > 1 AND gram IS NOT NULL AS twice FROM g),
g3 AS (SELECT r, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM g2),
rep AS (SELECT r, sum(hit) AS n_repeat_words FROM g3 GROUP BY r),
l0 AS (SELECT r, source, h, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT r, source, h, line, regexp_extract_all(translate(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '123456789', '000000000'), '[^\\x20\\x09-\\x0D]+') AS lw FROM l0),
l AS (SELECT r, source, h, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM l1 WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
host AS (SELECT source, count(DISTINCT h) AS size FROM d GROUP BY source),
freq AS (SELECT l.source, norm FROM l JOIN host ON l.source IS NOT DISTINCT FROM host.source GROUP BY l.source, norm, size
         HAVING count(DISTINCT h) > {MIN_DOCUMENTS} AND count(DISTINCT h) > {SHARE} * size),
gone AS (SELECT r, sum(n) AS removed_words FROM l JOIN freq ON l.norm = freq.norm AND l.source IS NOT DISTINCT FROM freq.source GROUP BY r),
m AS (SELECT d.r, doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN wc USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, NOT base_failed AND 100 * removed_words <= {DEPLETED_PERCENT} * n_words AS kept FROM f
"""
