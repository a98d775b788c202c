"""Token-ID output: documents in ascending doc_id order as Simple-8b shards in the shared folder, and back.

Documents are dealt to tasks by ranges of doc_id and a hash of the text, so that rows with one id, or none, can lie in several.  A task
writes shards of ``SHARD_IDS`` ids or ``SHARD_DOCUMENTS`` documents, whichever comes first, so a shard's directory is bounded, and holds some hundred
thousand ids at once.  Shards are sorted and follow each other.  A shard is written under a name of its attempt and moved into place
when whole: a task that is run again after a lost executor replaces it by the same bytes.  The manifest has a row a shard.

Null texts are empty and have the end id alone; a null doc_id comes first.  Rows with equal doc_id are ordered by the hash of their texts, and
each is a document.  An empty table makes no shards and reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import simple8b
from .common import file_system, map_arrow, put_in_place, scratch_path, with_text, written
from .tokens import Encoder

END = 2
#: A shard has about so many ids or documents at most, or one longer document.
SHARD_IDS, SHARD_DOCUMENTS = 1 << 26, 1 << 18
#: Stands for a null doc_id in shard files.
NO_ID = -(1 << 63)


MANIFEST = "shard bigint, file string, documents bigint, tokens bigint"


class _Shard:
    """One shard file of a task's attempt."""

    def __init__(self, fs, base: str, task: int, attempt: int, number: int):
        self.fs, self.name, self.number = fs, f"shard-{task:06d}-{number:06d}.s8b", (task << 32) + number
        self.part, self.target = f"{base}/.part-{task:06d}-{number:06d}-{attempt}", f"{base}/{self.name}"
        self.out = fs.open_output_stream(self.part)
        self.writer, self.tokens = simple8b.Writer(self.out), 0

    def add(self, ids: list[int], tokens: np.ndarray, counts: np.ndarray) -> None:
        self.writer.add(ids, tokens, counts)
        self.tokens += len(tokens)

    def close(self) -> pa.RecordBatch:
        """Moves the file into place; returns its row of the manifest."""
        n = self.writer.close()
        self.out.close()
        put_in_place(self.fs, self.part, self.target)
        long = pa.int64()
        return pa.RecordBatch.from_pydict(
            {"shard": pa.array([self.number], long), "file": [self.name], "documents": pa.array([len(self.writer.ids)], long), "tokens": pa.array([n], long)}
        )


def _writer(folder: str, tokenizer: str, end: int, shard_ids: int, shard_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = file_system(folder)
        encoder, shard, number = Encoder(tokenizer), None, 0
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for c in K.chunks(text, min(K.CHUNK, 4 * shard_ids)):
                tokens, bounds = encoder.encode(c)
                if shard is None:
                    shard = _Shard(fs, base, task.partitionId(), task.taskAttemptId(), number)
                shard.add(ids[c.rows].fill_null(NO_ID).to_pylist(), np.insert(tokens, bounds[1:], end), np.diff(bounds) + 1)
                if shard.tokens >= shard_ids or len(shard.writer.ids) >= shard_documents:
                    yield shard.close()
                    shard, number = None, number + 1
        if shard is not None:
            yield shard.close()

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, shard_ids: int = SHARD_IDS, shard_documents: int = SHARD_DOCUMENTS
) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and the manifest (shard, file, documents, tokens, start: ids in all shards before)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    named = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").withColumn("g_hash", F.xxhash64("text"))
    ordered = named.repartitionByRange("doc_id", "g_hash").sortWithinPartitions("doc_id", "g_hash", "text").drop("g_hash")
    shards = written(map_arrow(ordered, _writer(folder, tokenizer, end, shard_ids, shard_documents), MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return folder, shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    rows: list[tuple] = []
                    for doc_id, at, parts in simple8b.Reader(f).documents():
                        crc = n = 0
                        for part in parts:
                            crc, n = zlib.crc32(part.astype("<u4"), crc), n + len(part)
                        rows.append((None if doc_id == NO_ID else doc_id, start + at, n, crc))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32; a task a shard."""
    shards = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return map_arrow(shards, _reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
