"""Quality classifier: regularised quadratic discriminant analysis over statistics of whole texts.

Each text gives a vector of statistics, transformed to be nearer to normal.  The training rows' counts, sums and products per
class are added up over all of them (no sample), so the driver gets a few hundred numbers.  A class covariance S becomes
``(1 - pooling) S + pooling P``, P the pooled one, then ``(1 - shrinkage) S + shrinkage tr(S)/p I``.  Its Cholesky factor is kept;
a text's score is the logistic of the difference of log densities (Mahalanobis distance and log determinant) and log priors.

Null texts are empty and are scored like any text.  Labels that are null are dropped; repeated label rows count as often as
they stand there.  With no training rows of a class every score is the share of label 1 (0.5 without any labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, with_text, written
from .quality_rules import measures

SHRINKAGE, POOLING = 0.05, 0.1
STATISTICS = ("n_words", "n_lines", "word_length", "symbols", "digits", "capitals", "points", "word_spread", "dup_lines", "repeats", "variety", "line_words")


def statistics(c: K.Chunk) -> np.ndarray:
    """A row of transformed statistics for each document of a chunk; only the text counts."""
    start, end, bounds = c.words()
    m = measures(c)
    n = m["n_words"].astype(float)
    some, chars = np.maximum(n, 1), np.maximum(m["word_chars"], 1)
    lines = K.sums_of(c.data == 10, c.offsets) + 1.0

    def share(mask: np.ndarray) -> np.ndarray:
        return K.sums_of(mask, c.offsets) / chars

    leads = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
    length = leads[end] - leads[start]
    mean = m["word_chars"] / some
    spread = np.sqrt(np.maximum(K.sums_of(length * length, bounds) / some - mean * mean, 0))
    _, later = K.repeated(c.hashes(start, end, K.LOWER) ^ K.mixed(K.owner(bounds).astype(np.uint64)))
    variety = 1 - K.sums_of(later, bounds) / some
    d = c.data
    return np.column_stack([
        np.log1p(n), np.log1p(lines), np.log1p(mean), np.sqrt(m["n_symbols"] / chars), np.sqrt(share((d >= 48) & (d <= 57))), np.sqrt(share((d >= 65) & (d <= 90))),
        np.sqrt(
            share(np.isin(d, np.frombuffer(b".,;:!?", np.uint8)))
        ), np.log1p(spread), np.sqrt(m["n_dup_lines"] / lines), np.sqrt(m["n_repeat_words"] / some), variety, np.log1p(n / lines),
    ])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in K.chunks(batch.column(1)):
            x = statistics(c)
            bounds = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0)[c.rows], pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], names=["doc_id", "g_x"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a task's rows: place in (1, x)(1, x)' and its sum."""
    p = len(STATISTICS) + 1
    total = np.zeros((2, p, p))
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = np.column_stack([np.ones(len(y)), batch.column(1).flatten().to_numpy().reshape(len(y), -1)])
        for k in (0, 1):
            total[k] += x[y == k].T @ x[y == k]
    at = np.arange(p * p)
    for k in (0, 1):
        yield pa.RecordBatch.from_pydict({"label": pa.array(np.full(p * p, k), pa.int32()), "place": pa.array(at, pa.int32()), "value": total[k].ravel()})


@dataclass
class Model:
    """Centre and scale of the statistics, and of each class its mean, inverse Cholesky factor and constant; prior of label 1."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [constant - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, constant in self.classes]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(products: np.ndarray, shrinkage: float = SHRINKAGE, pooling: float = POOLING) -> Model:
    """From the sums of (1, x)(1, x)' of classes 0 and 1."""
    n = products[:, 0, 0]
    p = products.shape[1] - 1
    if n.min() < 1:
        return Model(np.zeros(p), np.ones(p), [], float(n[1] / n.sum()) if n.sum() else 0.5)
    both = products.sum(axis=0) / n.sum()
    centre = both[0, 1:]
    spread = np.sqrt(np.maximum(np.diag(both)[1:] - centre**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means = [(products[k, 0, 1:] / n[k] - centre) / scale for k in (0, 1)]
    within = [(products[k, 1:, 1:] / n[k] - np.outer(products[k, 0, 1:], products[k, 0, 1:]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * within[0] + n[1] * within[1]) / n.sum()
    classes = []
    for k in (0, 1):
        s = (1 - pooling) * within[k] + pooling * pooled
        s = (1 - shrinkage) * s + shrinkage * max(np.trace(s) / p, 1e-6) * np.eye(p)
        lower = np.linalg.cholesky(s)
        classes.append((means[k], np.linalg.inv(lower), float(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())))
    return Model(centre, scale, classes, float(n[1] / n.sum()))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return run


def held_out() -> F.Column:
    """Whether a row's label is never learnt: crc32 of the doc_id's digits leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, pooling: float = POOLING) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted; learnt from labels.quality of rows not held out."""
    x = written(
        map_arrow(with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), _statistics, "doc_id bigint, g_x array<double>"),
        "statistics"
    )
    known = labels.filter("quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("g_label")
    ).filter(~held_out())
    train = x.join(known, "doc_id").select("g_label", "g_x")
    sums = map_arrow(
        train, _products, "label int, place int, value double"
    ).groupBy("label", "place").agg(F.sum("value").alias("value")).collect()  # 2 (p + 1)**2 rows
    p = len(STATISTICS) + 1
    products = np.zeros((2, p * p))
    for r in sums:
        products[r["label"], r["place"]] = r["value"]
    scored = map_arrow(x, _scored(fit(products.reshape(2, p, p), shrinkage, pooling)), "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
