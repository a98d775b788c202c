"""Reconciliation of a source and what was made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators import frames as O


def checksum(df: DataFrame) -> DataFrame:
    """One row: n_rows, and a checksum that no order of rows changes: the sum of the rows' digests as numbers."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(C.digest_number(C.row_digest(*df.columns))), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")
    )


def same_rows(source: DataFrame, made: DataFrame, table: str) -> DataFrame:
    """table_name, the counts and checksums of both sides, ok."""
    a, b = checksum(source), checksum(made.select(*source.columns))
    both = a.toDF("source_rows", "source_sum").unionByName(b.toDF("made_rows", "made_sum"), True).agg(
        *(F.max(c).alias(c) for c in ("source_rows", "source_sum", "made_rows", "made_sum"))
    )
    return both.select(
        F.lit(table).alias("table_name"), "*", ((F.col("source_rows") == F.col("made_rows")) & (F.col("source_sum") == F.col("made_sum"))).alias("ok")
    )


def total(df: DataFrame, quantity: str = "quantity", price: str = "unit_price") -> DataFrame:
    return df.agg(F.sum((F.col(quantity) * F.col(price)).cast("decimal(18,2)")).alias("amount"))


def by_month(df: DataFrame, at: str, amount) -> DataFrame:
    return df.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.sum(amount).alias("amount"))


def months(source: DataFrame, made: DataFrame) -> DataFrame:
    """month, left, right, same of two results of by_month()."""
    return O.compare(source, made, "month", "amount")


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of one row and column each, as one row (a, b)."""
    return a.toDF("a").unionByName(b.toDF("b"), True).agg(F.max("a").alias("a"), F.max("b").alias("b"))


def line(df: DataFrame, check: str, table: str, source, lake, ok=None) -> DataFrame:
    """A line of a report: check_name, table_name, source, lake (as text), ok."""
    said = [source.cast("string").alias("source"), lake.cast("string").alias("lake")]
    return df.select(F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), *said, (source.eqNullSafe(lake) if ok is None else ok).alias("ok"))


def migrated(source: DataFrame, lake: DataFrame, table: str) -> DataFrame:
    """Two lines: the row counts, and whether the checksums of the source's columns agree (not shown)."""
    both = same_rows(source, lake, table)
    rows, none = F.struct(
        F.lit("row count").alias("c"), F.col("source_rows").cast("string").alias("s"), F.col("made_rows").cast("string").alias("l"),
        (F.col("source_rows") == F.col("made_rows")).alias("ok")
    ), F.lit(None).cast("string")
    sums = F.struct(F.lit("checksum").alias("c"), none.alias("s"), none.alias("l"), (F.col("source_sum") == F.col("made_sum")).alias("ok"))
    return both.select(F.explode(F.array(rows, sums)).alias("x")).select(
        F.col("x.c").alias("check_name"), F.lit(table).alias("table_name"), F.col("x.s").alias("source"), F.col("x.l").alias("lake"),
        F.col("x.ok").alias("ok")
    )
