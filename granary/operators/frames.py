"""Operators from frames to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import scratch

Rules = list[tuple[Column, str]]
REASON = "_reject_reason"


def latest(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key by the columns `newest` (default updated_at, _ingested_at); all other columns break ties, so the choice is fixed.

    Rows without a key are no versions of one another: all stay, spread over tasks, for a rule to reject.
    """
    newest = newest or ("updated_at", "_ingested_at")
    lone = F.when(F.col(key).isNull(), F.xxhash64(*df.columns))
    order = [F.col(c).desc() for c in newest] + [F.col(c).asc() for c in df.columns if c not in newest and c != key]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key, lone).orderBy(*order)))
    return ranked.filter((F.col("_rank") == 1) | F.col(key).isNull()).drop("_rank")


def current_versions(df: DataFrame, key: str, newest: str = "updated_at") -> DataFrame:
    """All rows that bear their key's newest timestamp: repeated rows stay; rows with a null timestamp go."""
    top = F.max(newest).over(Window.partitionBy(key))
    return df.withColumn("_top", top).filter(F.col(newest) == F.col("_top")).drop("_top")


def tagged(df: DataFrame, rules: Rules) -> DataFrame:
    """`df` with the reasons of all rules that a row breaks, joined by '; ' ('' if none).  A null condition breaks no rule."""
    return df.withColumn(REASON, F.concat_ws("; ", *(F.when(broken, F.lit(reason)) for broken, reason in rules)))


def split(df: DataFrame, rules: Rules, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason and time).  Nothing is lost: each row is in one of both."""
    marked = tagged(df, rules)
    at = F.current_timestamp() if at is None else at
    return marked.filter(F.col(REASON) == "").drop(REASON), marked.filter(F.col(REASON) != "").withColumn("_quarantined_at", at)


def with_parent(df: DataFrame, key: str, parent: DataFrame, parent_key: str, flag: str) -> DataFrame:
    """`df` with `flag`: whether the key stands in the parent.  Keys are made distinct first, so no row is doubled."""
    keys = parent.select(F.col(parent_key).alias(f"{flag}_key")).filter(F.col(f"{flag}_key").isNotNull()).distinct()
    return df.join(keys, F.col(key) == F.col(f"{flag}_key"), "left").withColumn(flag, F.col(f"{flag}_key").isNotNull()).drop(f"{flag}_key")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key stands nowhere in the parent; a null key is an orphan."""
    return df.join(parent.select(F.col(parent_key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")


def valid_at(
    df: DataFrame, versions: DataFrame, key: str, at: str, columns: dict[str, str], start: str = "effective_from", end: str = "effective_to"
) -> DataFrame:
    """Point-in-time join: the version of `key` that holds at `at`, start included and end not; without one, nulls.

    The equi-key carries the join, so it never becomes a nested loop; the range is a condition of it.
    """
    right = versions.select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), *(F.col(c).alias(n) for c, n in columns.items()))
    return df.join(right, (F.col(key) == F.col("_key")) & (F.col(at) >= F.col("_start")) & (F.col(at) < F.col("_end")), "left").drop("_key", "_start", "_end")


def numbered(df: DataFrame, *order: str, name: str, start: Column | int = 1) -> DataFrame:
    """Consecutive numbers in the order of columns, without a window over one partition: ranges are sorted, counted, and offset.

    The sorted rows are written to the shared folder, so that each row's task and place are fixed; the counts are one a task.
    """
    path = scratch(df.sparkSession, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    sorted_rows = df.sparkSession.read.parquet(path)
    place, task = F.col("_place").bitwiseAND((1 << 33) - 1), F.shiftright("_place", 33)
    counts = sorted_rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = counts.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    first = F.lit(start) if isinstance(start, int) else start
    return sorted_rows.join(before, task == F.col("_task")).withColumn(name, (place + F.col("_before") + first).cast("long")).drop("_place", "_task", "_before")


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of (key, value): key, left, right, same; nulls are equal to nulls."""
    a, b = left.select(F.col(key).alias("_a"), F.col(value).alias("left")), right.select(F.col(key).alias("_b"), F.col(value).alias("right"))
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer").select(
        F.coalesce("_a", "_b").alias(key), "left", "right", F.col("left").eqNullSafe(F.col("right")).alias("same")
    )
