"""Data-quality checks in four dimensions, each a row: dimension, table, check, measured, expected, ok.

All checks of a table are measured in one aggregation: shares, counts of broken rules, distinct keys, and children without a parent,
which are told by one outer join a parent.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Check(NamedTuple):
    """`what` is a column, or for validity a condition of valid rows; `duckdb` is that condition for another SQL dialect, where it differs."""

    dimension: str
    table: str
    what: str
    name: str
    expected: str = "0"
    least: float = 0.0
    where: str = "true"
    parent: str = ""
    key: str = ""
    duckdb: str = ""


def complete(table: str, column: str, least: float = 0.98) -> Check:
    """The share of rows with a value; an empty table has none and fails."""
    return Check("completeness", table, column, f"{column} not null", f">= {least}", least=least)


def unique(table: str, column: str, where: str = "true") -> Check:
    """Rows less distinct keys; rows without a key count as duplicates."""
    return Check("uniqueness", table, column, f"{column} unique" + ("" if where == "true" else f" ({where})"), where=where)


def valid(table: str, condition: str, name: str = "", duckdb: str = "") -> Check:
    """Rows for which the condition is false; where it is null the row is valid."""
    return Check("validity", table, condition, name or condition, duckdb=duckdb)


def refers(table: str, column: str, parent: str, key: str) -> Check:
    """Rows whose column is no key of the parent; null is none."""
    return Check("integrity", table, column, f"{column} -> {parent}.{key}", parent=parent, key=key)


def _measure(c: Check, k: int) -> Column:
    if c.dimension == "completeness":
        return F.coalesce(F.try_divide(F.count(c.what).cast("double"), F.count("*")), F.lit(0.0))
    if c.dimension == "uniqueness":
        where = F.expr(c.where)
        return (F.count_if(where) - F.countDistinct(F.when(where, F.col(c.what)))).cast("double")
    if c.dimension == "validity":
        return F.count_if(~F.expr(c.what)).cast("double")
    return F.count_if(F.col(f"_parent{k}").isNull()).cast("double")


def _of_table(df: DataFrame, tables: dict[str, DataFrame], checks: list[tuple[int, Check]]) -> DataFrame:
    for k, c in checks:
        if c.dimension == "integrity":
            keys = tables[c.parent].select(F.col(c.key).alias(f"_parent{k}")).filter(F.col(f"_parent{k}").isNotNull()).distinct()
            df = df.join(keys, F.col(c.what) == F.col(f"_parent{k}"), "left")
    one = df.agg(*(_measure(c, k).alias(f"m{k}") for k, c in checks))

    def row(k: int, c: Check) -> Column:
        m = F.col(f"m{k}")
        share = c.dimension == "completeness"
        return F.struct(
            F.lit(k).alias("place"), F.lit(c.dimension).alias("dimension"), F.lit(c.table).alias("table_name"), F.lit(c.name).alias("check_name"),
            (
                F.round(m, 4) if share else m.cast("long")
            ).cast("string").alias("measured"), F.lit(c.expected).alias("expected"), (m >= c.least if share else m == 0).alias("ok"),
        )

    return one.select(F.explode(F.array(*(row(k, c) for k, c in checks))).alias("r")).select("r.*")


def run(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """One row a check, in no order: dimension, table_name, check_name, measured, expected, ok."""
    by_table: dict[str, list[tuple[int, Check]]] = {}
    for k, c in enumerate(checks):
        by_table.setdefault(c.table, []).append((k, c))
    return reduce(DataFrame.unionAll, (_of_table(tables[t], tables, own) for t, own in by_table.items())).drop("place")
