"""Compares a query with its oracle, as sets of rows with repeats."""

import numbers

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or (not isinstance(v, list) and pd.isna(v)):
        return "null"
    if isinstance(v, numbers.Real) and not isinstance(v, bool) and abs(v) < 2**53:
        return f"{v:.6f}"  # a column of integers with nulls may come as one of floats
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(_text, r)) for r in df[columns].itertuples(index=False, name=None))


def same(spark, con, sf_dir, query, sql):
    a, b = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1], (list(set(a[1]) - set(b[1]))[:3], list(set(b[1]) - set(a[1]))[:3], len(a[1]), len(b[1]))
