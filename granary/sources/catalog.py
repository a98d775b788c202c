"""Databases, external tables and views in the session's catalogue (Hive's, if the session has one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def databases(spark: SparkSession, *names: str) -> None:
    for n in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {n}")


def external(spark: SparkSession, name: str, path: str, form: str = "parquet", schema: str | None = None, **options: str) -> None:
    """A table over files that stay where they are; it replaces a registration, never files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    given = "".join(f", '{k}' '{v}'" for k, v in options.items())
    spark.sql(f"CREATE TABLE {name} {f'({schema}) ' if schema else ''}USING {form} OPTIONS (path '{path}'{given})")


def unregister(spark: SparkSession, name: str) -> None:
    """Forgets a table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def tables(spark: SparkSession, *databases: str) -> DataFrame:
    """table_name, column_name, type, table_type and provider of all columns of all tables of some databases."""
    rows = []
    for d in databases:
        for t in spark.catalog.listTables(d):
            if t.isTemporary:
                continue
            name = f"{d}.{t.name}"
            described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
            rows += [
                (name, f.name, f.dataType.simpleString(), described.get("Type", ""), described.get("Provider", "")) for f in spark.table(name).schema.fields
            ]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, table_type string, provider string")
