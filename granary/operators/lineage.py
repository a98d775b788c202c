"""Lineage from SQL scripts and from plans, and a catalogue of columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from granary.sources.files import statements

Edge = tuple[str, str, str]
PERSONAL = {"first_name": "yes", "last_name": "yes", "email": "yes", "phone": "yes", "email_hash": "pseudonymised", "phone_masked": "masked"}
#: What the columns of the retail tables hold.
DESCRIBED = {
    "customer_id": "key of the customer at the source", "customer_sk": "number of a version of the customer", "first_name": "given name", "last_name": "family name",
    "email_hash": "digest of the address, for joins and counts", "phone_masked": "last four digits", "city": "town, as spelt by rule", "state": "region of the address", "signup_date": "day of registration",
    "row_hash": "digest of the attributes whose history is kept", "effective_from": "first moment of the version", "effective_to": "moment at which the version no longer holds", "is_current": "whether the version holds now",
    "product_id": "key of the product at the source", "product_key": "product", "store_id": "key of the store at the source", "store_key": "store", "order_id": "order", "order_item_id": "line of an order; one row a line",
    "order_ts": "moment of the order, from any of the source's formats", "order_date": "day of the order", "order_status": "state of the order", "payment_method": "way of payment", "quantity": "units", "unit_price": "price of a unit",
    "discount_pct": "discount in percent", "gross_amount": "units times price", "discount_amount": "discount in money", "net_amount": "gross less discount", "date_key": "day as a number", "updated_at": "last change at the source",
    "_ingested_at": "arrival in the lake", "_source": "where the row comes from", "_batch_id": "load that brought the row",
}
_NAME = r"((?:\w+\.)+\w+)"


def script_edges(name: str, script: str) -> list[Edge]:
    """(source, target, script) for each statement that makes or fills a table or view."""
    out: set[Edge] = set()
    for s in statements(script):
        bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", s)
        targets = re.findall(rf"\b(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}", bare, re.I) + re.findall(
            rf"\b(?:INSERT\s+(?:INTO|OVERWRITE)|MERGE\s+INTO)\s+(?:TABLE\s+)?{_NAME}", bare, re.I
        )
        sources = re.findall(rf"\b(?:FROM|JOIN|USING)\s+{_NAME}", bare, re.I)
        out |= {(a, b, name) for a in sources for b in targets if a != b}
    return sorted(out)


def plan_inputs(df: DataFrame) -> list[str]:
    """The files and tables that a frame reads, as its optimised plan names them."""
    return sorted(set(df.inputFiles()))


def catalogue(spark: SparkSession, tables: dict[str, DataFrame], owners: dict[str, str], described: dict[str, str] | None = None) -> DataFrame:
    """A row per column: table_name, position, column_name, type, description, personal, owner (by the table's layer)."""
    rows = [
        (
            t, k, f.name, f.dataType.simpleString(), (DESCRIBED if described is None else described).get(f.name, ""), PERSONAL.get(f.name, "no"),
            owners.get(t.split(".")[0], "")
        )
        for t, df in tables.items() for k, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, description string, personal string, owner string")


def mermaid(edges: list[Edge]) -> str:
    node = lambda n: re.sub(r"\W", "_", n)
    return "\n".join(["flowchart LR", *(f"    {node(a)}[{a}] --> {node(b)}[{b}]" for a, b, _ in edges)])


def nodes(spark: SparkSession, edges: list[Edge], tables: dict[str, tuple[DataFrame, int | None]]) -> DataFrame:
    """A row per node of the edges: name, layer, n_rows and version; null for what is no table of this lake."""
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    rows = [(n, n.split(".")[0], tables[n][0].count() if n in tables else None, tables[n][1] if n in tables else None) for n in names]
    return spark.createDataFrame(rows, "name string, layer string, n_rows long, version long")


def graph(edges: list[Edge], node_rows: list) -> str:
    """Nodes and edges as JSON."""
    import json

    return json.dumps({"nodes": [r.asDict() for r in node_rows], "edges": [{"from": a, "to": b, "via": v} for a, b, v in edges]}, indent=2)


def edges_frame(spark: SparkSession, edges: list[Edge]) -> DataFrame:
    return spark.createDataFrame(edges, "source string, target string, via string")
