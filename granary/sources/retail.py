"""The retail model over the driver's tables: raw source tables with deterministic defects, as one text for two SQL dialects.

Every raw table has several versions of some rows, repeated rows, missing keys and malformed values, each at fixed places,
so that cleansing has something to do and an oracle can be computed from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"iso": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "dmy": "date_format({0}, 'dd/MM/yyyy HH:mm')", "ts": "CAST({0} AS TIMESTAMP)"}
DUCKDB = {"iso": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "dmy": "strftime({0}, '%d/%m/%Y %H:%M')", "ts": "CAST({0} AS TIMESTAMP)"}

AUDIT = "TIMESTAMP '2002-01-01 00:00:00' AS _ingested_at, 'source' AS _source, 'b1' AS _batch_id"
CITY = "CASE WHEN k % 25 = 0 THEN lower({0}) WHEN k % 25 = 1 THEN upper({0}) || ' ' WHEN k % 25 = 2 THEN ' ' || {0} ELSE {0} END"

TABLES = {
    "customers": f"""
        SELECT id AS customer_id, CASE WHEN k % 3 = 0 THEN ' ' || lower(c_mktsegment) ELSE c_mktsegment END AS first_name, lower(c_name) AS last_name,
          CASE WHEN k % 97 = 0 THEN NULL WHEN k % 2 = 0 THEN ' User' || CAST(k AS STRING) || '@Example.COM' ELSE 'user' || CAST(k AS STRING) || '@example.com' END AS email,
          CASE WHEN k % 50 = 9 THEN '123' WHEN k % 4 = 0 THEN '+91-' || n WHEN k % 4 = 1 THEN '0' || n WHEN k % 4 = 2 THEN n ELSE '+91 ' || substring(n, 1, 5) || ' ' || substring(n, 6, 5) END AS phone,
          {CITY.format("(CASE WHEN ver = 1 THEN 'new ' || n_name ELSE n_name END)")} AS city, CASE WHEN k % 40 = 3 THEN NULL ELSE r_name END AS state,
          DATE '1990-01-01' + CAST(k % 1800 AS INT) AS signup_date,
          CASE WHEN ver = 1 THEN {{ts:DATE '1998-06-01' + CAST(k % 300 AS INT)}} ELSE {{ts:DATE '1990-01-01' + CAST(k % 1800 AS INT)}} + INTERVAL 10 HOURS END AS updated_at, {AUDIT}
        FROM (SELECT c_custkey AS k, c_name, c_mktsegment, n_name, r_name, CAST(6000000000 + (c_custkey * 7919) % 3999999999 AS STRING) AS n
              FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey) b
        JOIN (SELECT c_custkey AS j, 0 AS ver, c_custkey AS id FROM {{customer}}
              UNION ALL SELECT c_custkey, 0, c_custkey FROM {{customer}} WHERE c_custkey % 100 = 0
              UNION ALL SELECT c_custkey, 1, c_custkey FROM {{customer}} WHERE c_custkey % 80 = 1
              UNION ALL SELECT c_custkey, 0, CAST(NULL AS BIGINT) FROM {{customer}} WHERE c_custkey % 500 = 3) v ON k = j""",
    "products": f"""
        SELECT p_partkey AS product_id, ' ' || p_name || ' ' AS product_name, CASE WHEN p_partkey % 100 = 10 THEN NULL ELSE p_type END AS category, p_brand AS brand,
          CAST(CASE WHEN p_partkey % 150 = 99 THEN -49 ELSE p_retailprice END AS DECIMAL(10,2)) AS unit_price, TIMESTAMP '1994-12-01 09:00:00' AS updated_at, {AUDIT} FROM {{part}}""",
    "stores": f"""
        SELECT k AS store_id, s_name AS store_name, {CITY.format("n_name")} AS city, lower(r_name) || ' ' AS region, DATE '1990-01-01' + CAST(k % 900 AS INT) AS opened_date,
          TIMESTAMP '1994-12-01 09:00:00' AS updated_at, {AUDIT}
        FROM (SELECT s_suppkey AS k, s_name, n_name, r_name FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey) b""",
    "orders": f"""
        SELECT k AS order_id, CASE WHEN k % 200 = 7 THEN NULL WHEN k % 333 = 5 THEN o_custkey + 1000000000 ELSE o_custkey END AS customer_id,
          CASE WHEN k % 400 = 9 THEN 999999999 ELSE k % 10 END AS store_id,
          CASE WHEN k % 100 = 0 THEN {{dmy:o_orderdate}} WHEN k % 300 = 1 THEN 'N/A' WHEN k % 300 = 2 THEN '2025-02-30 10:00:00' WHEN k % 500 = 17 THEN '2031-01-01 00:00:00' WHEN k % 700 = 3 THEN '1990-05-05 00:00:00' WHEN k % 900 = 4 THEN '' ELSE {{iso:o_orderdate}} END AS order_date,
          CASE WHEN k % 25 = 3 THEN 'returned' WHEN o_orderstatus = 'P' THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'delivered' END AS status,
          CASE k % 4 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD' WHEN 2 THEN 'CASH' ELSE 'WALLET' END AS payment_method, {{ts:o_orderdate}} + INTERVAL 5 MINUTES AS updated_at, {AUDIT}
        FROM (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderdate FROM {{orders}} UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM {{orders}} WHERE o_orderkey % 120 = 0) b""",
    "order_items": f"""
        SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, CASE WHEN k % 500 = 11 THEN 999999999 ELSE l_partkey END AS product_id,
          CAST(CASE WHEN k % 125 = 4 THEN -l_quantity ELSE l_quantity END AS INT) AS quantity, CAST(CAST(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS unit_price,
          CAST(l_discount * 100 AS DECIMAL(5,2)) AS discount_pct, {{ts:l_shipdate}} AS updated_at, {AUDIT}
        FROM (SELECT l_orderkey + l_partkey + l_suppkey AS k, * FROM {{lineitem}}) b""",
}


def text(name: str, dialect: dict[str, str]) -> str:
    """A raw table as SQL of a dialect; {table} stays where a driver's table goes."""
    import re

    return re.sub(r"\{(iso|dmy|ts):([^{}]+)\}", lambda m: dialect[m[1]].format(m[2]), TABLES[name])


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    q = text(name, SPARK)
    used = set(re.findall(r"\{(\w+)\}", q))
    return spark.sql(q, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duckdb(name: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text(name, DUCKDB))


def change_batch(spark: SparkSession, sf_dir: str, name: str, at: str) -> DataFrame:
    """What changed in a source table after its first load, all with updated_at = `at`: customers 0 to 24 move and ten new ones come, ten
    prices rise by a twentieth, two hundred orders of two lines each come in, and fifty orders are returned."""
    from pyspark.sql import functions as F

    now = F.lit(at).cast("timestamp")
    rows = raw(spark, sf_dir, name).dropDuplicates([raw_key(name)])
    key, new = F.col(raw_key(name)), lambda n, by: rows.filter(F.col(raw_key(name)) < n).withColumn(raw_key(name), F.col(raw_key(name)) + by)
    if name == "customers":
        out = rows.filter(key < 25).withColumn("city", F.lit("Moved City")).unionByName(new(10, 10_000_000))
    elif name == "products":
        out = rows.filter((key < 10) & (F.col("unit_price") > 0)).withColumn(
            "unit_price", (F.col("unit_price") * F.lit("1.05").cast("decimal(3,2)")).cast("decimal(10,2)")
        )
    elif name == "orders":
        out = rows.filter((key >= 200) & (key < 250)).withColumn("status", F.lit("returned")).unionByName(new(200, 100_000_000))
    elif name == "order_items":
        two = raw(spark, sf_dir, "orders").filter("order_id < 200").select("order_id").distinct().select(
            (F.col("order_id") + 100_000_000).alias("o"), F.explode(F.array(F.lit(1), F.lit(2))).alias("l")
        )
        out = two.select(
            (F.col("o") * 10 + F.col("l")).alias("order_item_id"), F.col("o").alias("order_id"), (F.col("o") % 97).alias("product_id"),
            F.col("l").alias("quantity"), F.lit("100.00").cast("decimal(10,2)").alias("unit_price"),
            F.lit("5.00").cast("decimal(5,2)").alias("discount_pct"), now.alias("updated_at"),
            *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_ingested_at", "_source", "_batch_id"))
        )
    else:
        out = rows.limit(0)
    return out.withColumn("updated_at", now)


def raw_key(name: str) -> str:
    return {"customers": "customer_id", "products": "product_id", "stores": "store_id", "orders": "order_id", "order_items": "order_item_id"}[name]
