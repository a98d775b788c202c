"""The star schema: date spine, dimensions, a customer dimension that keeps history, the fact table, and a view without personal data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators import frames as O

BEGINNING, OPEN_END = datetime(1900, 1, 1), datetime(9999, 12, 31)
TRACKED = ("city", "state")
PRICE_BANDS = {"Budget": 500, "Mid": 5000}


def date_spine(orders: DataFrame, column: str = "order_date") -> DataFrame:
    """A row per day from the first day of the first order's year to the last day of the last order's month."""
    d = F.col("d")
    ends = orders.agg(F.trunc(F.min(column), "year").alias("a"), F.last_day(F.max(column)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("d")).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d.alias("full_date"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), C.fiscal_year(d).alias("fiscal_year"),
    )


def product_dimension(products: DataFrame, bands: dict[str, float] = PRICE_BANDS, above: str = "Premium") -> DataFrame:
    return products.select(
        F.col("product_id").alias("product_key"), "product_name", "category", "brand", F.col("unit_price").alias("current_unit_price"),
        C.band(F.col("unit_price"), bands, above).alias("price_band")
    )


def store_dimension(stores: DataFrame) -> DataFrame:
    return stores.select(F.col("store_id").alias("store_key"), "store_name", "city", "region", "opened_date")


CUSTOMER_COLUMNS = (
    "customer_sk", "customer_id", "first_name", "last_name", "email_hash", "phone_masked", "city", "state", "signup_date", "row_hash",
    "effective_from", "effective_to", "is_current"
)
CUSTOMER_SCHEMA = "customer_sk long, customer_id long, first_name string, last_name string, email_hash string, phone_masked string, city string, state string, signup_date date, row_hash string, effective_from timestamp, effective_to timestamp, is_current boolean"


def changed_customers(snapshot: DataFrame, dimension: DataFrame, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """Rows of the snapshot that are new or differ from their current version in a tracked attribute, with new_hash and is_existing."""
    current = dimension.filter("is_current").select(F.col("customer_id").alias("_id"), F.col("row_hash").alias("_hash"))
    joined = snapshot.withColumn("new_hash", C.row_digest(*tracked)).join(current, F.col("customer_id") == F.col("_id"), "left")
    return joined.withColumn("is_existing", F.col("_id").isNotNull()).filter(~F.col("is_existing") | (F.col("_hash") != F.col("new_hash"))).drop("_id", "_hash")


def merge_feed(changes: DataFrame) -> DataFrame:
    """Changes as a merge takes them: each once under its key, and those that exist once more under none, to be inserted."""
    return changes.withColumn("merge_key", F.col("customer_id")).unionAll(changes.filter("is_existing").withColumn("merge_key", F.lit(None).cast("long")))


def next_customer_dimension(dimension: DataFrame, snapshot: DataFrame, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """The dimension after a snapshot: changed versions are closed at updated_at, new ones open there (first ones in 1900).

    Surrogate keys go on from the largest, in the order of (customer_id, closing row first), so that as in a merge fed by merge_feed() a change
    takes two numbers.  Run again with the same snapshot it changes nothing.
    """
    changes = changed_customers(snapshot, dimension, tracked)
    top = dimension.agg(F.coalesce(F.max("customer_sk"), F.lit(0))).scalar()
    feed = merge_feed(changes).withColumn("_insert", F.col("merge_key").isNull().cast("int"))
    keyed = O.numbered(feed, "customer_id", "_insert", name="_n").withColumn("customer_sk", F.col("_n") + top)
    fresh = keyed.filter("not is_existing or merge_key is null").select(
        "customer_sk", "customer_id", "first_name", "last_name", "email_hash", "phone_masked", "city", "state", "signup_date", F.col("new_hash").alias("row_hash"),
        F.when(
            F.col("is_existing"), F.col("updated_at")
        ).otherwise(F.lit(BEGINNING)).cast("timestamp").alias("effective_from"), F.lit(OPEN_END).cast("timestamp").alias("effective_to"), F.lit(True).alias("is_current"),
    )
    closing = changes.filter("is_existing").select(F.col("customer_id").alias("_id"), F.col("updated_at").alias("_closed"))
    kept = dimension.join(closing, (F.col("customer_id") == F.col("_id")) & F.col("is_current"), "left")
    kept = kept.withColumn("effective_to", F.coalesce("_closed", "effective_to")).withColumn("is_current", F.col("is_current") & F.col("_id").isNull())
    return kept.select(*CUSTOMER_COLUMNS).unionByName(fresh)


def fact_sales(items: DataFrame, orders: DataFrame, customer_dimension: DataFrame) -> DataFrame:
    """A row per order line, with the customer's version at the time of the order."""
    o = orders.select(F.col("order_id").alias("_order"), "customer_id", "store_id", "order_ts", "order_status", "payment_method")
    lines = O.valid_at(items.join(o, F.col("order_id") == F.col("_order")), customer_dimension, "customer_id", "order_ts", {"customer_sk": "customer_sk"})
    money = C.amounts(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    return lines.select(
        "order_item_id", "order_id", F.date_format("order_ts", "yyyyMMdd").cast("int").alias("date_key"), "customer_sk", F.col("product_id").alias("product_key"), F.col("store_id").alias("store_key"),
        "order_status", "payment_method", "quantity", "unit_price", "discount_pct", *(c.alias(n) for n, c in money.items()), "order_ts",
    )


def analyst_view(fact: DataFrame, dates: DataFrame, customer_dimension: DataFrame, product_dim: DataFrame, store_dim: DataFrame) -> DataFrame:
    """The star joined up, without names, addresses or numbers of persons; facts without a customer drop out.

    Dimensions are pruned to the columns used; whether one is broadcast is left to its measured size.
    """
    d = dates.select("date_key", F.col("full_date").alias("order_date"), "year", "month", "year_month")
    c = customer_dimension.select("customer_sk", F.col("city").alias("customer_city"), F.col("state").alias("customer_state"))
    p = product_dim.select("product_key", "product_name", "category", "brand", "price_band")
    s = store_dim.select("store_key", "store_name", F.col("city").alias("store_city"), "region")
    return fact.join(d, "date_key").join(c, "customer_sk").join(p, "product_key").join(s, "store_key").select(
        "order_item_id", "order_id", "order_date", "year", "month", "year_month", "customer_sk", "customer_city", "customer_state", "product_name", "category", "brand", "price_band",
        "store_name", "store_city", "region", "order_status", "payment_method", "quantity", "gross_amount", "discount_amount", "net_amount",
    )
