"""The named analytic queries over the analyst view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import percent_of

LOST = ("CANCELLED", "RETURNED")


def kept() -> Column:
    return ~F.col("order_status").isin(*LOST)


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def monthly_revenue(view: DataFrame) -> DataFrame:
    return view.filter(kept()).groupBy("year_month").agg(_money(F.sum("net_amount")).alias("revenue"), F.countDistinct("order_id").alias("n_orders"))


def monthly_growth(view: DataFrame) -> DataFrame:
    """Revenue and orders by month, and growth over the month before; a row a month meets in the ordered window."""
    before = F.lag("revenue").over(Window.orderBy("year_month"))
    return monthly_revenue(view).withColumn("mom_growth_pct", percent_of(F.col("revenue") - before, before)).orderBy("year_month")


def top_products(view: DataFrame, n: int = 3) -> DataFrame:
    """The n products with most revenue in each region; ties share a rank."""
    sold = view.filter(kept()).groupBy("region", "product_name", "category").agg(_money(F.sum("net_amount")).alias("revenue"), F.sum("quantity").alias("units"))
    return sold.withColumn("rnk", F.rank().over(Window.partitionBy("region").orderBy(F.desc("revenue")))).filter(F.col("rnk") <= n).orderBy("region", "rnk")


def retention(view: DataFrame, customer_dimension: DataFrame) -> DataFrame:
    """Of the customers who first bought in a quarter, how many bought again so many quarters later."""
    ids = customer_dimension.select("customer_sk", "customer_id")
    active = view.filter(F.col("order_status") != "CANCELLED").join(ids, "customer_sk").select(
        "customer_id", F.date_trunc("quarter", "order_date").alias("q")
    ).distinct()
    first = active.groupBy("customer_id").agg(F.min("q").alias("cohort"))
    counts = active.join(first, "customer_id").groupBy(
        "cohort", (F.months_between("q", "cohort") / 3).cast("int").alias("quarters_since")
    ).agg(F.countDistinct("customer_id").alias("active_customers"))
    base = F.first("active_customers").over(Window.partitionBy("cohort").orderBy("quarters_since"))
    return counts.select(
        F.date_format("cohort", "yyyy-MM").alias("cohort_quarter_start"), "quarters_since", "active_customers",
        percent_of(F.col("active_customers"), base).alias("retention_pct")
    ).orderBy("cohort_quarter_start", "quarters_since")


def store_growth(view: DataFrame) -> DataFrame:
    """Revenue of stores by year, years with twelve months only, and growth over the full year before."""
    full = view.groupBy("year").agg(F.countDistinct("month").alias("m")).filter("m = 12").select("year")
    sold = view.filter(kept()).join(full, "year", "left_semi").groupBy("store_name", "region", "year").agg(_money(F.sum("net_amount")).alias("revenue"))
    before = F.lag("revenue").over(Window.partitionBy("store_name").orderBy("year"))
    return sold.withColumn("prev_year_revenue", before).withColumn(
        "yoy_growth_pct", percent_of(F.col("revenue") - F.col("prev_year_revenue"), F.col("prev_year_revenue"))
    ).orderBy(F.desc("year"), F.desc("yoy_growth_pct"))


def baskets(view: DataFrame) -> DataFrame:
    """Items and value of the average order, by region and year."""
    each = view.filter(kept()).groupBy("order_id", "region", "year").agg(F.sum("quantity").alias("items"), F.sum("net_amount").alias("value"))
    # rounded half up in whole hundredths, so that no floating-point tie decides
    mean = lambda c: F.expr(f"(2 * cast(sum({c}) * 100 as bigint) + count(*)) div (2 * count(*)) / 100.0D")
    return each.groupBy("region", "year").agg(
        F.count("*").alias("n_orders"), mean("items").alias("avg_items_per_order"), mean("value").alias("avg_order_value")
    ).orderBy("region", "year")


def yearly_revenue(fact: DataFrame, dates: DataFrame) -> DataFrame:
    return fact.filter(kept()).join(
        dates.select("date_key", "year"), "date_key"
    ).groupBy("year").agg(_money(F.sum("net_amount")).alias("revenue")).orderBy("year")


def region_revenue(fact: DataFrame, store_dimension: DataFrame) -> DataFrame:
    return fact.filter(kept()).join(
        store_dimension.select("store_key", "region"), "store_key"
    ).groupBy("region").agg(_money(F.sum("net_amount")).alias("revenue")).orderBy(F.desc("revenue"))


def region_revenue_by_pairs(fact: DataFrame, regions: dict[int, str]) -> DataFrame:
    """The same in the map and reduce form: pairs, combined before the shuffle, with a small lookup at every task."""
    from decimal import Decimal

    spark = fact.sparkSession
    lookup = spark.sparkContext.broadcast(regions)
    lost = LOST
    pairs = fact.select("store_key", "order_status", "net_amount").rdd.filter(lambda r: r[1] not in lost).map(lambda r: (lookup.value[r[0]], r[2]))
    return pairs.reduceByKey(lambda a, b: a + b).map(lambda kv: (kv[0], Decimal(kv[1]))).toDF("region string, revenue decimal(18,2)")


def kpis(fact: DataFrame, dates: DataFrame, customer_dimension: DataFrame, year: int) -> DataFrame:
    """One row: net revenue, orders, customers who ordered (of all facts), average order value, growth of `year` over the year before."""
    f = fact.join(dates.select("date_key", "year"), "date_key")
    in_year = lambda y: F.sum(F.when(kept() & (F.col("year") == y), F.col("net_amount")))
    a = f.join(customer_dimension.select("customer_sk", "customer_id"), "customer_sk", "left").agg(
        _money(F.sum(F.when(kept(), F.col("net_amount")))).alias("net_revenue"), F.countDistinct(F.when(kept(), F.col("order_id"))).alias("n_orders"), F.countDistinct("customer_id").alias("n_customers"), in_year(year).alias("now"), in_year(year - 1).alias("before"))
    return a.select(
        "net_revenue", "n_orders", "n_customers",
        F.round(F.try_divide(F.col("net_revenue").cast("double"), F.col("n_orders")), 2).alias("avg_order_value"),
        percent_of(F.col("now") - F.col("before"), F.col("before")).alias("yoy_growth_pct")
    )


def cohort_pivot(cohorts: DataFrame, last: int = 7) -> DataFrame:
    """Cohorts as rows, retention after 0 .. last quarters as columns."""
    wide = cohorts.filter(F.col("quarters_since") <= last).groupBy("cohort_quarter_start").pivot(
        "quarters_since", list(range(last + 1))
    ).agg(F.first("retention_pct"))
    return wide.select("cohort_quarter_start", *(F.col(str(k)).alias(f"q{k}") for k in range(last + 1)))


def same_period_last_year(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Revenue by year, with that of the calendar year before (null if there is none), not of the row before."""
    by = yearly_revenue(fact, dates)
    old = by.select((F.col("year") + 1).alias("_next"), F.col("revenue").alias("last_year"))
    return by.join(old, F.col("year") == F.col("_next"), "left").select(
        "year", "revenue", "last_year", percent_of(F.col("revenue") - F.col("last_year"), F.col("last_year")).alias("yoy_pct")
    )


#: What leaves the lake: columns by table; of customers nothing that tells who they are.
EXPORTS = {
    "fact_sales": [
        "order_item_id", "order_id", "date_key", "customer_sk", "product_key", "store_key", "order_status", "payment_method", "quantity",
        "unit_price", "discount_pct", "gross_amount", "discount_amount", "net_amount"
    ],
    "dim_customer": ["customer_sk", "customer_id", "city", "state", "signup_date", "effective_from", "effective_to", "is_current"],
    "dim_product": ["product_key", "product_name", "category", "brand", "current_unit_price", "price_band"],
    "dim_store": ["store_key", "store_name", "city", "region", "opened_date"],
    "dim_date": ["date_key", "full_date", "year", "quarter", "month", "month_name", "year_month", "day_of_week", "day_name", "is_weekend", "fiscal_year"],
}


def export_star(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of EXPORTS as CSV; validity of customer versions as dates."""
    from granary.sources.files import export

    for name, columns in EXPORTS.items():
        df = tables[name]
        if name == "dim_customer":
            df = df.withColumns({c: F.to_date(c) for c in ("effective_from", "effective_to")})
        export(df, f"{path}/{name}", columns)


def secured(view: DataFrame, regions: list[str]) -> DataFrame:
    """Row-level security: the rows of a role's regions."""
    return view.filter(F.col("region").isin(*regions))


def dashboard(view: DataFrame, customer_dimension: DataFrame, path: str) -> None:
    """A page with the charts of the view, from aggregates that are a row a month, region and year, store, or cohort."""
    from granary.operators import reports

    monthly = monthly_growth(view).orderBy("year_month").collect()
    stores = store_growth(view).filter("yoy_growth_pct is not null").orderBy(F.desc("year"), F.desc("yoy_growth_pct")).limit(40).collect()
    values = baskets(view).orderBy("region", "year").collect()
    kept_ = cohort_pivot(retention(view, customer_dimension)).orderBy("cohort_quarter_start").collect()
    quarters = [f"q{k}" for k in range(8)]
    charts = (
        reports.bars("Net revenue by month", [(r["year_month"], float(r["revenue"])) for r in monthly], 1200),
        reports.bars("Average order value by region and year", [(f"{r['region']} {r['year']}", float(r["avg_order_value"])) for r in values], 1200),
        reports.bars(
            "Growth of stores over the year before, in percent", [(f"{r['store_name']} {r['year']}", float(r["yoy_growth_pct"])) for r in stores],
            1200
        ),
        reports.grid(
            "Customers who came back, in percent, by quarter of their first order", quarters,
            [(r["cohort_quarter_start"], [r[q] for q in quarters]) for r in kept_]
        ),
    )
    with open(path, "w", encoding="utf-8") as f:
        f.write(reports.html("Sales", [r.asDict() for r in monthly], charts))
