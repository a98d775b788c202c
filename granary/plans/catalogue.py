"""All queries of the engine, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators import cleaning, frames, lineage, modelling, quality, reconcile
from granary.plans import analytics as A
from granary.plans.oracles import LOST, PCT, PHONE, TITLE, TS, sql
from granary.plans.star import AS_OF, EARLIEST, Star
from granary.sources import catalog, files, jdbc, retail
from granary.sources.scratch import scratch
from granary.sources.versioned import SchemaMismatch, VersionedTable
from granary.streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *money: str):
    """Registers a function of a Star under its name; `money` are exact decimals, shown as doubles in both results."""

    def of(f: Callable[[Star], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Star(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in money})

        QUERIES[f.__name__] = run
        if oracle is not None:
            quoted = [f'"{c}"' for c in money]
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in quoted)}) FROM ({oracle})" if money else oracle
        return f

    return of


# ---- analytic queries ----------------------------------------------------------------------------------------------

_SOLD = f"""
    SELECT year_month, CAST(sum(net_amount) AS DECIMAL(18,2)) AS revenue, count(DISTINCT order_id) AS n_orders FROM view_
    WHERE {LOST} GROUP BY year_month
"""


@query(sql(f"""
    SELECT year_month, revenue, n_orders, {PCT.format('(revenue - lag(revenue) OVER (ORDER BY year_month))', 'lag(revenue) OVER (ORDER BY year_month)')}
    AS mom_growth_pct FROM ({_SOLD})
"""), "revenue")
def monthly_revenue_mom(s: Star) -> DataFrame:
    return A.monthly_growth(s.view)


@query(sql(_SOLD), "revenue")
def monthly_revenue(s: Star) -> DataFrame:
    return A.monthly_revenue(s.view)


@query(sql(f"""
    SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY region ORDER BY revenue DESC) AS INT) AS rnk FROM (SELECT region, product_name, category,
    CAST(sum(net_amount) AS DECIMAL(18,2)) AS revenue, CAST(sum(quantity) AS BIGINT) AS units FROM view_ WHERE {LOST}
    GROUP BY ALL)) WHERE rnk <= 3
"""), "revenue")
def top_products_per_region(s: Star) -> DataFrame:
    return A.top_products(s.view)


@query(sql("SELECT * FROM cohorts"))
def retention_cohorts(s: Star) -> DataFrame:
    return A.retention(s.view, s.customer_dimension)


@query(sql(f"""
    SELECT *, {PCT.format('(revenue - prev_year_revenue)', 'prev_year_revenue')} AS yoy_growth_pct FROM (SELECT *, lag(revenue) OVER (PARTITION
    BY store_name ORDER BY year) AS prev_year_revenue FROM (SELECT store_name, region, year, CAST(sum(net_amount) AS DECIMAL(18,2)) AS revenue
    FROM view_ WHERE {LOST} AND year IN (SELECT year FROM view_ GROUP BY year HAVING count(DISTINCT month) = 12) GROUP BY ALL))
"""), "revenue", "prev_year_revenue")
def store_yoy_growth(s: Star) -> DataFrame:
    return A.store_growth(s.view)


@query(sql(f"""
    SELECT region, year, count(*) AS n_orders, (2 * CAST(sum(items) * 100 AS BIGINT) + count(*)) // (2 * count(*)) / CAST(100 AS DOUBLE) AS avg_items_per_order,
    (2 * CAST(sum(value) * 100 AS BIGINT) + count(*)) // (2 * count(*)) / CAST(100 AS DOUBLE) AS avg_order_value FROM (SELECT order_id, region,
    year, sum(quantity) AS items, sum(net_amount) AS value FROM view_ WHERE {LOST} GROUP BY ALL) GROUP BY ALL
"""))
def basket_size(s: Star) -> DataFrame:
    return A.baskets(s.view)


_YEAR = f"SELECT year, CAST(sum(net_amount) AS DECIMAL(18,2)) AS revenue FROM fact f JOIN dim_date d ON f.date_key = d.date_key WHERE {LOST} GROUP BY year"
_REGION = f"""
    SELECT region, CAST(sum(net_amount) AS DECIMAL(18,2)) AS revenue FROM fact f JOIN dim_store s ON f.store_key = s.store_key
    WHERE {LOST} GROUP BY region
"""


@query(sql(_YEAR), "revenue")
def yearly_revenue(s: Star) -> DataFrame:
    return A.yearly_revenue(s.fact, s.dates)


@query(sql(f"""
    SELECT a.year, a.revenue, b.revenue AS last_year, {PCT.format('(a.revenue - b.revenue)', 'b.revenue')} AS yoy_pct
    FROM ({_YEAR}) a LEFT JOIN ({_YEAR}) b ON a.year = b.year + 1
"""), "revenue", "last_year")
def revenue_same_period_last_year(s: Star) -> DataFrame:
    return A.same_period_last_year(s.fact, s.dates)


@query(sql(_REGION), "revenue")
def sales_by_region(s: Star) -> DataFrame:
    return A.region_revenue(s.fact, s.store_dimension)


@query(sql(_REGION), "revenue")
def sales_by_region_rdd(s: Star) -> DataFrame:
    regions = {r["store_key"]: r["region"] for r in s.store_dimension.select("store_key", "region").collect()}  # a dimension, not facts
    return A.region_revenue_by_pairs(s.fact, regions)


_KPI = f"CAST(sum(net_amount) FILTER (WHERE {LOST} AND year = {{0}}) AS DOUBLE)"


@query(sql(f"""
    SELECT CAST(sum(net_amount) FILTER (WHERE {LOST}) AS DECIMAL(18,2)) AS net_revenue, count(DISTINCT order_id) FILTER (WHERE {LOST}) AS n_orders,
    count(DISTINCT customer_id) AS n_customers, round(CAST(sum(net_amount) FILTER (WHERE {LOST}) AS DOUBLE) / count(DISTINCT order_id) FILTER (WHERE
    {LOST}), 2) AS avg_order_value, round(100 * ({_KPI.format(2000)} - {_KPI.format(1999)}) / {_KPI.format(1999)}, 1) AS yoy_growth_pct
    FROM fact f JOIN dim_date d ON f.date_key = d.date_key LEFT JOIN dim_customer c ON f.customer_sk = c.customer_sk
"""), "net_revenue")
def kpis(s: Star) -> DataFrame:
    return A.kpis(s.fact, s.dates, s.customer_dimension, 2000)


@query(
    sql(
        "SELECT cohort_quarter_start, " + ", ".join(
            f"max(retention_pct) FILTER (WHERE quarters_since = {k}) AS q{k}" for k in range(8)
        ) + " FROM cohorts GROUP BY 1 HAVING min(quarters_since) <= 7"
    )
)
def cohort_pivot(s: Star) -> DataFrame:
    return A.cohort_pivot(A.retention(s.view, s.customer_dimension))


@query(sql("""
    SELECT region, count(*) AS n_lines, CAST(sum(net_amount) AS DECIMAL(18,2)) AS amount FROM view_ WHERE region IN ('ASIA', 'EUROPE')
    GROUP BY region
"""), "amount")
def row_level_security(s: Star) -> DataFrame:
    return A.secured(s.view, ["ASIA", "EUROPE"]).groupBy("region").agg(F.count("*").alias("n_lines"), F.sum("net_amount").cast("decimal(18,2)").alias("amount"))


# ---- column functions ----------------------------------------------------------------------------------------------


@query(sql("SELECT DISTINCT customer_id, sha256(lower(trim(email))) AS email_hash FROM r_customers WHERE customer_id IS NOT NULL"))
def mask_email(s: Star) -> DataFrame:
    return s.raw("customers").filter("customer_id is not null").select("customer_id", C.email_token(F.col("email")).alias("email_hash")).distinct()


@query(sql(f"""
    SELECT DISTINCT customer_id, {PHONE.format('phone')} AS phone_digits, 'XXXXXX' || right({PHONE.format('phone')}, 4) AS phone_masked
    FROM r_customers WHERE customer_id IS NOT NULL
"""))
def mask_phone(s: Star) -> DataFrame:
    p = F.col("phone")
    return s.raw("customers").filter("customer_id is not null").select(
        "customer_id", C.phone_digits(p).alias("phone_digits"), C.phone_hint(p).alias("phone_masked")
    ).distinct()


@query(sql(f"SELECT city, {TITLE.format('city')} AS city_name, count(*) AS n FROM r_customers GROUP BY ALL"))
def standardise_city(s: Star) -> DataFrame:
    return s.raw("customers").groupBy("city", C.city_name(F.col("city")).alias("city_name")).agg(F.count("*").alias("n"))


@query(sql(f"SELECT order_id, order_date, {TS.format('order_date')} AS order_ts FROM r_orders"))
def parse_legacy_dates(s: Star) -> DataFrame:
    return s.raw("orders").select("order_id", "order_date", C.legacy_timestamp(F.col("order_date")).alias("order_ts"))


@query("""
    SELECT p_partkey, CASE WHEN p_retailprice < 920 THEN 'Budget' WHEN p_retailprice < 970 THEN 'Mid' ELSE 'Premium' END AS price_band, sha256(coalesce(length(p_name)
    || ':' || p_name, '-') || coalesce(length(p_brand) || ':' || p_brand, '-')) AS row_hash FROM part
""")
def bands_and_digests(s: Star) -> DataFrame:
    return s.table("part").select(
        "p_partkey", C.band(F.col("p_retailprice"), {"Budget": 920, "Mid": 970}, "Premium").alias("price_band"),
        C.row_digest("p_name", "p_brand").alias("row_hash")
    )


@query("""
    SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(dayofweek(o_orderdate)
    + 1 AS INT) AS dow, strftime(o_orderdate, '%Y%m%d') AS ymd, strftime(o_orderdate, '%B') AS month_name, CAST(date_trunc('quarter', o_orderdate)
    AS TIMESTAMP) AS quarter_start, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start,
    'FY' || CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS VARCHAR) AS fiscal_year
    FROM orders
""")
def date_functions(s: Star) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    return s.table("orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.dayofweek(d).alias("dow"),
        F.date_format(d, "yyyyMMdd").alias("ymd"), F.date_format(d, "MMMM").alias("month_name"), F.date_trunc("quarter", d).alias("quarter_start"),
        F.last_day(d).alias("month_end"), F.trunc(d, "year").alias("year_start"), C.fiscal_year(d).alias("fiscal_year")
    )


@query("""
    SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS len, substr(c_name, 1, 8) AS head, right(c_name, 4) AS
    tail, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS well_formed, concat_ws('|', c_name,
    c_mktsegment) AS joined, round(CAST(c_acctbal AS DECIMAL(12,2)) * CAST(0.5 AS DECIMAL(2,1)), 1) AS half FROM customer
""", "half")
def string_functions(s: Star) -> DataFrame:
    n = F.col("c_name")
    return s.table("customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.lower(n).alias("low"), F.length(n).cast("long").alias("len"),
        F.substring(n, 1, 8).alias("head"), F.substring(n, -4, 4).alias("tail"), F.regexp_replace(n, "[^0-9]", "").alias("digits"),
        n.rlike("^Customer#[0-9]{9}$").alias("well_formed"), F.concat_ws("|", n, "c_mktsegment").alias("joined"),
        F.round(F.col("c_acctbal").cast("decimal(12,2)") * F.lit("0.5").cast("decimal(2,1)"), 1).alias("half")
    )


# ---- frame functions and cleansing ---------------------------------------------------------------------------------


@query(sql("SELECT customer_id, email, city, updated_at FROM l_customers WHERE customer_id IS NOT NULL"))
def dedupe_latest(s: Star) -> DataFrame:
    return frames.latest(s.raw("customers"), "customer_id").filter("customer_id is not null").select("customer_id", "email", "city", "updated_at")


@query(sql("""
    SELECT customer_id, city, updated_at FROM (SELECT *, max(updated_at) OVER (PARTITION BY customer_id) AS top FROM r_customers)
    WHERE updated_at = top
"""))
def current_versions_max_over(s: Star) -> DataFrame:
    return frames.current_versions(s.raw("customers"), "customer_id").select("customer_id", "city", "updated_at")


@query(sql("SELECT order_item_id, order_id, quantity, reason AS _reject_reason FROM j_items WHERE reason <> ''"))
def quarantine_split(s: Star) -> DataFrame:
    return s.rejected("order_items").select("order_item_id", "order_id", "quantity", frames.REASON)


@query(sql("""
    SELECT t AS table_name, reason AS _reject_reason, count(*) AS n_rows FROM (SELECT 'orders' AS t, reason FROM j_orders
    WHERE reason <> '' UNION ALL SELECT 'order_items', reason FROM j_items WHERE reason <> '') GROUP BY ALL
"""))
def quarantine_histogram(s: Star) -> DataFrame:
    named = [
        cleaning.reasons(bad).select(F.lit(t).alias("table_name"), frames.REASON, "n_rows") for t,
        bad in (("orders", s.rejected("orders")), ("order_items", s.rejected("order_items")))
    ]
    return named[0].unionAll(named[1])


@query(sql("SELECT customer_id, first_name, last_name, email_hash, phone_masked, city, state, signup_date, updated_at FROM customers"))
def clean_customers(s: Star) -> DataFrame:
    return s.good("customers").drop(*cleaning.AUDIT)


@query(sql("SELECT * FROM products"), "unit_price")
def clean_products(s: Star) -> DataFrame:
    return s.good("products").drop(*cleaning.AUDIT)


@query(sql("SELECT * FROM stores"))
def clean_stores(s: Star) -> DataFrame:
    return s.good("stores").drop(*cleaning.AUDIT)


@query(sql("SELECT * FROM orders_"))
def clean_orders(s: Star) -> DataFrame:
    return s.good("orders").drop(*cleaning.AUDIT)


@query(sql("SELECT * FROM items"), "unit_price", "discount_pct")
def clean_order_items(s: Star) -> DataFrame:
    return s.good("order_items").drop(*cleaning.AUDIT)


def _account(raw: str, key: str, good: str, bad: str) -> str:
    return f"SELECT (SELECT count(*) FROM {raw}) AS raw_rows, (SELECT count(DISTINCT {key}) + count(*) FILTER (WHERE {key} IS NULL) FROM {raw}) AS distinct_keys, (SELECT count(*) FROM {good}) AS valid_rows, (SELECT count(*) FROM {bad}) AS quarantined_rows"


_ACCOUNTS = {
    "stores": _account("r_stores", "store_id", "stores", "l_stores WHERE store_id IS NULL"),
    "products": _account("r_products", "product_id", "products", "l_products WHERE unit_price < 0 OR product_id IS NULL"),
    "customers": _account("r_customers", "customer_id", "customers", "l_customers WHERE customer_id IS NULL"),
    "orders": _account("r_orders", "order_id", "orders_", "j_orders WHERE reason <> ''"),
    "order_items": _account("r_items", "order_item_id", "items", "j_items WHERE reason <> ''"),
}
_ACCOUNTED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({q})" for t, q in _ACCOUNTS.items())


@query(sql(f"SELECT *, raw_rows - distinct_keys AS versions_removed FROM ({_ACCOUNTED})"))
def row_accounting(s: Star) -> DataFrame:
    each = [cleaning.accounting(s.raw(t), d.key, s.good(t), s.rejected(t)).select(F.lit(t).alias("table_name"), "*") for t, d in cleaning.TABLES.items()]
    return reduce(DataFrame.unionAll, each)


# ---- the model -----------------------------------------------------------------------------------------------------


@query(sql("SELECT * FROM dim_date"))
def dim_date(s: Star) -> DataFrame:
    return s.dates


@query(sql("SELECT * FROM dim_product"), "current_unit_price")
def dim_product(s: Star) -> DataFrame:
    return s.product_dimension


@query(sql("SELECT * FROM dim_store"))
def dim_store(s: Star) -> DataFrame:
    return s.store_dimension


def _dated(dimension: DataFrame) -> DataFrame:
    """The open end of versions lies beyond what some readers' timestamps hold, so it is shown as text."""
    return dimension.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("effective_from", "effective_to")})


_DATED = "SELECT * REPLACE (strftime(effective_from, '%Y-%m-%d %H:%M:%S') AS effective_from, strftime(effective_to, '%Y-%m-%d %H:%M:%S') AS effective_to) FROM "


@query(sql(_DATED + "dim_first"))
def scd2_first_load(s: Star) -> DataFrame:
    return _dated(s.first_dimension)


@query(sql(_DATED + "dim_customer"))
def scd2_after_change(s: Star) -> DataFrame:
    return _dated(s.customer_dimension)


@query(sql("SELECT is_current, count(*) AS versions, count(DISTINCT customer_id) AS n_customers FROM dim_customer GROUP BY is_current"))
def scd2_summary(s: Star) -> DataFrame:
    return s.customer_dimension.groupBy("is_current").agg(
        F.count("*").alias("versions"), F.countDistinct("customer_id").alias("n_customers")
    ).orderBy(F.desc("is_current"))


@query(sql("SELECT CASE WHEN ins = 0 THEN customer_id END AS merge_key, customer_id, city, known AS is_existing FROM fed"))
def union_all_double_feed(s: Star) -> DataFrame:
    return modelling.merge_feed(modelling.changed_customers(s.good("customers"), s.first_dimension)).select("merge_key", "customer_id", "city", "is_existing")


@query(sql("""
    SELECT order_id, o.customer_id, order_ts, customer_sk FROM orders_ o LEFT JOIN dim_customer d ON o.customer_id = d.customer_id AND order_ts
    >= effective_from AND order_ts < effective_to
"""))
def pit_join(s: Star) -> DataFrame:
    return frames.valid_at(
        s.good("orders").select("order_id", "customer_id", "order_ts"), s.customer_dimension, "customer_id", "order_ts",
        {"customer_sk": "customer_sk"}
    )


@query(sql("SELECT * FROM fact"), "unit_price", "discount_pct", "gross_amount", "discount_amount", "net_amount")
def fact_sales(s: Star) -> DataFrame:
    return s.fact


@query(sql("SELECT * FROM view_"), "gross_amount", "discount_amount", "net_amount")
def analyst_view(s: Star) -> DataFrame:
    return s.view


# ---- joins, set operations, aggregates on plain tables -------------------------------------------------------------


@query("""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus
    NOT IN ('P') AND o_totalprice BETWEEN 1000 AND 200000
""")
def semi_join_in(s: Star) -> DataFrame:
    building = s.table("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return s.table("orders").filter(
        ~F.col("o_orderstatus").isin("P") & F.col("o_totalprice").between(1000, 200000)
    ).join(building, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""
    SELECT count(*) AS n_orphans FROM (SELECT CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey + 100000000 WHEN l_orderkey % 77 = 0 THEN NULL ELSE
    l_orderkey END AS k FROM lineitem) LEFT JOIN orders ON k = o_orderkey WHERE o_orderkey IS NULL
""")
def ref_integrity_orphans(s: Star) -> DataFrame:
    k = F.col("l_orderkey")
    lines = s.table("lineitem").select(F.when(k % 50 == 0, k + 100000000).when(k % 77 != 0, k).alias("k"))
    return frames.orphans(lines, "k", s.table("orders"), "o_orderkey").agg(F.count("*").alias("n_orphans"))


@query("""
    SELECT coalesce(a.k, b.k) AS k, a.v AS \"left\", b.v AS \"right\", a.v IS NOT DISTINCT FROM b.v AS same FROM (SELECT c_nationkey AS k, count(*)
    AS v FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS v FROM supplier
    WHERE s_nationkey > 4 GROUP BY 1) b ON a.k = b.k
""")
def full_outer_compare(s: Star) -> DataFrame:
    a = s.table("customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    b = s.table("supplier").filter("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return frames.compare(a, b, "k", "v")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3")
def topk_limit(s: Star) -> DataFrame:
    return s.table("supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(s: Star) -> DataFrame:
    return s.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("""
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, min(o_orderdate) AS first_day, max(o_orderdate)
    AS last_day, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS total FROM orders GROUP BY 1
""", "total")
def grouped_aggregates(s: Star) -> DataFrame:
    return s.table("orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.min("o_orderdate").alias("first_day"),
        F.max("o_orderdate").alias("last_day"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("decimal(24,2)").alias("total")
    )


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(s: Star) -> DataFrame:
    return s.table("customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part")
def distributed_row_numbers(s: Star) -> DataFrame:
    return frames.numbered(s.table("part").select("p_retailprice", "p_partkey"), "p_retailprice", "p_partkey", name="n").select("p_partkey", "n")


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, true AS within_bound FROM events GROUP BY 1")
def approx_distinct_users(s: Star) -> DataFrame:
    """Exact counts, and whether the approximate one, made with a standard error of 2 %, lies within four of those."""
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.countDistinct("user_id")) <= 0.08 * F.countDistinct("user_id")
    return s.table("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), near.alias("within_bound"))


# ---- quality, reconciliation, lineage ------------------------------------------------------------------------------


def _row(dimension: str, table: str, name: str, measured: str, expected: str, ok: str, source: str) -> str:
    return (
        f"SELECT '{dimension}' AS dimension, '{table}' AS table_name, '{name}' AS check_name, "
        f"CAST({measured} AS VARCHAR) AS measured, '{expected}' AS expected, {ok} AS ok FROM {source}"
    )


def _check_sql(c: quality.Check) -> str:
    """What a check measures, as SQL of the oracle's tables."""
    if c.dimension == "completeness":
        share = f"count({c.what}) / CAST(count(*) AS DOUBLE)"
        return _row(c.dimension, c.table, c.name, f"round({share}, 4)", c.expected, f"{share} >= {c.least}", c.table)
    if c.dimension == "uniqueness":
        n, source = f"count(*) - count(DISTINCT {c.what})", f"{c.table} WHERE {c.where}"
    elif c.dimension == "validity":
        n, source = f"count(*) FILTER (WHERE NOT ({c.duckdb or c.what}))", c.table
    else:
        n, source = f"count(*) FILTER (WHERE p.{c.key} IS NULL)", f"{c.table} c LEFT JOIN (SELECT DISTINCT {c.key} FROM {c.parent}) p ON c.{c.what} = p.{c.key}"
    return _row(c.dimension, c.table, c.name, n, c.expected, f"{n} = 0", source)


_CITY_FORM = "city = " + TITLE.format("city")
#: The checks of the lake, and three over raw tables, which do not hold there.
CHECKS = [
    quality.complete("customers", "email_hash"),
    quality.complete("customers", "phone_masked"),
    quality.complete("orders_", "order_ts", 1.0),
    quality.complete("fact", "customer_sk", 1.0),
    quality.unique("customers", "customer_id"),
    quality.unique("orders_", "order_id"),
    quality.unique("fact", "order_item_id"),
    quality.unique("dim_customer", "customer_sk"),
    quality.unique("dim_customer", "customer_id", "is_current"),
    quality.valid("fact", "quantity > 0"),
    quality.valid("fact", "net_amount >= 0 and net_amount <= gross_amount", "0 <= net <= gross"),
    quality.valid("orders_", f"order_ts between timestamp '{EARLIEST}' and timestamp '{AS_OF}'", "order_ts in range"),
    quality.valid("customers", "email_hash is null or email_hash rlike '^[0-9a-f]{64}$'", "email is a digest", "regexp_matches(email_hash, '^[0-9a-f]{64}$')"),
    quality.valid(
        "customers", "phone_masked is null or phone_masked rlike '^XXXXXX[0-9]{4}$'", "phone is masked",
        "regexp_matches(phone_masked, '^XXXXXX[0-9]{4}$')"
    ),
    quality.valid("stores", "region in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')", "region is known"),
    quality.valid("stores", "city = initcap(lower(trim(city)))", "city in title case", _CITY_FORM),
    quality.valid("dim_customer", "effective_from < effective_to", "window is valid"),
    quality.refers("fact", "date_key", "dim_date", "date_key"),
    quality.refers("fact", "customer_sk", "dim_customer", "customer_sk"),
    quality.refers("fact", "product_key", "dim_product", "product_key"),
    quality.refers("fact", "store_key", "dim_store", "store_key"),
]
RAW_CHECKS = [
    quality.unique("r_items", "order_item_id"),
    quality.valid("r_items", "quantity > 0"),
    quality.refers("r_orders", "customer_id", "customers", "customer_id"),
]


def _checked(s: Star, dimension: str) -> DataFrame:
    tables = {**s.tables, "r_items": s.raw("order_items"), "r_orders": s.raw("orders")}
    return quality.run(tables, [c for c in CHECKS + RAW_CHECKS if c.dimension == dimension])


def _checks_sql(dimension: str) -> str:
    return sql(" UNION ALL ".join(_check_sql(c) for c in CHECKS + RAW_CHECKS if c.dimension == dimension))


@query(_checks_sql("completeness"))
def completeness(s: Star) -> DataFrame:
    return _checked(s, "completeness")


@query(_checks_sql("uniqueness"))
def uniqueness(s: Star) -> DataFrame:
    return _checked(s, "uniqueness")


@query(_checks_sql("validity"))
def validity(s: Star) -> DataFrame:
    return _checked(s, "validity")


@query(_checks_sql("integrity"))
def ref_integrity(s: Star) -> DataFrame:
    return _checked(s, "integrity")


@query(sql(" UNION ALL ".join(_check_sql(c) for c in CHECKS)))
def quality_report(s: Star) -> DataFrame:
    """All checks of the lake in one run: a scan a table."""
    return quality.run(s.tables, CHECKS)


_NATION_DIGEST = (
    "sha256(length(CAST(n_nationkey AS VARCHAR)) || ':' || CAST(n_nationkey AS VARCHAR) || length(n_name) || ':' || n_name"
    " || length(CAST(n_regionkey AS VARCHAR)) || ':' || CAST(n_regionkey AS VARCHAR))"
)
_NATION_SUM = f"CAST(sum(CAST(('0x' || substr({_NATION_DIGEST}, 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR)"


@query(f"SELECT count(*) AS n_rows, {_NATION_SUM} AS checksum FROM nation")
def table_checksum(s: Star) -> DataFrame:
    return reconcile.checksum(s.table("nation"))


@query(f"""
SELECT 'same' AS table_name, count(*) AS source_rows, {_NATION_SUM} AS source_sum, count(*) AS made_rows, {_NATION_SUM} AS made_sum, source_sum = made_sum AS ok FROM nation
UNION ALL
SELECT 'changed', * , source_rows = made_rows AND source_sum = made_sum FROM
  (SELECT count(*) AS source_rows, {_NATION_SUM} AS source_sum FROM nation),
  (SELECT count(*) AS made_rows, {_NATION_SUM} AS made_sum FROM (SELECT n_nationkey, upper(n_name) || '!' AS n_name, n_regionkey FROM nation WHERE n_nationkey > 3))
""")
def reconcile_rows(s: Star) -> DataFrame:
    """A table against a reordered copy, and against one with changed and missing rows."""
    t = s.table("nation")
    changed = t.filter("n_nationkey > 3").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return reconcile.same_rows(
        t, t.select("n_regionkey", "n_name", "n_nationkey").orderBy(F.desc("n_name")), "same"
    ).unionAll(reconcile.same_rows(t, changed, "changed"))


@query(sql("SELECT CAST(sum(CAST(quantity * unit_price AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM r_items"), "amount")
def total_amount(s: Star) -> DataFrame:
    return reconcile.total(s.raw("order_items"))


_NET = "CAST(quantity * i.unit_price - round(quantity * i.unit_price * discount_pct * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2))"
#: Net amounts by month from cleansed lines and orders, and from the facts.
_MONTHS_SQL = f"""
SELECT coalesce(a.month, b.month) AS month, a.amount AS "left", b.amount AS "right", a.amount IS NOT DISTINCT FROM b.amount AS same
FROM (SELECT strftime(order_ts, '%Y-%m') AS month, CAST(sum({_NET}) AS DECIMAL(24,2)) AS amount FROM items i JOIN orders_ o ON i.order_id = o.order_id GROUP BY 1) a
FULL JOIN (SELECT strftime(order_ts, '%Y-%m') AS month, CAST(sum(net_amount) AS DECIMAL(24,2)) AS amount FROM fact GROUP BY 1) b ON a.month = b.month
"""


def _months(s: Star) -> DataFrame:
    o, i = s.good("orders").select("order_id", "order_ts"), s.good("order_items")
    net = C.amounts(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))["net_amount"]
    return reconcile.months(reconcile.by_month(i.join(o, "order_id"), "order_ts", net), reconcile.by_month(s.fact, "order_ts", F.col("net_amount")))


@query(sql(_MONTHS_SQL), "left", "right")
def period_reconcile(s: Star) -> DataFrame:
    """Net amounts by month from cleansed lines and orders, against those of the fact table."""
    return _months(s)


MIGRATED = {"customers": "r_customers", "products": "r_products", "stores": "r_stores", "orders": "r_orders", "order_items": "r_items"}


def _migration_sql() -> str:
    parts = []
    for t, r in MIGRATED.items():
        n = f"(SELECT count(*) FROM {r} WHERE {cleaning.TABLES[t].key} IS NOT NULL)"
        parts.append(f"SELECT 'row count' AS check_name, '{t}' AS table_name, CAST({n} AS VARCHAR) AS source, CAST({n} AS VARCHAR) AS lake, true AS ok")
        parts.append(f"SELECT 'checksum', '{t}', NULL, NULL, true")
        parts.append(
            f"SELECT 'row accounting', '{t}', CAST(distinct_keys AS VARCHAR), CAST(valid_rows + quarantined_rows AS VARCHAR), distinct_keys = valid_rows + quarantined_rows FROM ({_ACCOUNTS[t]})"
        )
    amount = "SELECT CAST(sum(CAST(quantity * unit_price AS DECIMAL(18,2))) AS VARCHAR) AS a FROM r_items"
    parts.append(f"SELECT 'total amount', 'order_items', a, a, true FROM ({amount})")
    parts.append(f'SELECT \'net amounts by month\', \'fact\', CAST(sum("left") AS VARCHAR), CAST(sum("right") AS VARCHAR), bool_and(same) FROM ({_MONTHS_SQL})')
    return sql(" UNION ALL ".join(parts))


@query(_migration_sql())
def migration_report(s: Star) -> DataFrame:
    """All checks of a migration in one run: the source tables go to versioned tables, and are held against what was made of them.

    Checksums are compared here and shown in `table_checksum`; a failed one would make `ok` false.
    """
    parts = []
    for t in MIGRATED:
        source = s.raw(t).filter(F.col(cleaning.TABLES[t].key).isNotNull())
        lake = VersionedTable(s.spark, scratch(s.spark, f"bronze-{t}"))
        lake.append(jdbc.audited(source.drop(*cleaning.AUDIT), f"source.{t}", "full", "b1", F.lit(AS_OF).cast("timestamp")), partition_by=("ingest_date",))
        plain = source.drop(*cleaning.AUDIT)
        parts.append(reconcile.migrated(plain, lake.read(), t))
        account = cleaning.accounting(s.raw(t), cleaning.TABLES[t].key, s.good(t), s.rejected(t))
        kept = F.col("valid_rows") + F.col("quarantined_rows")
        parts.append(reconcile.line(account, "row accounting", t, F.col("distinct_keys"), kept))
        if t == "order_items":
            parts.append(reconcile.line(reconcile.pair(reconcile.total(plain), reconcile.total(lake.read())), "total amount", t, F.col("a"), F.col("b")))
    months = _months(s).agg(F.sum("left").alias("a"), F.sum("right").alias("b"), F.bool_and("same").alias("same"))
    parts.append(reconcile.line(months, "net amounts by month", "fact", F.col("a"), F.col("b"), F.col("same")))
    return reduce(DataFrame.unionAll, parts)


GOLD_SCRIPT = """
-- sales by region; a ; in a comment and in 'a ; literal' is no end of a statement
CREATE OR REPLACE TABLE gold.sales AS SELECT s.region, sum(f.net) AS net FROM silver.facts f JOIN silver.stores s ON f.store = s.id WHERE s.note <> 'FROM nowhere.x; --' GROUP BY s.region;
CREATE OR REPLACE VIEW gold.top_sales AS SELECT * FROM gold.sales WHERE net > 0;
MERGE INTO gold.customers AS t USING silver.customers AS c ON t.id = c.id WHEN MATCHED THEN UPDATE SET t.city = c.city;
"""


@query("""
    SELECT * FROM (VALUES ('gold.sales', 'gold.top_sales', 'gold.sql'), ('silver.customers', 'gold.customers', 'gold.sql'), ('silver.facts', 'gold.sales',
    'gold.sql'), ('silver.stores', 'gold.sales', 'gold.sql')) t(source, target, via)
""")
def lineage_edges(s: Star) -> DataFrame:
    edges = [e for k in files.statements(GOLD_SCRIPT) for e in lineage.script_edges("gold.sql", k)]
    return lineage.edges_frame(s.spark, sorted(edges))


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean"}
_TYPE = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " ELSE lower(column_type) END"
_CATALOGUED = {"silver.customers": "customers", "silver.orders": "orders_", "gold.fact_sales": "fact", "gold.dim_customer": "dim_customer"}


def _described_sql() -> str:
    personal = """
    CASE WHEN column_name IN ('first_name', 'last_name', 'email', 'phone') THEN 'yes' WHEN column_name = 'email_hash' THEN 'pseudonymised' WHEN
    column_name = 'phone_masked' THEN 'masked' ELSE 'no' END
"""
    owner = "CASE WHEN table_name LIKE 'gold.%' THEN 'analytics' ELSE 'platform' END"
    each = [f"SELECT '{t}' AS table_name, column_name, {_TYPE} AS type FROM (DESCRIBE {sql(f'SELECT * FROM {part}')})" for t, part in _CATALOGUED.items()]
    return f"SELECT *, {personal} AS personal, {owner} AS owner, true AS described FROM ({' UNION ALL '.join(each)})"


@query(_described_sql())
def catalog_columns(s: Star) -> DataFrame:
    """Columns with types, marks of personal data and owners, and whether each has a description; audit columns left out."""
    tables = {name: s.tables[part] for name, part in _CATALOGUED.items()}
    found = lineage.catalogue(s.spark, tables, {"silver": "platform", "gold": "analytics"})
    return found.filter(~F.col("column_name").isin(*cleaning.AUDIT)).select(
        "table_name", "column_name", "type", "personal", "owner", (F.length("description") > 0).alias("described")
    )


@query("""
    SELECT * FROM (VALUES (1, 'refused'), (2, 'merged')) t(step, outcome)
    UNION ALL SELECT 3, CAST(count(*) AS VARCHAR) || ' rows, ' || CAST(count(*) FILTER (WHERE event_id % 2 = 1) AS VARCHAR) || ' with transport'
    FROM events
""")
def supplier_json_ingest(s: Star) -> DataFrame:
    """JSON lines of a second month with more columns: refused by the table of the first month, then taken as its schema grows."""
    path, table = scratch(s.spark, "landing"), VersionedTable(s.spark, scratch(s.spark, "deliveries"))
    e = s.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("delivered_on"))
    e.filter("event_id % 2 = 0").write.json(f"{path}/1")
    e.filter("event_id % 2 = 1").select(
        "*", F.struct(F.lit("road").alias("mode")).alias("transport"), F.array(F.lit("b")).alias("batch_codes")
    ).write.json(f"{path}/2")
    first, second = (files.json_lines(s.spark, f"{path}/{k}") for k in (1, 2))
    table.append(first)
    outcome = [f"more columns: {files.drift(first, second)}"]
    try:
        table.append(second)
    except SchemaMismatch:
        outcome = ["refused"]
    table.append(second, merge_schema=True)
    outcome.append("merged" if set(table.schema().names) == set(second.columns) else "lost columns")
    counted = table.read().agg(
        F.concat(F.count("*").cast("string"), F.lit(" rows, "), F.count("transport.mode").cast("string"), F.lit(" with transport")).alias("outcome")
    )
    steps = s.spark.createDataFrame([(k + 1, o) for k, o in enumerate(outcome)], "step int, outcome string")
    return steps.unionAll(counted.select(F.lit(3).alias("step"), "outcome"))


# ---- sources, sinks, versioned tables ------------------------------------------------------------------------------


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def from_json_expand(s: Star) -> DataFrame:
    return s.table("events").select(
        "event_type", F.from_json("props", "k int").alias("p")
    ).select("event_type", "p.*").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS deliveries, count(*) FILTER (WHERE event_id % 2 = 1) AS with_transport, CAST(sum(CASE WHEN
    event_id % 2 = 1 THEN event_id % 4 ELSE 0 END) AS BIGINT) AS batch_codes FROM events GROUP BY 1
""")
def nested_json_monthly(s: Star) -> DataFrame:
    """Two generations of JSON lines, the later with a struct and an array more, as one table."""
    path = scratch(s.spark, "json")
    e = s.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    e.filter("event_id % 2 = 0").write.json(f"{path}/a")
    e.filter("event_id % 2 = 1").select(
        "*", F.struct(F.lit("road").alias("mode"), F.col("day").alias("vehicle_no")).alias("transport"),
        F.expr("slice(array('a', 'b', 'c'), 1, cast(event_id % 4 as int))").alias("batch_codes")
    ).write.json(f"{path}/b")
    both = files.united(files.json_lines(s.spark, f"{path}/a"), files.json_lines(s.spark, f"{path}/b"))
    return both.groupBy("day").agg(
        F.count("*").alias("deliveries"), F.count("transport.mode").alias("with_transport"),
        F.sum(F.coalesce(F.size("batch_codes"), F.lit(0))).cast("long").alias("batch_codes")
    )


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer")
def schema_drift_union(s: Star) -> DataFrame:
    c = s.table("customer")
    old, new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), c.filter("c_custkey % 2 = 1").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return files.united(old, new)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000")
def csv_round_trip(s: Star) -> DataFrame:
    path = scratch(s.spark, "csv")
    files.export(s.table("supplier"), path, ["s_suppkey", "s_name", "s_acctbal"])
    return files.delimited(s.spark, path, "s_suppkey long, s_name string, s_acctbal double").filter("s_acctbal > 5000")


def _versions(s: Star) -> VersionedTable:
    """A table that is made, grows by rows with a column more after they were refused, and is merged into."""
    t = VersionedTable(s.spark, scratch(s.spark, "table"))
    n = s.table("nation")
    t.create("n_nationkey int, n_name string")
    t.append(n.filter("n_nationkey < 10").select("n_nationkey", "n_name"))
    later = n.filter("n_nationkey >= 10 and n_nationkey < 20")
    try:
        t.append(later)
        raise AssertionError("an unknown column was taken")
    except SchemaMismatch:
        t.append(later, merge_schema=True)
    source = n.filter("n_nationkey >= 18")
    t.merge(
        source, F.expr("t.n_nationkey = s.n_nationkey"), {"n_name": F.concat(F.lit("NEW "), F.col("s.n_name"))},
        {c: F.col(f"s.{c}") for c in ("n_nationkey", "n_name", "n_regionkey")}
    )
    return t


@query("""
    SELECT n_nationkey, CASE WHEN n_nationkey IN (18, 19) THEN 'NEW ' || n_name ELSE n_name END AS n_name, CASE WHEN n_nationkey >= 10 THEN n_regionkey
    END AS n_regionkey FROM nation
""")
def versioned_merge(s: Star) -> DataFrame:
    return _versions(s).read()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def time_travel_read(s: Star) -> DataFrame:
    return _versions(s).read(1)


@query("""
    SELECT CAST(version AS BIGINT) AS version, operation, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_matching AS BIGINT) AS n_matching
    FROM (VALUES (0, 'CREATE TABLE', 0, 0), (1, 'WRITE append', 10, 5), (2, 'WRITE append', 20, 10), (3, 'MERGE', 25, 13)) t(version, operation,
    n_rows, n_matching)
""")
def time_travel_counts(s: Star) -> DataFrame:
    return _versions(s).as_of_counts("n_nationkey % 2 = 0")


@query("""
    SELECT CAST(version AS BIGINT) AS version, operation, CAST(n_rows AS BIGINT) AS n_rows FROM (VALUES (3, 'MERGE', 25), (2, 'WRITE append', 20),
    (1, 'WRITE append', 10), (0, 'CREATE TABLE', 0)) t(version, operation, n_rows)
""")
def table_history(s: Star) -> DataFrame:
    return _versions(s).history().drop("timestamp")


def _derby(s: Star, *more: Column) -> jdbc.Source:
    """A database with the suppliers, and `more` columns, that every process of the session can read."""
    return jdbc.embedded(s.table("supplier").select("s_suppkey", "s_name", *more), "supplier")


@query("SELECT s_suppkey, s_name FROM supplier")
def jdbc_partitioned_read(s: Star) -> DataFrame:
    return jdbc.partitioned(s.spark, _derby(s), "supplier", '"s_suppkey"', 4).select("s_suppkey", "s_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey <= 5 THEN 'full' ELSE 'incremental' END AS _load_type FROM supplier")
def jdbc_incremental(s: Star) -> DataFrame:
    """A first load up to a watermark, then what changed since; read twice, the second load adds nothing."""
    from datetime import UTC, datetime, timedelta

    changes = F.timestamp_seconds(F.lit(1_000_000_000) + F.col("s_suppkey") * 3600)
    source, target = _derby(s, changes.alias("updated_at")), VersionedTable(s.spark, scratch(s.spark, "bronze"))
    at = F.lit(AS_OF).cast("timestamp")
    mark = datetime.fromtimestamp(1_000_000_000, UTC).replace(tzinfo=None) + timedelta(hours=5)
    first = jdbc.partitioned(s.spark, source, "supplier", '"s_suppkey"', 2, jdbc.changed('"updated_at"', None, mark))
    target.append(jdbc.audited(first, "jdbc.supplier", "full", "b1", at), partition_by=("ingest_date",))
    _, top = jdbc.ingest(s.spark, source, "supplier", '"s_suppkey"', 4, target, "b2", at, '"updated_at"', mark)
    n, _ = jdbc.ingest(s.spark, source, "supplier", '"s_suppkey"', 4, target, "b3", at, '"updated_at"', top)
    assert n == 0
    return target.read().select("s_suppkey", "_load_type")


# ---- streams -------------------------------------------------------------------------------------------------------


def _envelopes(s: Star, parts: range = range(5), path: str | None = None, of: int = 5) -> str:
    """The events as a replayable topic: JSON lines in order of time, a file a part; `parts` are those written now."""
    path = path or scratch(s.spark, "topic")
    e = s.table("events")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    k = F.col("event_id")
    fields = {
        "event_id": k.cast("string"), "event_type": F.col("event_type"), "customer_id": F.col("user_id").cast("int"),
        "amount": F.when(F.col("event_type") == "purchase", F.col("value")), "event_time": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    }
    body = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    part = F.floor((k - low) * of / (high - low + 1)).cast("int")
    made = e.withColumn("part", part).select(
        "part", F.pmod("event_id", F.lit(3)).cast("int").alias("partition"), F.floor(k / 3).alias("offset"), body.alias("value")
    )
    for p in parts:  # files come one after the other, as a topic grows
        made.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").json(path)
    return path


_CLOSED = """
    SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS window_end, event_type,
    count(*) AS n_events, CAST(sum(CAST(CASE WHEN event_type = 'purchase' THEN value END AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount
    FROM events GROUP BY ALL
"""


@query(_CLOSED, "amount")
def tumbling_window_batch(s: Star) -> DataFrame:
    e = s.table("events").select(
        F.col("ts").cast("timestamp").alias("event_time"), "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        F.col("user_id").alias("customer_id")
    )
    return S.windows(e).drop("customers")


@query(f"SELECT * FROM ({_CLOSED}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES", "amount")
def stream_window_append(s: Star) -> DataFrame:
    """The windows that a stream of five batches has closed by its end."""
    table = VersionedTable(s.spark, scratch(s.spark, "windows"))
    S.to_table(S.windows(S.parsed(S.replay(s.spark, _envelopes(s)))), table, scratch(s.spark, "checkpoint"), "windows").awaitTermination()
    return table.read().drop("customers")


@query("""
    SELECT CAST(event_id % 3 AS INT) AS partition, count(*) AS n_events, CAST(min(event_id // 3) AS BIGINT) AS min_offset, CAST(max(event_id //
    3) AS BIGINT) AS max_offset FROM events GROUP BY 1
""")
def stream_raw_audit(s: Star) -> DataFrame:
    """Raw events as streamed to files, by partition of the topic."""
    path, schema = scratch(s.spark, "raw"), "partition int, offset bigint, event_id string, event_type string, customer_id int, product_id int, store_id int, amount double, event_time timestamp"
    S.to_files(S.parsed(S.replay(s.spark, _envelopes(s))), path, scratch(s.spark, "checkpoint")).awaitTermination()
    return S.audit(s.spark.read.schema(schema).parquet(path))


@query("SELECT event_type, count(*) AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS n_events FROM events GROUP BY 1")
def stream_restart(s: Star) -> DataFrame:
    """A stream that stops after three files and goes on from its checkpoint when two more have come; then from an offset log that was lost: each event once."""
    topic, checkpoint = _envelopes(s, range(3)), scratch(s.spark, "checkpoint")
    table = VersionedTable(s.spark, scratch(s.spark, "events"))
    run = lambda folder: S.to_table(S.parsed(S.replay(s.spark, topic)), table, folder, "events").awaitTermination()
    run(checkpoint)
    before = table.manifest()["rows"]
    _envelopes(s, range(3, 5), topic)
    run(checkpoint)
    if not 0 < before < table.manifest()["rows"]:
        raise AssertionError("the second run brought nothing new")
    run(scratch(s.spark, "new-checkpoint"))  # the same files from the first batch on, which the table knows
    return table.read().groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_events"))


@query("""
    SELECT 'raw' AS sink, count(*) AS n_events FROM events UNION ALL SELECT 'windows', CAST(sum(n_events) AS BIGINT)
    FROM (
""" + _CLOSED + ") WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
def stream_three_sinks(s: Star) -> DataFrame:
    """Three queries side by side over one definition of a source: raw files, closed windows in a table, changed windows on the console."""
    topic, raw = _envelopes(s), scratch(s.spark, "raw")
    table = VersionedTable(s.spark, scratch(s.spark, "windows"))
    events = S.parsed(S.replay(s.spark, topic))
    S.run_all([
        S.to_files(events, raw, scratch(s.spark, "checkpoint")),
        S.to_table(S.windows(events), table, scratch(s.spark, "checkpoint"), "windows"),
        S.to_console(S.windows(events), None, 1),
    ])
    files_ = s.spark.read.schema("event_id string").parquet(raw).agg(F.lit("raw").alias("sink"), F.count("*").alias("n_events"))
    return files_.unionAll(table.read().agg(F.lit("windows").alias("sink"), F.sum("n_events").alias("n_events")))


@query(_CLOSED, "amount")
def stream_window_update(s: Star) -> DataFrame:
    """Every change of every window as a stream in update mode emits it; of each window the last change is the batch result."""
    table, number = VersionedTable(s.spark, scratch(s.spark, "updates")), "batch"

    def sink(batch: DataFrame, k: int) -> None:
        table.append(batch.withColumn(number, F.lit(k)), once=f"updates:{k}")

    stream = S.windows(S.parsed(S.replay(s.spark, _envelopes(s))))
    stream.writeStream.outputMode("update").option(
        "checkpointLocation", scratch(s.spark, "checkpoint")
    ).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("n_events", "amount"), number).alias("x")
    return table.read().groupBy("window_start", "window_end", "event_type").agg(last).select(
        "window_start", "window_end", "event_type", "x.n_events", "x.amount"
    )


# ---- the lake as a whole -------------------------------------------------------------------------------------------


@query("""
    SELECT table_name, CAST(n_changed AS BIGINT) AS n_changed FROM (VALUES ('customers', 35), ('products', 10), ('stores', 0), ('orders', 250),
    ('order_items', 400)) t(table_name, n_changed)
""")
def cdc_change_batch(s: Star) -> DataFrame:
    """How many rows a change batch has, by table."""
    out = None
    for t in ("customers", "products", "stores", "orders", "order_items"):
        one = retail.change_batch(s.spark, s.sf_dir, t, AS_OF).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_changed"))
        out = one if out is None else out.unionAll(one)
    return out


@query(sql("SELECT 'customers' AS table_name, count(DISTINCT customer_id) + 10 AS n_keys, 25 AS n_moved FROM r_customers"))
def cdc_bronze_history(s: Star) -> DataFrame:
    """All versions of customers in a table that a full load and a change batch were appended to: current keys, and those that moved."""
    bronze = VersionedTable(s.spark, scratch(s.spark, "bronze"))
    audit = lambda df, kind: jdbc.audited(df.drop("_ingested_at", "_source", "_batch_id"), "source.customers", kind, kind, F.lit(AS_OF).cast("timestamp"))
    bronze.append(audit(s.raw("customers").filter("customer_id is not null"), "full"), partition_by=("ingest_date",), once="full")
    bronze.append(
        audit(retail.change_batch(s.spark, s.sf_dir, "customers", AS_OF).filter("customer_id is not null"), "incremental"),
        partition_by=("ingest_date",), once="change"
    )
    current = frames.latest(bronze.read(), "customer_id")
    return current.agg(
        F.lit("customers").alias("table_name"), F.count("*").alias("n_keys"), F.count_if(F.col("city") == "Moved City").cast("int").alias("n_moved")
    )


@query("""
    SELECT 'supplier' AS table_name, count(*) AS n_rows FROM supplier
    UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part
""")
def migration_counts(s: Star) -> DataFrame:
    """Rows of source tables after they went to versioned tables and back; a failed checksum would drop a table from the result."""
    out = None
    for t in ("supplier", "nation", "part"):
        copy = VersionedTable(s.spark, scratch(s.spark, t))
        copy.append(s.table(t))
        one = reconcile.same_rows(s.table(t), copy.read(), t).filter("ok").select("table_name", F.col("made_rows").alias("n_rows"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""
    SELECT * FROM (VALUES ('lake_x.nations', 'n_name', 'string', 'EXTERNAL', 'parquet'), ('lake_x.nations', 'n_nationkey', 'int', 'EXTERNAL', 'parquet'),
    ('lake_x.ratings', 'rating', 'double', 'EXTERNAL', 'csv'), ('lake_x.ratings', 'supplier_id', 'int', 'EXTERNAL', 'csv')) t(table_name, column_name,
    type, table_type, provider)
""")
def catalog_tables(s: Star) -> DataFrame:
    """External tables over Parquet and over CSV with a header, as the catalogue describes them; their files outlive them."""
    path = scratch(s.spark, "external")
    s.table("nation").select("n_nationkey", "n_name").write.parquet(f"{path}/nations")
    files.export(s.table("supplier").select(F.col("s_suppkey").cast("int").alias("supplier_id"), F.col("s_acctbal").alias("rating")), f"{path}/ratings")
    catalog.databases(s.spark, "lake_x")
    catalog.external(s.spark, "lake_x.nations", f"{path}/nations")
    catalog.external(s.spark, "lake_x.ratings", f"{path}/ratings", "csv", "supplier_id int, rating double", header="true")
    out = catalog.tables(s.spark, "lake_x")
    top = s.spark.sql("SELECT supplier_id FROM lake_x.ratings ORDER BY rating DESC, supplier_id LIMIT 3").collect()
    catalog.unregister(s.spark, "lake_x.nations")
    assert len(top) == 3 and s.spark.read.parquet(f"{path}/nations").count() > 0
    return out


@query("SELECT * FROM (VALUES ('fact_sales', 14), ('dim_customer', 8), ('dim_product', 6), ('dim_store', 5), ('dim_date', 11)) t(table_name, n_columns)")
def export_allow_lists(s: Star) -> DataFrame:
    """The exported files' headers, counted; no name, address or number of a person is among them."""
    path = scratch(s.spark, "exports")
    A.export_star(
        {"fact_sales": s.fact, "dim_customer": s.customer_dimension, "dim_product": s.product_dimension, "dim_store": s.store_dimension, "dim_date": s.dates},
        path
    )
    rows = []
    for name in A.EXPORTS:
        columns = s.spark.read.csv(f"{path}/{name}", header=True).columns
        assert not {"first_name", "last_name", "email_hash", "phone_masked"} & set(columns)
        rows.append((name, len(columns)))
    return s.spark.createDataFrame(rows, "table_name string, n_columns int")


@query("""
    SELECT name, layer, CAST(n_rows AS BIGINT) AS n_rows, CAST(version AS BIGINT) AS version FROM (VALUES ('gold.sales', 'gold', NULL, NULL), ('gold.top_sales',
    'gold', NULL, NULL), ('gold.customers', 'gold', NULL, NULL), ('silver.customers', 'silver', NULL, NULL), ('silver.facts', 'silver', NULL, NULL),
    ('silver.stores', 'silver', 25, 3)) t(name, layer, n_rows, version)
""")
def lineage_nodes(s: Star) -> DataFrame:
    t = _versions(s)
    edges = [e for k in files.statements(GOLD_SCRIPT) for e in lineage.script_edges("gold.sql", k)]
    return lineage.nodes(s.spark, edges, {"silver.stores": (t.read(), t.versions()[-1])})


@query("SELECT count(DISTINCT c_nationkey) + 1 AS n_distinct FROM customer")
def distinct_with_null(s: Star) -> DataFrame:
    """Distinct values where null counts once, unlike in count(DISTINCT)."""
    k = F.col("c_nationkey")
    return s.table("customer").select(k).unionAll(s.table("customer").select(F.lit(None).cast("int"))).distinct().agg(F.count("*").alias("n_distinct"))
