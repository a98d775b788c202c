"""The same rules a second time, as DuckDB SQL from the raw tables on; each query names the parts that it needs."""

from __future__ import annotations

from granary.plans.star import AS_OF, EARLIEST
from granary.sources import retail

TITLE = "array_to_string(list_transform(string_split(lower(trim({0})), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
NAME = "array_to_string(list_transform(string_split(lower(trim({0})), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
PHONE = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace({0}, '[^0-9]', '', 'g'), 10) END"
TS = "coalesce(try_strptime({0}, '%Y-%m-%d %H:%M:%S'), try_strptime({0}, '%d/%m/%Y %H:%M'))"
LOST = "order_status NOT IN ('CANCELLED', 'RETURNED')"
HASH = "sha256(coalesce(length(city) || ':' || city, '-') || coalesce(length(state) || ':' || state, '-'))"
PCT = "CAST(round(100 * CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0), 1) + 0.0 AS DOUBLE)"


def _latest(name: str, key: str, rest: str) -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in rest.split())
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC NULLS LAST, _ingested_at DESC NULLS LAST, {order}) AS rn FROM {name}) WHERE rn = 1 OR {key} IS NULL"


_CUSTOMER = f"""
    customer_id, {NAME.format('first_name')} AS first_name, {NAME.format('last_name')} AS last_name, sha256(lower(trim(email))) AS email_hash, 'XXXXXX'
    || right({PHONE.format('phone')}, 4) AS phone_masked, {TITLE.format('city')} AS city, trim(state) AS state, signup_date, updated_at
"""
_C_REST = "first_name last_name email phone city state signup_date _source _batch_id"


def _reasons(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + "], lambda x: x IS NOT NULL), '; ')"


PARTS: dict[str, str] = {
    "r_customers": retail.duckdb("customers"), "r_products": retail.duckdb("products"), "r_stores": retail.duckdb("stores"), "r_orders": retail.duckdb("orders"), "r_items": retail.duckdb("order_items"),
    "l_customers": _latest("r_customers", "customer_id", _C_REST),
    "customers": f"SELECT {_CUSTOMER} FROM l_customers WHERE customer_id IS NOT NULL",
    "r_first": f"SELECT * FROM r_customers WHERE updated_at < TIMESTAMP '{EARLIEST}'",
    "l_first": _latest("r_first", "customer_id", _C_REST),
    "first_customers": f"SELECT {_CUSTOMER} FROM l_first WHERE customer_id IS NOT NULL",
    "l_products": _latest("r_products", "product_id", "product_name category brand unit_price _source _batch_id"),
    "products": """
    SELECT product_id, trim(product_name) AS product_name, coalesce(category, 'Unknown') AS category, brand, unit_price, updated_at
    FROM l_products WHERE NOT coalesce(unit_price < 0, false) AND product_id IS NOT NULL
""",
    "l_stores": _latest("r_stores", "store_id", "store_name city region opened_date _source _batch_id"),
    "stores": f"""
    SELECT store_id, store_name, {TITLE.format('city')} AS city, upper(trim(region)) AS region, opened_date, updated_at
    FROM l_stores WHERE store_id IS NOT NULL
""",
    "l_orders": _latest("r_orders", "order_id", "customer_id store_id order_date status payment_method _source _batch_id"),
    "t_orders": f"SELECT *, {TS.format('order_date')} AS order_ts FROM l_orders",
    "j_orders": "SELECT o.*, " + _reasons(
        ("order_ts IS NULL", "unparseable order_date"), (
            f"order_ts > TIMESTAMP '{AS_OF}'", "order_date in the future"
        ), (f"order_ts < TIMESTAMP '{EARLIEST}'", "order_date too early"), ("o.customer_id IS NULL", "missing customer_id"),
        ("o.customer_id IS NOT NULL AND c.customer_id IS NULL", "unknown customer_id"), ("s.store_id IS NULL", "unknown store_id")) + " AS reason FROM t_orders o LEFT JOIN customers c ON o.customer_id = c.customer_id LEFT JOIN stores s ON o.store_id = s.store_id",
    "orders_": """
    SELECT order_id, customer_id, store_id, order_ts, CAST(order_ts AS DATE) AS order_date, upper(status) AS order_status, payment_method, updated_at
    FROM j_orders WHERE reason = ''
""",
    "l_items": _latest("r_items", "order_item_id", "order_id product_id quantity unit_price discount_pct _source _batch_id"),
    "j_items": "SELECT i.*, " + _reasons(
        ("quantity <= 0", "non-positive quantity"), ("i.unit_price < 0", "negative unit_price"),
        ("p.product_id IS NULL", "product missing or quarantined"), ("o.order_id IS NULL", "parent order missing or quarantined")
    )
        + " AS reason FROM l_items i LEFT JOIN orders_ o ON i.order_id = o.order_id LEFT JOIN products p ON i.product_id = p.product_id",
    "items": "SELECT order_item_id, order_id, product_id, quantity, unit_price, discount_pct, updated_at FROM j_items WHERE reason = ''",
    "dim_date": """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, strftime(d, '%B') AS month_name, strftime(d, '%Y-%m') AS year_month,
        CAST(dayofweek(d) + 1 AS INT) AS day_of_week, strftime(d, '%A') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend, 'FY' || CAST(year(d) + CASE WHEN month(d) >= 4 THEN 1 ELSE 0 END AS VARCHAR) AS fiscal_year
        FROM (SELECT CAST(unnest(generate_series(date_trunc('year', (SELECT min(order_date) FROM orders_)), last_day((SELECT max(order_date) FROM orders_)), INTERVAL 1 DAY)) AS DATE) AS d)""",
    "dim_product": """
    SELECT product_id AS product_key, product_name, category, brand, unit_price AS current_unit_price, CASE WHEN unit_price < 920 THEN 'Budget'
    WHEN unit_price < 970 THEN 'Mid' ELSE 'Premium' END AS price_band FROM products
""",
    "dim_store": "SELECT store_id AS store_key, store_name, city, region, opened_date FROM stores",
    "dim_first": f"""
    SELECT row_number() OVER (ORDER BY customer_id) AS customer_sk, customer_id, first_name, last_name, email_hash, phone_masked, city, state, signup_date,
    {HASH} AS row_hash, TIMESTAMP '1900-01-01' AS effective_from, TIMESTAMP '9999-12-31' AS effective_to, true AS is_current
    FROM first_customers
""",
    "moved": f"""
    SELECT c.*, d.customer_id IS NOT NULL AS known FROM (SELECT *, {HASH} AS h FROM customers) c LEFT JOIN dim_first d ON c.customer_id = d.customer_id
    WHERE d.customer_id IS NULL OR d.row_hash <> h
""",
    "fed": """
    SELECT *, row_number() OVER (ORDER BY customer_id, ins) + (SELECT coalesce(max(customer_sk), 0) FROM dim_first) AS sk
    FROM (SELECT *, 0 AS ins FROM moved UNION ALL SELECT *, 1 FROM moved WHERE known)
""",
    "dim_customer": """SELECT d.customer_sk, d.customer_id, d.first_name, d.last_name, d.email_hash, d.phone_masked, d.city, d.state, d.signup_date, d.row_hash, d.effective_from, CASE WHEN m.customer_id IS NOT NULL THEN m.updated_at ELSE d.effective_to END AS effective_to, m.customer_id IS NULL AS is_current
        FROM dim_first d LEFT JOIN moved m ON d.customer_id = m.customer_id UNION ALL
        SELECT sk, customer_id, first_name, last_name, email_hash, phone_masked, city, state, signup_date, h, CASE WHEN known THEN updated_at ELSE TIMESTAMP '1900-01-01' END, TIMESTAMP '9999-12-31', true FROM fed WHERE NOT known OR ins = 1""",
    "money": "SELECT *, quantity * unit_price AS g, round(quantity * unit_price * discount_pct * CAST(0.01 AS DECIMAL(3,2)), 2) AS dis FROM items",
    "fact": """SELECT order_item_id, i.order_id, CAST(strftime(order_ts, '%Y%m%d') AS INT) AS date_key, customer_sk, product_id AS product_key, store_id AS store_key, order_status, payment_method, quantity, unit_price, discount_pct,
        CAST(g AS DECIMAL(14,2)) AS gross_amount, CAST(dis AS DECIMAL(14,2)) AS discount_amount, CAST(g - dis AS DECIMAL(14,2)) AS net_amount, order_ts
        FROM money i JOIN orders_ o ON i.order_id = o.order_id LEFT JOIN dim_customer d ON o.customer_id = d.customer_id AND order_ts >= effective_from AND order_ts < effective_to""",
    "view_": """SELECT order_item_id, order_id, full_date AS order_date, year, month, year_month, f.customer_sk, c.city AS customer_city, c.state AS customer_state, product_name, category, brand, price_band, store_name, s.city AS store_city, region,
        order_status, payment_method, quantity, gross_amount, discount_amount, net_amount
        FROM fact f JOIN dim_date d ON f.date_key = d.date_key JOIN dim_customer c ON f.customer_sk = c.customer_sk JOIN dim_product p ON f.product_key = p.product_key JOIN dim_store s ON f.store_key = s.store_key""",
    "cohorts": f"""SELECT strftime(cohort, '%Y-%m') AS cohort_quarter_start, quarters_since, active_customers, {PCT.format('active_customers', 'first_value(active_customers) OVER (PARTITION BY cohort ORDER BY quarters_since)')} AS retention_pct FROM (
        SELECT cohort, CAST(datediff('quarter', cohort, q) AS INT) AS quarters_since, count(DISTINCT a.customer_id) AS active_customers
        FROM (SELECT DISTINCT customer_id, date_trunc('quarter', order_date) AS q FROM view_ v JOIN dim_customer d ON v.customer_sk = d.customer_sk WHERE order_status <> 'CANCELLED') a
        JOIN (SELECT customer_id, min(date_trunc('quarter', order_date)) AS cohort FROM view_ v JOIN dim_customer d ON v.customer_sk = d.customer_sk WHERE order_status <> 'CANCELLED' GROUP BY customer_id) f ON a.customer_id = f.customer_id GROUP BY 1, 2)""",
}


def sql(final: str) -> str:
    """The final SELECT, below all parts that it needs, each computed once."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if word in PARTS and word not in need and re.search(rf"\b(?:FROM|JOIN)\s+{word}\b", text):
                visit(PARTS[word])
                if word not in need:
                    need.append(word)

    visit(final)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in need) + "\n" if need else "") + final
