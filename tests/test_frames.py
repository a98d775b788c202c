"""Operators on small frames: nulls, ties, repeats, empty tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators import cleaning, frames, modelling, quality, reconcile

D0, D1 = datetime(2024, 1, 1), datetime(2025, 6, 1)


def one(spark, ddl, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_masks(spark):
    assert len(set(one(spark, "e string", [(" A@x.com ",), ("a@X.com",)], C.email_token(F.col("e"))))) == 1
    assert one(spark, "e string", [(None,)], C.email_token(F.col("e"))) == [None]
    assert one(spark, "p string", [("+91-9876543210",), ("09876543210",), ("+91 98765 43210",), ("123",), (None,)], C.phone_hint(F.col("p"))) == ["XXXXXX3210"] * 3 + [None] * 2


def test_dates(spark):
    t = one(spark, "d string", [("2025-03-01 10:00:00",), ("01/03/2025 10:00",), ("2025-02-30 10:00:00",), ("N/A",), ("",), (None,)], C.legacy_timestamp(F.col("d")))
    assert t == [datetime(2025, 3, 1, 10)] * 2 + [None] * 4


def test_row_digest_tells_nulls_apart(spark):
    a, b = one(spark, "a string, b string", [(None, "x"), ("x", None)], C.row_digest("a", "b"))
    assert a != b


def test_latest(spark):
    ddl = "k int, city string, updated_at timestamp, _ingested_at timestamp"
    rows = [(1, "old", D0, D0), (1, "new", D1, D0), (2, "x", D0, D0), (2, "x", D0, D0), (3, "b", D0, D0), (3, "a", D0, D0), (None, "p", D0, D0), (None, "q", D0, D0)]
    got = sorted(map(tuple, frames.latest(spark.createDataFrame(rows, ddl), "k").select("k", "city").collect()), key=str)
    assert got == [(1, "new"), (2, "x"), (3, "a"), (None, "p"), (None, "q")]
    assert frames.latest(spark.createDataFrame([], ddl), "k").count() == 0


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 2), (2, -1), (3, 0), (4, None)], "id int, quantity int")
    good, bad = frames.split(df, [(F.col("quantity") <= 0, "not positive"), (F.col("id") > 2, "late")])
    assert sorted(r["id"] for r in good.collect()) == [1]
    assert {r["id"]: r[frames.REASON] for r in bad.collect()} == {2: "not positive", 3: "not positive; late", 4: "late"}


def test_valid_at_is_half_open(spark):
    v = spark.createDataFrame([(1, 10, D0, D1), (1, 11, D1, datetime(9999, 1, 1))], "k int, sk int, effective_from timestamp, effective_to timestamp")
    at = spark.createDataFrame([(1, D0), (1, D1), (1, datetime(2023, 1, 1)), (None, D0)], "k int, t timestamp")
    assert sorted((r["sk"] for r in frames.valid_at(at, v, "k", "t", {"sk": "sk"}).collect()), key=str) == [10, 11, None, None]


def test_numbered_is_consecutive(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(7)
    got = frames.numbered(df, "x", name="n").orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


SNAPSHOT = "customer_id int, first_name string, last_name string, email_hash string, phone_masked string, city string, state string, signup_date date, updated_at timestamp"


def test_history(spark):
    person = lambda k, city, state, at: (k, "A", "B", "h", "p", city, state, None, at)
    day1 = spark.createDataFrame([person(1, "Pune", "MH", D0), person(2, None, "TN", D0)], SNAPSHOT)
    dim = modelling.next_customer_dimension(spark.createDataFrame([], modelling.CUSTOMER_SCHEMA), day1)
    day2 = spark.createDataFrame([person(1, "Bengaluru", "KA", D1), person(2, None, "TN", D0), person(3, "Kolkata", "WB", D1)], SNAPSHOT)
    two = modelling.next_customer_dimension(dim, day2)
    rows = {(r["customer_id"], r["city"]): r for r in two.collect()}
    assert len(rows) == 4
    assert (rows[1, "Pune"]["is_current"], rows[1, "Pune"]["effective_to"]) == (False, D1)
    assert (rows[1, "Bengaluru"]["is_current"], rows[1, "Bengaluru"]["effective_from"]) == (True, D1)
    assert rows[2, None]["is_current"] and len({r["customer_sk"] for r in rows.values()}) == 4
    assert modelling.next_customer_dimension(two, day2).count() == 4
    moved = spark.createDataFrame([person(2, "TN", None, D1)], SNAPSHOT)  # (null, TN) and (TN, null) differ
    assert modelling.changed_customers(moved, two).count() == 1


def test_quality_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "k int")
    first = lambda df, check, **more: quality.run({"t": df, **more}, [check]).first()
    assert first(empty, quality.complete("t", "k"))["ok"] is False
    assert first(empty, quality.unique("t", "k"))["ok"] is True
    assert first(spark.createDataFrame([(None,), (None,)], "k int"), quality.unique("t", "k"))["measured"] == "2"
    some = spark.createDataFrame([(None,), (1,), (1,), (2,)], "k int")
    assert first(some, quality.valid("t", "k > 0", "positive"))["ok"] is True
    assert first(some, quality.refers("t", "k", "p", "k"), p=spark.createDataFrame([(1,), (1,), (None,)], "k int"))["measured"] == "2"
    assert first(empty, quality.refers("t", "k", "p", "k"), p=some)["ok"] is True


def test_checksum_ignores_order_and_sees_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    total = lambda df: tuple(reconcile.checksum(df).first())
    assert total(a) == total(a.orderBy(F.desc("a"))) != total(a.unionAll(a))
    assert reconcile.checksum(a.limit(0)).first()["checksum"] == "0"


def test_accounting_adds_up(spark):
    ddl = "customer_id int, first_name string, last_name string, email string, phone string, city string, state string, signup_date date, updated_at timestamp, _ingested_at timestamp, _source string, _batch_id string"
    row = lambda k, at: (k, "a", "b", None, None, None, None, None, at, D0, "s", "b")
    raw = spark.createDataFrame([row(1, D0), row(1, D1), row(None, D0), row(None, D0)], ddl)
    good, bad = cleaning.cleanse("customers", raw)
    r = cleaning.accounting(raw, "customer_id", good, bad).first()
    assert r["distinct_keys"] == r["valid_rows"] + r["quarantined_rows"] == 3


@pytest.mark.parametrize("value, label", [(499, "Budget"), (500, "Mid"), (5000, "Premium"), (None, "Premium")])
def test_band(spark, value, label):
    assert one(spark, "x int", [(value,)], C.band(F.col("x"), modelling.PRICE_BANDS, "Premium")) == [label]
