"""Every query of the engine against its oracle at the smallest scale."""

import pytest
from oracle import database, same

from granary.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, sf, name):
    same(spark, con, sf, QUERIES[name], ORACLES[name])


def test_approximate_counts_are_near(spark, con, sf):
    got = {r["event_type"]: r["n_users"] for r in QUERIES["approx_distinct_users"](spark, sf).collect()}
    for kind, n in con.sql("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall():
        assert abs(got[kind] - n) <= 0.15 * n


def test_catalogue_names_personal_columns(spark, sf):
    rows = QUERIES["catalog_columns"](spark, sf).collect()
    assert {r["personal"] for r in rows if r["column_name"] == "email_hash"} == {"pseudonymised"}
    assert {r["owner"] for r in rows} == {"platform", "analytics"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
