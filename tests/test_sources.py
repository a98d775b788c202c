"""Versioned tables, scripts, lineage, streams."""

import pytest
from pyspark.sql import functions as F

from granary.operators import lineage
from granary.session import lake, settings_of
from granary.sources import files, jdbc
from granary.sources.versioned import CommitConflict, SchemaMismatch, VersionedTable
from granary.streaming import events as S


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    with pytest.raises(LookupError):
        t.read()
    t.create("k int, v string")
    assert t.read().count() == 0 and t.create("k int") is None
    t.append(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(SchemaMismatch):
        t.append(spark.createDataFrame([(1, 2)], "k int, w int"))
    with pytest.raises(SchemaMismatch):
        t.append(spark.createDataFrame([("1", "a")], "k string, v string"), merge_schema=True)
    t.append(spark.createDataFrame([(2, [1])], "k int, w array<int>"), merge_schema=True)
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, None, [1])]
    assert t.read(1).columns == ["k", "v"] and t.read(1).count() == 1
    t.overwrite(spark.createDataFrame([(9,)], "k int"))
    assert t.read().columns == ["k"] and [r["operation"] for r in t.history().collect()][0] == "WRITE overwrite"


def test_once_and_conflicts(spark, tmp_path):
    t, df = VersionedTable(spark, str(tmp_path / "t")), spark.range(3)
    t.append(df)
    assert t.append(df, once="q:1") is not None and t.append(df, once="q:1") is None
    assert t.read().count() == 6
    with pytest.raises(CommitConflict):
        t._commit(1, "WRITE append", df.schema, [])


def test_merge(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"))
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    t.merge(source, F.expr("t.k = s.k"), {"v": F.col("s.v")}, {"k": F.col("s.k"), "v": F.col("s.v")})
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "n"), (None, "N")], key=str)
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), F.expr("t.k = s.k"), {"v": F.col("s.v")}, {})


def test_appends_write_no_more_as_the_table_grows(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for k in range(23):
        part = spark.createDataFrame([(k, f"d{k % 2}")], "k int, day string").coalesce(1)
        t.append(part, partition_by=("day",) if k % 3 else (), once=f"q:{k}", state={"last": k})
    sizes = [(tmp_path / "t" / "_log" / f"{v:020d}.json").stat().st_size for v in (3, 22)]
    assert sizes[1] <= sizes[0] + 10
    assert t.append(part, once="q:7") is None and t.state() == {"last": 22}
    assert [sorted(r["k"] for r in t.read(v).collect()) for v in (0, 19, 20, 21, 22)] == [list(range(v + 1)) for v in (0, 19, 20, 21, 22)]
    assert t.read()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert t.compact() == 23 and len(t.manifest()["folders"]) == 2 and t.compact() is None
    assert sorted(map(tuple, t.read().collect())) == [(k, f"d{k % 2}") for k in range(23)] and t.read(22).count() == 23


def test_merge_writes_touched_folders_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for k in range(3):
        t.append(spark.createDataFrame([(10 * k + j, "a") for j in range(4)], "k int, v string"), partition_by=("v",))
    before = [f["name"] for f in t.manifest()["folders"]]
    t.merge(spark.createDataFrame([(11, "B"), (50, "N")], "k int, v string"), F.expr("t.k = s.k"), {"v": F.col("s.v")}, {"k": F.col("s.k"), "v": F.col("s.v")})
    after = [f["name"] for f in t.manifest()["folders"]]
    assert [before[0], before[2]] == after[:2] and len(after) == 3 and t.manifest()["rows"] == 13
    assert {r["k"]: r["v"] for r in t.read().filter("v <> 'a'").collect()} == {11: "B", 50: "N"}


def test_statements():
    script = "-- a; b\nSELECT ';', \"--\" /* ; */ FROM x; SELECT 'it\\'s; fine';;\n SELECT 1"
    assert list(files.statements(script)) == ["SELECT ';', \"--\"  FROM x", "SELECT 'it\\'s; fine'", "SELECT 1"]


def test_script(spark):
    r = files.run_script(spark, "CREATE OR REPLACE TEMP VIEW ${name} AS SELECT 2 AS x; SELECT x + :y AS z FROM ${name}", {"name": "v_script"}, y=3)
    assert r.first()["z"] == 5


def test_drift(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert files.drift(a, b) == ["b"] and files.united(a, b).filter("b is null").count() == 1


def test_mermaid_and_edges():
    edges = lineage.script_edges("s", "CREATE TABLE g.t AS SELECT 'FROM s.no' FROM s.a JOIN s.b")
    assert edges == [("s.a", "g.t", "s"), ("s.b", "g.t", "s")] and "s_a[s.a] --> g_t[g.t]" in lineage.mermaid(edges)


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "x.yaml").write_text("lake_root: s3a://b/${PART}\n")
    with pytest.raises(KeyError):
        settings_of("x", str(tmp_path))
    monkeypatch.setenv("PART", "p")
    assert lake(settings_of("x", str(tmp_path)), "silver", "/t/") == "s3a://b/p/silver/t"


def test_changed_condition():
    from datetime import datetime

    assert jdbc.changed("u", None, None) == "1 = 1"
    assert " AND " in jdbc.changed("u", datetime(2024, 1, 1), datetime(2024, 1, 2))


def test_embedded_database_holds_odd_rows(spark):
    data = [(1, "a,b"), (2, 'say "x"'), (3, ""), (4, None), (5, " two\nlines "), (6, "é 日本"), (None, "n")]
    source = jdbc.embedded(spark.createDataFrame(data, "k long, v string"), "odd")
    assert source.url.startswith("jdbc:derby:jar:(")
    assert sorted(map(tuple, jdbc.full(spark, source, "odd").collect()), key=str) == sorted(data, key=str)


def test_partitioned_read_takes_any_key(spark, tmp_path):
    from granary.plans.catalogue import QUERIES

    keys = [1, 2, None, -3, 80_000_000, 10**12, 2**63 - 1, -(2**63)]
    for k, data in enumerate(([(x, f"s{x}") for x in keys], [(2**63 - 1, "last")], [(None, "a"), (None, None)], [])):
        spark.createDataFrame(data, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/{k}/supplier.parquet")
        assert sorted(map(tuple, QUERIES["jdbc_partitioned_read"](spark, f"{tmp_path}/{k}").collect()), key=str) == sorted(data, key=str)


def test_pages_of_the_embedded_database_are_reached_without_those_before(spark):
    import zipfile

    source = jdbc.embedded(spark.range(10), "pages")
    with zipfile.ZipFile(source.url.split("(")[1].split(")")[0]) as z:
        assert {x.compress_type for x in z.infolist()} == {zipfile.ZIP_STORED}


def test_executors_of_their_own_read_the_embedded_database(sf, tmp_path):
    import os
    import subprocess
    import sys

    code = f"""
from granary.plans.catalogue import QUERIES
from granary.session import session
s = session("t", master="local-cluster[2,1,1024]", shuffle_partitions=2, **{{"spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.executor.memory": "600m"}})
print("ROWS", *(QUERIES[n](s, "{sf}").count() for n in ("jdbc_partitioned_read", "jdbc_incremental")), s.read.parquet("{sf}/supplier.parquet").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "TZ": "UTC"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    rows = next((x.split()[1:] for x in done.stdout.splitlines() if x.startswith("ROWS")), None)
    assert rows and len(set(rows)) == 1, done.stderr[-1500:]


def test_malformed_events_have_null_fields(spark):
    made = S.made_events(spark, 200)
    bad = spark.createDataFrame([(0, 1, "{oops"), (0, 2, None)], "partition int, offset long, value string")
    e = S.parsed(made.unionByName(bad.select(F.col("partition"), "offset", "value")))
    assert e.filter("event_id is null").count() == 2 and e.filter("event_type = 'order_placed' and amount is null").count() == 0
    assert e.filter("event_type <> 'order_placed' and amount is not null").count() == 0


def test_late_events_are_dropped(spark, tmp_path):
    """A file two batches behind the watermark no longer counts."""
    from granary.plans.catalogue import _envelopes
    from granary.plans.star import Star

    topic = _envelopes(Star(spark, "/root/testdata/sf0.001"))
    late = spark.read.json(topic).orderBy("offset").limit(50).coalesce(1)
    table = VersionedTable(spark, str(tmp_path / "w"))
    run = lambda: S.to_table(S.windows(S.parsed(S.replay(spark, topic))), table, str(tmp_path / "c"), "w").awaitTermination()
    run()
    before = table.read().agg(F.sum("n_events")).first()[0]
    late.write.mode("append").json(topic)
    run()
    assert table.read().agg(F.sum("n_events")).first()[0] == before


def test_topic_rows_are_keyed(spark):
    """What goes to a topic: the customer as key, the event as value, and options that wait for all replicas.  The connector is not installed."""
    rows = S.keyed(S.made_events(spark, 50)).collect()
    import json

    assert all(json.loads(r["value"])["customer_id"] == int(r["key"]) for r in rows) and len(rows) == 50
    assert S.producer_options("b:1", "t") == {"kafka.bootstrap.servers": "b:1", "topic": "t", "kafka.acks": "all"}
    assert S.consumer_options("b:1", "t") == {"kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "earliest"}
    with pytest.raises(Exception, match="(?i)kafka"):
        S.kafka(spark, "b:1", "t")


def test_reports():
    rows = [{"dimension": "validity", "table_name": "t", "check_name": "a < b", "measured": "1", "expected": "0", "ok": False}]
    from granary.operators import reports

    assert "| validity | t | a < b | 1 | 0 | FAIL |" in reports.markdown("Checks", rows)
    page = reports.html("Checks", rows)
    assert "<td>a &lt; b</td>" in page and "0 of 1 passed" in page
    chart = reports.bars("Revenue", [("1998-01", 2.0), ("<x>", None), ("1998-03", 4.0)])
    assert chart.count("<rect") == 2 and "&lt;x&gt;" in chart
    grid = reports.grid("Retention", ["q0", "q1"], [("1998-01", [100.0, None])])
    assert grid.count("<rect") == 1 and "100" in grid


@pytest.mark.parametrize("environment", ["local", "aws", "azure", "gcp"])
def test_environments(environment, monkeypatch):
    import os

    for name in ("SOURCE_PASSWORD", "LAKE_BUCKET", "SOURCE_HOST", "BROKERS", "LAKE_ACCOUNT"):
        monkeypatch.setenv(name, "x")
    settings = settings_of(environment, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "config"))
    assert {"lake_root", "jdbc", "kafka"} <= set(settings) and lake(settings, "gold").endswith("/gold")


def test_dashboard(spark, tmp_path):
    from granary.plans import analytics
    from granary.plans.star import Star

    s = Star(spark, "/root/testdata/sf0.001")
    analytics.dashboard(s.view, s.customer_dimension, str(tmp_path / "sales.html"))
    page = (tmp_path / "sales.html").read_text()
    assert page.count("<svg") == 4 and page.count("<rect") > 100 and "1995-01" in page
