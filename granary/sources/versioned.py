"""Versioned tables: Parquet folders and a log of what each version changed, on any file system that Spark writes to.

A version is a file `_log/<20 digits>.json` that says what it adds and drops, written whole under a name of its own and renamed into place,
which fails if another writer was first.  Its size does not grow with the table.  Every ``CHECKPOINT`` versions the whole state is written beside it,
so a reader reads one checkpoint and the few versions after it.  Folders are partitions of one root: a version is read by one scan for
each way in which its folders are partitioned.  Columns that came later are null in older files.  Old folders are kept, so every version can be read.
"""

from __future__ import annotations

import functools
import itertools
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG, DATA, CHECKPOINT = "_log", "data", 20
#: Names a folder of rows, and is its partition column.
FOLDER = "g_append"


class SchemaMismatch(ValueError):
    """Rows have columns, or types, that the table has not."""


class CommitConflict(RuntimeError):
    """Another writer made the next version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._log = self._of(f"{self.path}/{LOG}")
        self._fs = self._log.getFileSystem(self._conf)

    def _of(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # -- the log --

    def versions(self) -> list[int]:
        if not self._fs.exists(self._log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._log)]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def _json(self, name: str) -> dict | None:
        path = self._of(f"{self.path}/{LOG}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, body: dict) -> bool:
        """Writes a file of the log whole; false if it is there."""
        target, own = self._of(f"{self.path}/{LOG}/{name}"), self._of(f"{self.path}/{LOG}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._log)
        if self._fs.exists(target):
            return False
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        if self._fs.rename(own, target):
            return True
        self._fs.delete(own, False)
        return False

    def manifest(self, version: int | None = None) -> dict:
        """The state at a version: version, operation, timestamp, schema, folders (name, by, rows), rows, once, state."""
        have = self.versions()
        version = (have[-1] if have else -1) if version is None else version
        if version not in have:
            raise LookupError(f"{self.path} has no version {version}")
        now, after = None, version - version % CHECKPOINT
        if after:
            now = self._json(f"{after:020d}.checkpoint")
        now, after = (now, after + 1) if now else ({"folders": [], "once": {}, "state": {}}, 0)
        for v in range(after, version + 1):
            now = self._after(now, self._json(f"{v:020d}.json"))
        return now

    @staticmethod
    def _after(now: dict, step: dict) -> dict:
        gone = None if step["drop"] == "all" else set(step["drop"])
        folders = [*([] if gone is None else [f for f in now["folders"] if f["name"] not in gone]), *step["add"]]
        rows = sum(f["rows"] for f in folders)
        return {
            **{k: step[k] for k in ("version", "operation", "timestamp", "schema")}, "folders": folders, "rows": rows,
            "once": {**now["once"], **step["once"]}, "state": {**now["state"], **step["state"]}
        }

    def _commit(
        self, version: int, operation: str, schema: T.StructType, add: list[dict], drop: list[str] | str = (), once: dict | None = None,
        state: dict | None = None
    ) -> int:
        step = {
            "version": version, "operation": operation, "timestamp": time.time(), "schema": schema.jsonValue(), "add": add,
            "drop": drop if drop == "all" else list(drop), "once": once or {}, "state": state or {}
        }
        if not self._put(f"{version:020d}.json", step):
            raise CommitConflict(f"version {version} of {self.path} is there already")
        if version and version % CHECKPOINT == 0:
            self._put(f"{version:020d}.checkpoint", self.manifest(version))
        return version

    # -- reading --

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self.manifest(version)["schema"])

    def _frame(self, folders: list[dict], schema: T.StructType) -> DataFrame:
        """The rows of some folders, and the folder of each."""
        if not folders:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType())]))
        whole = T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType())])
        frames = []
        for _, own in itertools.groupby(sorted(folders, key=lambda f: f["by"]), key=lambda f: f["by"]):
            paths = [f"{self.path}/{DATA}/{FOLDER}={f['name']}" for f in own]
            frames.append(self.spark.read.option("basePath", f"{self.path}/{DATA}").schema(whole).parquet(*paths).select(*schema.names, FOLDER))
        return functools.reduce(DataFrame.unionAll, frames)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._frame(m["folders"], T.StructType.fromJson(m["schema"])).drop(FOLDER)

    def state(self) -> dict:
        """What the newest append left besides rows."""
        return self.manifest().get("state", {}) if self.exists() else {}

    def history(self) -> DataFrame:
        """version, timestamp, operation, n_rows, newest first."""
        rows = [(m["version"], m["operation"], m["rows"], m["timestamp"]) for m in map(self.manifest, reversed(self.versions()))]
        return self.spark.createDataFrame(rows, "version long, operation string, n_rows long, seconds double").select(
            "version", F.timestamp_seconds("seconds").alias("timestamp"), "operation", "n_rows"
        )

    # -- writing --

    def _write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> dict:
        """A new folder of rows: its name, how it is partitioned, and its rows, which Parquet's footers tell."""
        name = uuid.uuid4().hex
        path = f"{self.path}/{DATA}/{FOLDER}={name}"
        df.write.partitionBy(*partition_by).parquet(path)
        return {"name": name, "by": list(partition_by), "rows": self.spark.read.schema(df.schema).parquet(path).count()}

    def _next(self) -> int:
        have = self.versions()
        return have[-1] + 1 if have else 0

    @staticmethod
    def _united(old: T.StructType, new: T.StructType, merge: bool) -> T.StructType:
        known = {f.name.lower(): f for f in old}
        for f in new:
            if (k := known.get(f.name.lower())) is not None and k.dataType != f.dataType:
                raise SchemaMismatch(f"column {f.name} is {k.dataType.simpleString()} in the table and {f.dataType.simpleString()} in the rows")
        extra = [T.StructField(f.name, f.dataType, True) for f in new if f.name.lower() not in known]
        if extra and not merge:
            raise SchemaMismatch(f"the table has no column {', '.join(f.name for f in extra)}; merge_schema=True adds it")
        return T.StructType([*old.fields, *extra])

    def create(self, schema: T.StructType | str) -> int | None:
        """An empty table, if there is none."""
        if self.exists():
            return None
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return self._commit(0, "CREATE TABLE", schema, [])

    def replace(self, df: DataFrame, operation: str = "CREATE OR REPLACE TABLE AS SELECT", partition_by: tuple[str, ...] = ()) -> int:
        version = self._next()
        return self._commit(version, operation, df.schema, [self._write(df, partition_by)], "all")

    def overwrite(self, df: DataFrame) -> int:
        """All rows anew, with the rows' schema."""
        return self.replace(df, "WRITE overwrite")

    def append(
        self, df: DataFrame, merge_schema: bool = False, partition_by: tuple[str, ...] = (), once: str | None = None, state: dict | None = None
    ) -> int | None:
        """Adds rows.  Unknown columns are refused, or added with `merge_schema`.

        `once`: "query:number", which is appended once only; numbers of a query rise, so the log keeps the last.  `state` is kept with the
        version, so that what a reader goes on from is committed with the rows or not at all.
        """
        m = self.manifest() if self.exists() else {"version": -1, "once": {}}
        query, _, number = (once or "").rpartition(":")
        if once and m["once"].get(query or number, -1) >= (int(number) if query else 0):
            return None
        done = {query: int(number)} if query else {number: 0} if once else {}
        schema = self._united(T.StructType.fromJson(m["schema"]), df.schema, merge_schema) if m["version"] >= 0 else df.schema
        return self._commit(m["version"] + 1, "WRITE append", schema, [self._write(df, partition_by)], once=done, state=state)

    def merge(self, source: DataFrame, on: Column, update: dict[str, Column], insert: dict[str, Column]) -> int:
        """Rows of the table (alias t) that match a source row (alias s) are updated, source rows that match none are inserted.

        A row of the table that several source rows match is an error, as in SQL's MERGE.  Only folders with a matched row are written
        again.  The source is read once; a null key matches nothing.
        """
        m = self.manifest()
        schema, folders = T.StructType.fromJson(m["schema"]), m["folders"]
        kept = f"{self.path}/{LOG}/.source-{uuid.uuid4().hex}"
        source.write.parquet(kept)
        s = self.spark.read.schema(source.schema).parquet(kept).withColumn("_s", F.lit(True)).alias("s")
        rows = self._frame(folders, schema)
        met = rows.withColumn("_t", F.monotonically_increasing_id()).alias("t").join(s, on).groupBy(F.col(f"t.{FOLDER}").alias("folder"), "t._t").count()
        most = {r["folder"]: r["n"] for r in met.groupBy("folder").agg(F.max("count").alias("n")).collect()}  # a row a folder
        if max(most.values(), default=0) > 1:
            raise ValueError("several source rows match one row of the table")
        touched = [f for f in folders if f["name"] in most]
        both, hit = self._frame(touched, schema).alias("t").join(s, on, "left"), F.col("s._s").isNotNull()
        own = lambda c: F.col(f"t.{c}")
        updated = both.select(*((F.when(hit, update[c]).otherwise(own(c)).cast(schema[c].dataType) if c in update else own(c)).alias(c) for c in schema.names))
        fresh = s.join(rows.alias("t"), on, "left_anti").select(
            *((insert[c] if c in insert else F.lit(None)).cast(schema[c].dataType).alias(c) for c in schema.names)
        )
        by = {tuple(f["by"]) for f in touched}
        made = self._write(updated.unionByName(fresh), by.pop() if len(by) == 1 else ())
        self._fs.delete(self._of(kept), True)
        return self._commit(m["version"] + 1, "MERGE", schema, [made], [f["name"] for f in touched])

    def compact(self, small: int = 1_000_000) -> int | None:
        """Folders of fewer than `small` rows that are partitioned alike become one; None if no two are."""
        m = self.manifest()
        schema, add, drop = T.StructType.fromJson(m["schema"]), [], []
        for by, own in itertools.groupby(sorted((f for f in m["folders"] if f["rows"] < small), key=lambda f: f["by"]), key=lambda f: f["by"]):
            some = list(own)
            if len(some) > 1:
                add.append(self._write(self._frame(some, schema).drop(FOLDER), tuple(by)))
                drop += [f["name"] for f in some]
        return self._commit(m["version"] + 1, "OPTIMIZE", schema, add, drop) if add else None

    def as_of_counts(self, condition: str) -> DataFrame:
        """For each version: version, operation, n_rows, n_matching."""
        out = None
        for v in self.versions():
            m = self.manifest(v)
            one = self.read(v).agg(F.count("*").alias("n_rows"), F.count_if(F.expr(condition)).alias("n_matching")).select(
                F.lit(v).cast("long").alias("version"), F.lit(m["operation"]).alias("operation"), "n_rows", "n_matching"
            )
            out = one if out is None else out.unionAll(one)
        return out
