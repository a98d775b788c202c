"""Folders for tables that one run makes and its driver's end removes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session that names none, as in tests, gets one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_roots: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there is deleted when the driver's JVM ends."""
    key = (spark.sparkContext.applicationId, shared_folder(spark))
    if key not in _roots:
        _roots[key] = f"{key[1]}/granary-{uuid.uuid4().hex}"
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_roots[key])
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        fs.deleteOnExit(root)
    return f"{_roots[key]}/{name}-{uuid.uuid4().hex}"
