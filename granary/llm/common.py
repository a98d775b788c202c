"""What the operators share: scratch tables in the cluster's shared folder, and bounded Arrow batches.

Every operator reads only the columns it names, so extra columns (also with clashing names) are never touched;
columns that operators add for themselves start with ``g_``.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: what a Python worker holds at once, however long the texts are.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session that names none, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="granary-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The scratch paths of this driver that have not been deleted, in order.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver's JVM ends, if not before."""
    path = f"{shared_folder(spark)}/granary-{name}-{uuid.uuid4().hex}"
    target, fs = _hadoop(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    _made.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join that sorts and merges, and never sends a side to the driver to be broadcast.

    Spark judges a side by the compressed size of its files and takes no account of what explode() makes of a row, so a table
    of a few MB can become some GB in the driver.
    """
    return df.hint("merge")


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written; all other scratch that was made for it is deleted then."""
    since = len(_made)
    out = written(make(), name)
    gone, _made[since:] = _made[since:-1], _made[-1:]
    for path in gone:
        target, fs = _hadoop(spark, path)
        fs.delete(target, True)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python needs no copy of the repository."""
    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="granary-code-"), "granary.zip")
    with open(path, "wb") as f:
        f.write(out.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` over bounded batches."""
    bounded_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def with_text(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``text``, where a null text is an empty one."""
    return df.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def file_system(path: str):
    """(file system, path in it) of a folder, for tasks that write or seek in files of their own."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def put_in_place(fs, part: str, target: str) -> None:
    """Gives a whole file its name.  Where another attempt of the task has done so, its bytes are the same, and this one's go."""
    from pyarrow.fs import FileType

    try:
        fs.move(part, target)
    except OSError:
        if fs.get_file_info(target).type == FileType.NotFound:
            raise
        fs.delete_file(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
