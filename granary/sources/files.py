"""Files: delimited text, JSON lines with drifting schemas, allow-listed exports, and SQL scripts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Text with a header line and a declared schema; quotes are honoured."""
    return spark.read.schema(schema).csv(path, header=header)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines with nested structs and arrays; the schema is inferred if none is given."""
    return spark.read.json(path, schema=schema) if schema is not None else spark.read.json(path)


def drift(old: DataFrame, new: DataFrame) -> list[str]:
    """Columns that `new` has and `old` has not."""
    return sorted(set(new.columns) - set(old.columns))


def united(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by name; a column that a frame lacks is null in its rows."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def export(df: DataFrame, path: str, columns: list[str] | None = None, files: int | None = None) -> None:
    """CSV with a header, of allow-listed columns only; as many files as tasks unless `files` says otherwise."""
    out = df.select(*columns) if columns else df
    (out.coalesce(files) if files else out).write.mode("overwrite").csv(path, header=True)


def statements(script: str) -> Iterator[str]:
    """The statements of a script: split at `;` and without `--` and `/* */` comments, but not inside quotes."""
    out: list[str] = []
    i = 0
    while i < len(script):
        c = script[i]
        if c in "'\"`":
            j = i + 1
            while j < len(script) and script[j] != c:
                j += 2 if script[j] == "\\" and c != "`" else 1
            out.append(script[i : j + 1])
            i = j + 1
        elif script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else len(script)
        elif script.startswith("/*", i):
            end = script.find("*/", i + 2)
            i = len(script) if end < 0 else end + 2
        elif c == ";":
            if text := "".join(out).strip():
                yield text
            out, i = [], i + 1
        else:
            out.append(c)
            i += 1
    if text := "".join(out).strip():
        yield text


def run_script(spark: SparkSession, script: str, names: dict[str, str] | None = None, **values) -> DataFrame | None:
    """Runs a script's statements in order and returns the last one's result.  `${name}` is replaced by text; `:name` is a typed value."""
    for key, text in (names or {}).items():
        script = script.replace("${" + key + "}", text)
    last = None
    for statement in statements(script):
        last = spark.sql(statement, args=values or None)
    return last
