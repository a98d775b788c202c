"""The one place where session settings are made."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(
    name: str = "granary", master: str | None = None, hive: bool = False, shuffle_partitions: int | None = None, packages: tuple[str, ...] = (),
    **settings: str
) -> SparkSession:
    """A session with the engine's settings; `hive` adds a metastore, `packages` connectors such as Kafka's or a JDBC driver's."""
    b = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        b = b.config(key, value)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if packages:
        b = b.config("spark.jars.packages", ",".join(packages))
    if hive:
        b = b.enableHiveSupport()
    return b.getOrCreate()


def settings_of(environment: str | None = None, folder: str = "config") -> dict:
    """The YAML settings of an environment (GRANARY_ENV, else local); `${NAME}` is taken from the process's environment, and must be there."""
    import re

    import yaml

    environment = environment or os.environ.get("GRANARY_ENV", "local")
    with open(os.path.join(folder, f"{environment}.yaml"), encoding="utf-8") as f:
        text = f.read()
    missing = [n for n in re.findall(r"\$\{(\w+)\}", text) if n not in os.environ]
    if missing:
        raise KeyError(f"settings of {environment} need {', '.join(missing)} in the environment")
    return yaml.safe_load(re.sub(r"\$\{(\w+)\}", lambda m: os.environ[m[1]], text))


def lake(settings: dict, *parts: str) -> str:
    """A path below the lake's root, which may be local or in any store that Spark reads."""
    return "/".join([settings["lake_root"].rstrip("/"), *(p.strip("/") for p in parts)])
