"""Session builder with the settings every operator relies on (UTC, ANSI, AQE)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "riskgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution on.

    ``master`` is left to spark-submit when None; extra keyword settings use
    ``__`` for the dots of a Spark property name.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    return build_session(
        "riskgrid-local",
        f"local[{cores}]",
        spark__sql__shuffle__partitions=str(shuffle_partitions),
        spark__driver__memory=memory or os.environ.get("RISKGRID_DRIVER_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
