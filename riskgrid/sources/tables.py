"""Readers for the table folders the engine runs on."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Footers that the driver asks for at once.
AT_ONCE = 16


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a folder, read through Spark only (any file system)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_series(spark: SparkSession, path: str, variables: tuple[str, ...], first_year: int, last_year: int) -> DataFrame:
    """A series in folders ``year=<y>`` as (..., year, value) over a window of years.

    Each file gives the first of the variables that it has itself: files are
    grouped by their own schemas (one footer a file of the window, read by
    Spark), and each group is read with its own column. A file without any of
    the variables raises, as does a window without a file. Other columns are
    kept; a group that lacks one gives nulls.
    """
    years = ((f, re.search(r"/year=(-?\d+)/", f)) for f in map(unquote, spark.read.parquet(path).inputFiles()))
    listed = [f for f, year in years if year and first_year <= int(year[1]) <= last_year]
    if not listed:
        raise ValueError(f"no file between {first_year} and {last_year}")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        names = list(pool.map(lambda f: tuple(spark.read.parquet(f).columns), listed))
    groups: dict[tuple, list[str]] = {}
    for file, columns in zip(listed, names):
        known = [v for v in variables if v in columns]
        if not known:
            raise ValueError(f"no variable of {list(variables)} in {file}")
        groups.setdefault((known[0], tuple(c for c in columns if c not in variables)), []).append(file)
    parts = [spark.read.option("basePath", path).parquet(*files).select(*keys, "year", F.col(variable).cast("double").alias("value")) for (variable, keys), files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).filter(F.col("year").between(first_year, last_year))
