"""Ranks over groups of any size: prefix sums over ranges of values, so that tasks follow row counts and none holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.sources import sinks

#: Distinct values, about, that share a range and so a task.
RANGE_ROWS = 1_000_000


def _ranked(df: DataFrame, value: str, by: tuple[str, ...], weight: Column | None) -> DataFrame:
    """by, value, low, high (low exclusive, from 0) and n; a group's missing value is a row without ranks.

    Values are counted first (partially, before the shuffle) and the counts
    written, so that every later step sees the same ranges. They are dealt to
    as many ranges of (group, value) as RANGE_ROWS asks for; counts run within
    ranges, and the ranges' totals, one row a group and range, run over the
    group.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = sinks.kept(df.groupBy(*by, value).agg(rows.cast("long").alias("_c")))
    parts = -(-counts.count() // RANGE_ROWS)
    known = F.when(F.col(value).isNotNull(), F.col("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if parts <= 1:  # all groups together are one range
        placed = counts.withColumns({"_own": known, "_high": F.sum(known).over(group.orderBy(value)), "n": F.sum(known).over(group)})
    else:
        ranges = sinks.kept(counts.repartitionByRange(parts, *by, value).withColumn("_b", F.spark_partition_id()))
        inner = Window.partitionBy(*by, "_b").orderBy(value)
        totals = ranges.groupBy(*by, "_b").agg(F.coalesce(F.sum(known), F.lit(0)).alias("_t"))
        before = totals.withColumns({"_before": F.sum("_t").over(group.orderBy("_b")) - F.col("_t"), "n": F.sum("_t").over(group)}).drop("_t")
        run = ranges.withColumns({"_own": known, "_high": F.sum(known).over(inner)})
        met = [*(F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by), F.col("r._b") == F.col("t._b")]
        placed = run.alias("r").join(before.alias("t"), met).select("r.*", F.col("t._before"), F.col("t.n").alias("n")).withColumn("_high", F.col("_high") + F.col("_before"))
    high = F.when(F.col(value).isNotNull(), F.col("_high"))
    return placed.select(*by, value, (high - F.col("_own")).alias("low"), high.alias("high"), "n")


def value_ranks(df: DataFrame, value: str, *by: str, weight: Column | None = None) -> DataFrame:
    """Distinct values of each group with the ranks they hold: by, value, low, high (low exclusive, from 0) and n.

    ``weight`` counts a row so often. Missing values have no rank.
    """
    return _ranked(df, value, by, weight).filter(F.col(value).isNotNull())


def percentiles(df: DataFrame, value: str, at: dict[str, float], *by: str, weight: Column | None = None) -> DataFrame:
    """Exact percentiles (linear between neighbouring ranks) of each group: by, one column a name of ``at``, and n known values.

    ``weight`` counts a row so often.

    They come from the rank table, so no task or buffer holds a group's values
    and ``df`` is read once; a group without a known value has null percentiles
    and n = 0.
    """
    found = []
    for name, p in at.items():
        place = F.lit(float(p)) * (F.col("n") - 1)
        low = F.max(F.when(F.col("low") <= F.floor(place), F.col(value)))
        high = F.max(F.when(F.col("low") <= F.ceil(place), F.col(value)))
        share = F.max(place - F.floor(place))
        found.append((low + share * (high - low)).alias(name))
    return _ranked(df, value, by, weight).groupBy(*by).agg(*found, F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def with_average_ranks(df: DataFrame, names: dict[str, str], *by: str, weight: Column | None = None) -> DataFrame:
    """Add columns ``names`` with the average rank of their value column in its group, ties sharing it; missing values have none.

    ``weight`` counts a row so often.

    All ranks come from ``df`` itself, which is read once more for each name,
    and join back on group and value, plain joins whose skew adaptive execution
    splits.
    """
    out = df
    for name, value in names.items():
        ranks = value_ranks(df, value, *by, weight=weight).select(*by, value, average(F.col("low"), F.col("high")).alias(name))
        out = out.join(ranks, [*by, value], "left")
    return out


def window_ranks(df: DataFrame, names: dict[str, str], *by: str) -> DataFrame:
    """The same ranks by windows: one shuffle, but each group is sorted by one task; for groups known to be small."""
    group = lambda v: F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / 2.0
    return df.withColumns({name: F.when(F.col(v).isNotNull(), group(F.col(v)).cast("double")) for name, v in names.items()})


def average(low: Column, high: Column) -> Column:
    return (low + high + 1).cast("double") / 2.0
