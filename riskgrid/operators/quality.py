"""Data-quality operators: each returns the violations; ``require_none`` raises on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import config as C


def require_none(violations: DataFrame, message: str) -> None:
    """Raise with a few examples if there is a violation."""
    found = violations.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {', '.join(str(x.asDict()) for x in found)}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right, list(keys), "left_anti")


def many_to_one(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join that neither multiplies nor loses rows: a repeated right key raises when it is met, an orphan too."""
    named = [c for c in right.columns if c not in keys]
    single = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.max(c).alias(c) for c in named))
    checked = F.when(F.col("_n").isNull(), F.raise_error(F.lit("a left row has no partner"))).when(F.col("_n") > 1, F.raise_error(F.lit("a right key is repeated"))).otherwise(F.lit(True).cast("string"))
    return left.join(single, list(keys), "left").filter(checked.isNotNull()).drop("_n")


def set_difference(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Keys that one side has more often, with the side, as often as it has more; one shuffle of partial counts."""
    keys = expected.columns
    both = expected.withColumn("_d", F.lit(1)).unionByName(found.select(*keys).withColumn("_d", F.lit(-1))).groupBy(*keys).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    return both.withColumn("side", F.when(F.col("_d") > 0, "missing").otherwise("extra")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_d")))).drop("_d", "_k")


def drifted(now: DataFrame, frozen: DataFrame, *keys: str, tolerance: float = 1e-4) -> DataFrame:
    """Bounds (lo, hi) that differ from frozen ones by more than a tolerance, or that one side lacks."""
    then = frozen.withColumnsRenamed({"lo": "frozen_lo", "hi": "frozen_hi"})
    far = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance, F.lit(True))
    return now.join(then, list(keys), "full").filter(far("lo", "frozen_lo") | far("hi", "frozen_hi"))


def null_hazards(bands: DataFrame, *terms: str) -> DataFrame:
    """Terms without any row, or with missing bands only."""
    spark = bands.sparkSession
    counted = bands.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.count("risk_band").alias("banded"))
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    return wanted.join(counted, "term", "left").filter(F.coalesce(F.col("banded"), F.lit(0)) == 0)


def other_grid(meta: DataFrame, by: str = "country", tolerance: float = 1e-9) -> DataFrame:
    """Layers whose grid differs from their group's first one in shape, position or reference system."""
    shape = ("xmin", "ymax", "res", "width", "height", "crs")
    first = meta.groupBy(by).agg(F.min_by(F.struct(*shape), "layer").alias("ref"))
    apart = [F.abs(F.col(c) - F.col(f"ref.{c}")) > tolerance for c in ("xmin", "ymax", "res")] + [F.col(c) != F.col(f"ref.{c}") for c in ("width", "height", "crs")]
    off = apart[0]
    for x in apart[1:]:
        off = off | x
    return meta.join(first, by).filter(off).drop("ref")


def frozen_drift(bounds: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Bounds (term, bound_model, lo, hi) that have left the registry's frozen values, or that only one side has."""
    rows = [(t, m or "-", lo, hi) for (t, m), (lo, hi) in C.FROZEN_BOUNDS.items()]
    return drifted(bounds, bounds.sparkSession.createDataFrame(rows, "term string, bound_model string, lo double, hi double"), "term", "bound_model", tolerance=tolerance)


def buckets_in(df: DataFrame, column: str = "bucket") -> DataFrame:
    """The buckets of a comparison, if there is more than one."""
    return df.agg(F.array_sort(F.collect_set(column)).alias("buckets")).filter(F.size("buckets") > 1)


def required_columns(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n not in df.columns]


def usable_table(df: DataFrame, *names: str) -> DataFrame:
    """Why a table can't be used: one row for each required column that it lacks, and one where it has no row."""
    spark = df.sparkSession
    lacking = spark.createDataFrame([(f"no column {n}",) for n in required_columns(df, *names)], "problem string")
    empty = df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("no row").alias("problem"))
    return lacking.unionByName(empty)


def missing_strata(results: DataFrame, expected: DataFrame, value: str, *keys: str) -> DataFrame:
    """Expected strata without any row or with missing values only, and how many rows each has."""
    found = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("known"))
    return expected.select(*keys).distinct().join(found, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "known")}).filter("known = 0")


def registry_conflicts(rules: DataFrame, applicable: DataFrame, excluded: DataFrame, buckets: DataFrame) -> DataFrame:
    """Where registries disagree: bucket, term, problem.

    ``rules`` and ``applicable`` have bucket and term, ``excluded`` has terms that
    must not be used, ``buckets`` those that need a hazard.
    """
    sides = set_difference(applicable.select("bucket", "term").distinct(), rules.select("bucket", "term").distinct())
    named = sides.select("bucket", "term", F.when(F.col("side") == "missing", "applicable without a rule").otherwise("rule that isn't applicable").alias("problem"))
    none = buckets.select("bucket").distinct().join(applicable, "bucket", "left_anti").select("bucket", F.lit(None).cast("string").alias("term"), F.lit("bucket without a hazard").alias("problem"))
    gone = applicable.select("bucket", "term").distinct().join(excluded.select("term").distinct(), "term", "left_semi").select("bucket", "term", F.lit("excluded hazard").alias("problem"))
    return named.unionByName(none).unionByName(gone)


def colliding_ids(df: DataFrame, id: str, *fields: str) -> DataFrame:
    """Ids that stand for rows with different fields, with the number of field sets."""
    each = F.struct(*(F.col(c) for c in fields))
    return df.groupBy(id).agg(F.count_distinct(each).alias("field_sets")).filter("field_sets > 1")


def computable(plants: DataFrame) -> DataFrame:
    """Plants whose year and capacity are known."""
    return plants.filter(F.col("commissioning_year").isNotNull() & F.col("capacity_mw").isNotNull())


def guarded_sum(column: str) -> Column:
    """Sum that raises on a missing value: the rows must be filtered first."""
    return F.sum(F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is missing in a guarded sum")).cast("double")).otherwise(F.col(column)))


def first_step_share(series: DataFrame, step: str = "year") -> DataFrame:
    """Share of finite values in the first step of a series, with the step and its rows."""
    finite = F.count_if(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return series.groupBy(step).agg((finite / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("rows")).orderBy(step).limit(1)


def series_gaps(series: DataFrame, first_year: int, last_year: int, cell: tuple[str, ...] = ("cell",), steps: int = 350) -> DataFrame:
    """Cells whose series doesn't span the window or has too few steps a year."""
    need = steps * (last_year - first_year + 1)
    found = series.groupBy(*cell).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("value").alias("steps"))
    return found.filter((F.col("first_year") > first_year) | (F.col("last_year") < last_year) | (F.col("steps") < need))


def axis_mismatch(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Steps that only one of two series has."""
    return orphans(a.select(*keys), b, *keys).withColumn("side", F.lit("first")).unionByName(orphans(b.select(*keys), a, *keys).withColumn("side", F.lit("second")))


def profile(df: DataFrame) -> DataFrame:
    """One row a column: type, rows, missing values and, as an example, the smallest value as text."""
    one = F.array(*(F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.col(f"c{k}.n").alias("n"), F.col(f"c{k}.x").alias("example")) for k, (c, t) in enumerate(df.dtypes)))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.min(F.col(f"`{c}`").cast("string")).alias("x")).alias(f"c{k}") for k, c in enumerate(df.columns)))
    return row.select("rows", F.explode(one).alias("c")).select("c.name", "c.type", "rows", (F.col("rows") - F.col("c.n")).alias("missing"), "c.example")
