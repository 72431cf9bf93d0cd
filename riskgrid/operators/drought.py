"""Drought frequency from daily precipitation and temperature: water balance, log-logistic fit, standard index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X

SECONDS = 86_400.0
MIN_YEARS = 3
BETA = (1.05, 50.0)
LEAST_Z, LEAST_CDF = 1e-6, 1e-6
# Middle day of each month.
MID_MONTH = (15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344)


def monthly(daily: DataFrame, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Monthly precipitation in mm, mean temperature in degrees Celsius and days, from flux and kelvin."""
    return daily.groupBy(*cell, "year", "month").agg(
        (F.sum("pr") * SECONDS).alias("pr_mm"), (F.avg("tas") - C.KELVIN).alias("tas_c"), F.count(F.lit(1)).alias("days")
    )


def climatology(months: DataFrame, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Each cell's heat index from the mean temperature of its calendar months."""
    means = months.groupBy(*cell, "month").agg(F.avg("tas_c").alias("mean_c"))
    return means.groupBy(*cell).agg(F.sum(F.pow(X.at_least(F.col("mean_c"), 0.0) / 5.0, F.lit(1.514))).alias("heat_index"))


def balance(months: DataFrame, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Precipitation minus potential evapotranspiration by month (columns lat, pr_mm, tas_c, days)."""
    middle = F.element_at(F.array(*map(F.lit, MID_MONTH)), F.col("month").cast("int"))
    pet = X.evapotranspiration(F.col("tas_c"), F.col("heat_index"), X.day_length("lat", middle), F.col("days"))
    return months.join(climatology(months, cell), list(cell)).withColumn("pet", pet).withColumn("d", F.col("pr_mm") - F.col("pet"))


def accumulated(series: DataFrame, scale: int = 12, cell: tuple[str, ...] = ("cell",), value: str = "d") -> DataFrame:
    """Trailing sums over ``scale`` months at the ending month; a cell's first scale - 1 months drop out."""
    w = Window.partitionBy(*cell).orderBy("year", "month")
    summed = series.withColumns({"acc": F.sum(value).over(w.rowsBetween(1 - scale, 0)), "_n": F.row_number().over(w)})
    return summed.filter(F.col("_n") >= scale).drop("_n")


def fit(acc: DataFrame, cell: tuple[str, ...] = ("cell",), value: str = "acc") -> DataFrame:
    """Log-logistic parameters of each cell and calendar month from probability-weighted moments.

    Survival weights are one less the plotting position (i - 0.35) / n; groups
    below three values are left out, which ``too_short`` reports.
    """
    w = Window.partitionBy(*cell, "month")
    rank = F.row_number().over(w.orderBy(value))
    ranked = acc.withColumns({"_i": rank, "_n": F.count(F.lit(1)).over(w)}).withColumn("_s", 1.0 - (F.col("_i") - 0.35) / F.col("_n"))
    x, s = F.col(value), F.col("_s")
    moments = ranked.groupBy(*cell, "month").agg(F.avg(x).alias("w0"), F.avg(x * s).alias("w1"), F.avg(x * s * s).alias("w2"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_YEARS)
    pi = F.lit(3.141592653589793)
    beta = X.clip(F.try_divide(2.0 * F.col("w1") - F.col("w0"), 6.0 * F.col("w1") - F.col("w0") - 6.0 * F.col("w2")), *BETA)
    return (
        moments.withColumn("beta", beta).withColumn("_g", (pi / F.col("beta")) / F.sin(pi / F.col("beta")))
        .withColumn("alpha", (F.col("w0") - 2.0 * F.col("w1")) * F.col("beta") / F.col("_g")).withColumn("gamma", F.col("w0") - F.col("alpha") * F.col("_g")).drop("_g")
    )


def too_short(acc: DataFrame, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    return acc.groupBy(*cell, "month").count().filter(F.col("count") < MIN_YEARS)


def standard_index(acc: DataFrame, fitted: DataFrame, cell: tuple[str, ...] = ("cell",), value: str = "acc") -> DataFrame:
    """Standard normal index of each accumulated month."""
    joined = acc.join(fitted.select(*cell, "month", "alpha", "beta", "gamma"), [*cell, "month"])
    z = X.at_least(F.try_divide(F.col(value) - F.col("gamma"), F.col("alpha")), LEAST_Z)
    cdf = X.clip(1.0 / (1.0 + F.pow(z, -F.col("beta"))), LEAST_CDF, 1.0 - LEAST_CDF)
    return joined.withColumn("spei", X.normal_quantile(cdf))


def frequency(indexed: DataFrame, cell: tuple[str, ...] = ("cell",), at_most: float = -1.0) -> DataFrame:
    """Months a year with an index at or below a limit."""
    return indexed.groupBy(*cell).agg((12.0 * F.avg((F.col("spei") <= at_most).cast("double"))).alias("months_per_year"))


def drought_frequency(daily: DataFrame, scale: int = 12, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """From daily series (cell, lat, year, month, pr, tas) to drought months a year.

    Every step groups by cell, so one shuffle by cell and month carries it.
    """
    months = monthly(daily, (*cell, "lat"))
    acc = accumulated(balance(months, (*cell, "lat")), scale, cell)
    return frequency(standard_index(acc, fit(acc, cell), cell), cell)
