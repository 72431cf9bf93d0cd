"""Reductions of daily and monthly series: heat days, wet days, gusts, drought frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators import drought, grid, quality
from riskgrid.plans import carriers
from riskgrid.sources import sinks
from riskgrid.sources.tables import read_table

from .base import query, r

carriers.SQL["daily"] = "daily AS (SELECT user_id % 40 AS cell, event_id % 30 + 2041 AS year, value FROM events)"
carriers.SQL["months"] = """series AS (SELECT o_custkey % 20 AS cell, (o_custkey % 20) * 2.0::DOUBLE AS lat, year(o_orderdate) AS year, month(o_orderdate) AS month, o_totalprice / 1e9::DOUBLE AS pr, 273.15::DOUBLE + (o_orderkey % 31) AS tas FROM orders),
months AS (SELECT cell, lat, year, month, sum(pr) * 86400 AS pr_mm, avg(tas) - 273.15::DOUBLE AS tas_c, count(*) AS days FROM series GROUP BY ALL)"""
carriers.SQL["acc"] = """heat AS (SELECT cell, sum(pow(greatest(m, 0) / 5, 1.514::DOUBLE)) AS hi FROM (SELECT cell, month, avg(tas_c) AS m FROM months GROUP BY ALL) GROUP BY cell),
pet AS (SELECT *, 6.75e-7::DOUBLE * pow(hi, 3) - 7.71e-5::DOUBLE * pow(hi, 2) + 1.792e-2::DOUBLE * hi + 0.49239::DOUBLE AS ex, [15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344][month] AS mid,
  24 / pi() * acos(least(greatest(-tan(radians(lat)) * tan(0.4093::DOUBLE * sin(2 * pi() / 365 * mid - 1.405::DOUBLE)), -1), 1)) AS hours,
  CASE WHEN tas_c <= 0 OR hi <= 0 THEN 0 ELSE 16 * pow(10 * tas_c / hi, ex) * (hours / 12) * (days / 30) END AS pet, pr_mm - pet AS d FROM months JOIN heat USING (cell)),
acc AS (SELECT * FROM (SELECT cell, year, month, d, sum(d) OVER w AS acc, row_number() OVER (PARTITION BY cell ORDER BY year, month) AS k FROM pet WINDOW w AS (PARTITION BY cell ORDER BY year, month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE k >= 12)"""
carriers.NEEDS["acc"] = ("months",)
carriers.SQL["fit"] = """pos AS (SELECT *, 1 - (row_number() OVER (PARTITION BY cell, month ORDER BY acc) - 0.35::DOUBLE) / count(*) OVER (PARTITION BY cell, month) AS s FROM acc),
fit AS (SELECT cell, month, avg(acc) AS w0, avg(acc * s) AS w1, avg(acc * s * s) AS w2, count(*) AS n, least(greatest((2 * w1 - w0) / (6 * w1 - w0 - 6 * w2), 1.05), 50) AS beta, (pi() / beta) / sin(pi() / beta) AS g,
  (w0 - 2 * w1) * beta / g AS alpha, w0 - alpha * g AS gamma FROM pos GROUP BY cell, month HAVING count(*) >= 3),
spei AS (SELECT cell, year, month, least(greatest(1 / (1 + pow(greatest((acc - gamma) / alpha, 1e-6), -beta)), 1e-6), 1 - 1e-6) AS f, sqrt(-2 * ln(CASE WHEN f <= 0.5 THEN f ELSE 1 - f END)) AS t,
  t - (2.515517::DOUBLE + 0.802853::DOUBLE * t + 0.010328::DOUBLE * t * t) / (1 + 1.432788::DOUBLE * t + 0.189269::DOUBLE * t * t + 0.001308::DOUBLE * t * t * t) AS z, CASE WHEN f <= 0.5 THEN -z ELSE z END AS spei FROM acc JOIN fit USING (cell, month))"""
carriers.NEEDS["fit"] = ("acc",)


def daily(spark, folder) -> DataFrame:
    return read_table(spark, folder, "events").select((F.col("user_id") % 40).alias("cell"), (F.col("event_id") % 30 + 2041).alias("year"), "value")


def series(spark, folder) -> DataFrame:
    k = F.col("o_custkey") % 20
    return read_table(spark, folder, "orders").select(
        k.alias("cell"), (k * 2.0).alias("lat"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), (F.col("o_totalprice") / 1e9).alias("pr"), (F.lit(273.15) + F.col("o_orderkey") % 31).alias("tas")
    )


def months(spark, folder) -> DataFrame:
    return drought.monthly(series(spark, folder), ("cell", "lat"))


def accumulated(spark, folder) -> DataFrame:
    return drought.accumulated(drought.balance(months(spark, folder), ("cell", "lat")))


@query("c2_heat_days", "SELECT cell, count(*) FILTER (value > 20) / 30.0::DOUBLE AS days_per_year FROM daily GROUP BY 1", "daily")
def c2(spark, folder):
    return grid.exceedance_days(daily(spark, folder), 20.0)


@query("c2_heat_days_from_files", """SELECT t // 72 AS target_row, t % 72 AS target_col, days AS value FROM range(864) g(t) LEFT JOIN (SELECT floor((30 - lat) / 10)::BIGINT AS row, floor(((lon + 180) % 360) / 10)::BIGINT AS col, count(*) FILTER (value > 20) / 30.0::DOUBLE AS days
FROM (SELECT event_id % 6 * 10.0::DOUBLE - 25 AS lat, user_id % 36 * 10.0::DOUBLE + 5 AS lon, value FROM events) GROUP BY 1, 2) ON row = t // 72 // 2 AND col = t % 72 // 2""")
def c2f(spark, folder):
    """Daily values in files by year whose variable's name changes from year to year, longitudes from 0 to 360, to a grid of half the cell size."""
    k, path = F.col("event_id"), sinks.scratch(spark)
    series = read_table(spark, folder, "events").select((k % 30 + 2041).cast("int").alias("year"), (k % 6 * 10.0 - 25.0).alias("lat"), (F.col("user_id") % 36 * 10.0 + 5.0).alias("lon"), "value")
    for odd, name in enumerate(("tasmax", "tmax")):
        series.filter(F.col("year") % 2 == odd).withColumnRenamed("value", name).repartition("year").write.mode("append").partitionBy("year").parquet(path)
    found = grid.regridded_heat_days(spark, path, (-180.0, 30.0, 10.0), (-180.0, 30.0, 5.0), (360.0, 60.0), ("tasmax", "tmax"), threshold=20.0)
    return found.select(F.col("target_row").cast("long").alias("target_row"), F.col("target_col").cast("long").alias("target_col"), "value")


@query("c4_wet_day_exceedance", """SELECT cell, round("limit", 9) AS "limit", round(days / years::DOUBLE, 9) AS days_per_year FROM (SELECT cell, any_value(l) AS "limit", count(*) FILTER (value > l) AS days, count(DISTINCT year) AS years
FROM daily JOIN (SELECT cell, quantile_cont(value, 0.95) FILTER (value >= 1) AS l FROM daily GROUP BY 1) USING (cell) GROUP BY cell)""", "daily")
def c4(spark, folder):
    return grid.wet_day_exceedance(daily(spark, folder)).select("cell", r("limit", 9).alias("limit"), r("days_per_year", 9).alias("days_per_year"))


@query("c5_mean_annual_max", "SELECT cell, round(avg(top), 9) AS mean_annual_max, count(*) AS years FROM (SELECT cell, year, max(value) AS top FROM daily GROUP BY ALL) GROUP BY 1", "daily")
def c5(spark, folder):
    return grid.mean_annual_max(daily(spark, folder)).withColumn("mean_annual_max", r("mean_annual_max", 9))


@query("a36_period_mean", "SELECT cell, round(avg(value) * 86400 - 1.5, 5) AS mean FROM daily GROUP BY 1", "daily")
def a36(spark, folder):
    return grid.period_mean(daily(spark, folder), 86_400.0, -1.5).withColumn("mean", r("mean", 5))


@query("a13_threshold_summary", "SELECT cell, round(avg((value >= 25)::INTEGER), 9) AS share, count(value) AS n, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM daily GROUP BY 1", "daily")
def a13(spark, folder):
    found = grid.threshold_summary(daily(spark, folder), 25.0, by=("cell",))
    return found.select("cell", r("share", 9).alias("share"), "n", *(r(c, 9).alias(c) for c in ("p90", "p95", "p99")))


@query("s8_longitude", "SELECT event_id, (event_id % 360 + 180) % 360 - 180.0::DOUBLE AS lon FROM events")
def s8(spark, folder):
    e = read_table(spark, folder, "events").select("event_id", (F.col("event_id") % 360).cast("double").alias("lon"))
    return grid.normalise_longitude(e)


@query("a37_series_gaps", "SELECT cell, min(year) AS first_year, max(year) AS last_year, count(value) AS steps FROM daily GROUP BY 1 HAVING count(value) < 8 * 30", "daily")
def a37(spark, folder):
    return quality.series_gaps(daily(spark, folder), 2041, 2070, steps=8)


@query("q9_axis_mismatch", """SELECT cell, year, 'first' AS side FROM (SELECT DISTINCT cell, year FROM daily WHERE value > 5) ANTI JOIN (SELECT cell, year FROM daily WHERE value > 60) b USING (cell, year)""", "daily")
def q9(spark, folder):
    d = daily(spark, folder)
    return quality.axis_mismatch(d.filter("value > 5").select("cell", "year").distinct(), d.filter("value > 60"), "cell", "year")


@query("a4_monthly", "SELECT cell, year, month, round(pr_mm, 8) AS pr_mm, round(tas_c, 8) AS tas_c, days FROM months", "months")
def a4(spark, folder):
    return months(spark, folder).select("cell", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), r("pr_mm", 8).alias("pr_mm"), r("tas_c", 8).alias("tas_c"), "days")


@query("a5_heat_index", "SELECT cell, round(hi, 6) AS heat_index FROM heat", "acc")
def a5(spark, folder):
    return drought.climatology(months(spark, folder)).withColumn("heat_index", r("heat_index", 6))


@query("f17_balance", "SELECT cell, year, month, round(pet, 6) AS pet, round(hours, 7) AS hours, round(d, 6) AS d FROM pet", "acc")
def f17(spark, folder):
    from riskgrid.functions import exprs as X

    found = drought.balance(months(spark, folder), ("cell", "lat"))
    hours = X.day_length("lat", F.element_at(F.array(*map(F.lit, drought.MID_MONTH)), F.col("month").cast("int")))
    return found.select("cell", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), r("pet", 6).alias("pet"), r(hours, 7).alias("hours"), r("d", 6).alias("d"))


@query("w1_accumulated", "SELECT cell, year, month, round(acc, 5) AS acc FROM acc", "acc")
def w1(spark, folder):
    return accumulated(spark, folder).select("cell", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), r("acc", 5).alias("acc"))


@query("a6_loglogistic_fit", "SELECT cell, month, round(beta, 4) AS beta, round(w0, 5) AS w0, n FROM fit", "fit")
def a6(spark, folder):
    return drought.fit(accumulated(spark, folder)).select("cell", F.col("month").cast("long").alias("month"), r("beta", 4).alias("beta"), r("w0", 5).alias("w0"), "n")


@query("f18_standard_index", "SELECT cell, year, month, round(spei, 4) AS spei FROM spei", "fit")
def f18(spark, folder):
    acc = accumulated(spark, folder)
    return drought.standard_index(acc, drought.fit(acc)).select("cell", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), r("spei", 4).alias("spei"))


@query("c3_drought_frequency", "SELECT cell, round(12 * avg((spei <= -1)::INTEGER), 8) AS months_per_year FROM spei GROUP BY cell", "fit")
def c3(spark, folder):
    return drought.drought_frequency(series(spark, folder)).withColumn("months_per_year", r("months_per_year", 8))
