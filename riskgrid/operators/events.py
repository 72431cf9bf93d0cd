"""Disaster records and storm tracks: reading, coverage, matching, validation of plants and zones."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.plans import ranks
from riskgrid.sources import sinks

from . import spatial

CORROBORATED, NO_RECORD, NOT_APPLICABLE = "Corroborated", "No Record", "Not Applicable"


def of_types(events: DataFrame, countries: list[str], types: list[str]) -> DataFrame:
    return events.filter(F.col("country").isin(*countries) & F.col("disaster_type").isin(*types))


def read_tracks(raw: DataFrame) -> DataFrame:
    """Track points from text columns: the units row and rows without coordinates drop out; wind is the larger of two sources."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    out = raw.select("sid", F.expr("try_cast(season as int)").alias("season"), number("lat").alias("lat"), number("lon").alias("lon"), F.greatest(number("wmo_wind"), number("usa_wind")).alias("wind_kt"), "name", "iso_time")
    return out.filter("season is not null and lat is not null and lon is not null")


def coverage(events: DataFrame) -> DataFrame:
    """Per country: events, and how many and what share have a location, admin units, coordinates."""
    n = F.count(F.lit(1))
    has = {"location": F.col("location").isNotNull(), "admin": F.col("admin_units").isNotNull(), "coords": F.col("lat").isNotNull() & F.col("lon").isNotNull()}
    counts = [F.count_if(c).alias(f"with_{k}") for k, c in has.items()]
    shares = [F.round(100.0 * F.count_if(c) / n, 1).alias(f"pct_{k}") for k, c in has.items()]
    return events.groupBy("country").agg(n.alias("events"), *counts, *shares)


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("country", "disaster_type", "start_year").count().orderBy("country", "disaster_type", "start_year")


def severity(events: DataFrame) -> DataFrame:
    """Per country: events with each sign of severity, with any, by deepest admin level, and with an unreadable cell."""
    signs = {"deaths": F.col("deaths") >= 10, "affected": F.col("affected") >= 100, "declaration": F.col("declaration") == "Yes", "appeal": F.col("appeal") == "Yes"}
    true = {k: F.coalesce(v, F.lit(False)) for k, v in signs.items()}
    any_ = F.lit(False)
    for v in true.values():
        any_ = any_ | v
    entries = F.from_json("admin_units", "array<string>")
    keys = F.flatten(F.transform(entries, lambda e: F.coalesce(F.json_object_keys(F.when(e.startswith("{"), e)), F.array().cast("array<string>"))))
    level = lambda k: F.coalesce(F.array_contains(keys, f"gid_{k}"), F.lit(False))
    return events.groupBy("country").agg(
        *(F.count_if(v).alias(f"n_{k}") for k, v in true.items()), F.count_if(any_).alias("n_any"), *(F.count_if(level(k)).alias(f"n_gid_{k}") for k in (0, 1, 2)),
        F.count_if(F.col("admin_units").isNotNull() & entries.isNull()).alias("n_unreadable"),
    )


def multipliers(events: DataFrame, weight: float = C.EVENT_WEIGHT, years: int = C.EVENT_YEARS) -> DataFrame:
    """Events a year by country and 1 + weight x rate over the largest rate; the table has one row a country."""
    rate = events.groupBy("country").agg(F.count(F.lit(1)).alias("events")).withColumn("rate", F.col("events") / F.lit(float(years)))
    most = rate.agg(F.max("rate").alias("most"))
    return rate.crossJoin(F.broadcast(most)).withColumn("multiplier", 1.0 + weight * F.col("rate") / F.col("most")).drop("most")


def weighted_by_country(rows: DataFrame, found: DataFrame, value: str, out: str = "weighted") -> DataFrame:
    """``rows`` (country and others) with ``value`` times its country's event multiplier (country, multiplier: :func:`multipliers`); 1 where a country has none."""
    named = F.broadcast(found.select("country", F.col("multiplier").alias("_m")))
    return rows.join(named, "country", "left").withColumn(out, F.col(value) * F.coalesce("_m", F.lit(1.0))).drop("_m")


def exploded(events: DataFrame, terms: dict[str, str] = C.EVENT_TERMS) -> DataFrame:
    """One row for each event, mapped term and first-level admin code; the rest drop out."""
    spark = events.sparkSession
    mapped = events.join(F.broadcast(spark.createDataFrame(list(terms.items()), "disaster_type string, term string")), "disaster_type")
    return mapped.select("event_id", "country", "term", "start_year", F.explode(X.admin_codes("admin_units")).alias("gid"))


def applicable_rows(plants: DataFrame) -> DataFrame:
    rows = plants.sparkSession.createDataFrame(C.applicability(), "bucket string, term string, pos int, size int")
    return plants.join(F.broadcast(rows.select("bucket", "term")), "bucket")


def broad_impact(plants: DataFrame, found: DataFrame, first_year: int = C.FIRST_YEAR, terms: dict[str, str] = C.EVENT_TERMS) -> DataFrame:
    """State of each plant (with gid) and applicable term from geocoded events of its admin area."""
    n = found.filter(F.col("start_year") >= first_year).groupBy("term", "gid").agg(F.count(F.lit(1)).alias("_n"))
    rows = applicable_rows(plants).join(n, ["term", "gid"], "left")
    off = ~F.col("term").isin(*terms.values()) | F.col("gid").isNull()
    events = F.when(off, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    state = F.when(off, NOT_APPLICABLE).when(F.col("_n") > 0, CORROBORATED).otherwise(NO_RECORD)
    return rows.select("plant_uid", "country", "bucket", F.lit("broad_impact").alias("validator_class"), "term", state.alias("state"), events.alias("n_events"), "gid")


def physical_occurrence(plants: DataFrame, tracks: DataFrame, km: float = C.RADIUS_KM, first_year: int = C.FIRST_YEAR, knots: float = C.GALE_KT) -> DataFrame:
    """State of each plant and applicable term from storm track points near it; only wind is covered."""
    strong = tracks.filter((F.col("season") >= first_year) & (F.col("wind_kt") >= knots))
    near = spatial.within_radius(plants.withColumnRenamed("plant_uid", "point_id"), strong, km).withColumnRenamed("point_id", "plant_uid")
    windy = F.col("term") == "wind"
    state = F.when(~windy, NOT_APPLICABLE).when(F.col("n_near") > 0, CORROBORATED).otherwise(NO_RECORD)
    return applicable_rows(near).select("plant_uid", "country", "bucket", F.lit("physical_occurrence").alias("validator_class"), "term", state.alias("state"), F.when(windy, F.col("n_near")).otherwise(0).cast("long").alias("n_events"), F.lit(None).cast("string").alias("gid"))


def contextual_validation(plants: DataFrame, admin: DataFrame, events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Both validators stacked; ``admin`` has poly_id, seq, gid and rings."""
    located = spatial.first_polygon(plants.select(F.col("plant_uid").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y")), admin).select(F.col("point_id").alias("plant_uid"), "gid")
    return broad_impact(plants.join(located, "plant_uid"), exploded(events)).unionByName(physical_occurrence(plants, tracks))


#: Sizes of the smaller and the larger group up to which the U distribution without ties is counted out.
EXACT_SMALLER, EXACT_LARGER = 8, 100


@functools.cache
def exact_tails(m: int, n: int) -> list[float]:
    """P(U >= u) for u = 0 .. m * n, all orders of m and n distinct values being as likely.

    The number of orders with a U obeys N(m, n, u) = N(m - 1, n, u - n) +
    N(m, n - 1, u): the largest value is one of the m, above all n, or not.
    """
    row = [[1] for _ in range(n + 1)]  # N(0, k, .)
    for i in range(1, m + 1):
        above, row = row, [[1]]
        for k in range(1, n + 1):
            counts = [0] * (i * k + 1)
            for u, c in enumerate(above[k]):
                counts[u + k] += c
            for u, c in enumerate(row[k - 1]):
                counts[u] += c
            row.append(counts)
    total = math.comb(m + n, m)
    return [x / total for x in itertools.accumulate(row[n][::-1])][::-1]


def rank_sum_test(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Two-sided Mann-Whitney U of flagged against other values: sizes, medians, U, tie-corrected z, p and the method of p.

    p is exact (counted) where no values tie and the groups have at most
    EXACT_SMALLER and EXACT_LARGER values, else asymptotic with a continuity
    correction. Groups below three get a reason instead. Rows are counted by
    value before ranks are taken, so ties of any number cost one row.
    """
    spark, flag = values.sparkSession, F.coalesce("flag", F.lit(False))
    known = values.filter("value is not null")
    counts = sinks.kept(known.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"), F.count_if(flag).alias("f")))
    ranked = ranks.value_ranks(counts, "value", *by, weight=F.col("c"))
    t = (F.col("high") - F.col("low")).cast("double")
    met = counts.join(ranked.select(*by, "value", "low", "high"), [*by, "value"])
    stats = met.groupBy(*by).agg(
        F.sum("f").alias("n1"), F.sum(F.col("c") - F.col("f")).alias("n2"), F.sum(F.col("f") * ranks.average(F.col("low"), F.col("high"))).alias("r1"), F.sum(t * t * t - t).alias("ties"),
    )
    halves = ranks.percentiles(known.withColumn("flag", flag), "value", {"m": 0.5}, *by, "flag").groupBy(*by).agg(F.max(F.when(F.col("flag"), F.col("m"))).alias("median1"), F.max(F.when(~F.col("flag"), F.col("m"))).alias("median2"))
    joined = sinks.kept(stats.join(halves, list(by)) if by else stats.crossJoin(halves))
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    counted = (F.col("ties") == 0) & small.between(3, EXACT_SMALLER) & (large <= EXACT_LARGER)
    sizes = joined.filter(counted).select(small.alias("m"), large.alias("n")).distinct().collect()  # of a bounded number of sizes
    tails = spark.createDataFrame([(m, n, exact_tails(m, n)) for m, n in sizes], "_m long, _n long, _tails array<double>")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    enough = (F.col("n1") >= 3) & (F.col("n2") >= 3)
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    found = joined.join(F.broadcast(tails), (small == F.col("_m")) & (large == F.col("_n")) & (F.col("ties") == 0), "left")
    out = found.withColumn("u", F.when(enough, u)).withColumn("z", F.when(enough, F.try_divide(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, sd)))
    most = F.greatest(F.col("u"), n1 * n2 - F.col("u")).cast("int")
    exact = 2.0 * F.try_element_at("_tails", most + 1)
    p = X.clip(F.coalesce(exact, 2.0 * (1.0 - X.normal_cdf(F.col("z")))), 0.0, 1.0)
    method = F.when(enough, F.when(F.col("_tails").isNotNull(), "exact").otherwise("asymptotic"))
    return out.withColumns({"p": F.when(enough, p), "method": method, "reason": F.when(~enough, "group below 3")}).drop("r1", "ties", "_m", "_n", "_tails")


def spatial_event_test(polygons: DataFrame, cells: DataFrame, grid: tuple[float, float, float], found: DataFrame, term: str) -> DataFrame:
    """Rank-sum test of a layer's zonal means in polygons with an event of a term against those without."""
    means = spatial.zonal_mean(cells, grid, polygons).join(polygons.select("poly_id", "gid"), "poly_id")
    hit = found.filter(F.col("term") == term).select("gid").distinct().withColumn("hit", F.lit(True))
    return rank_sum_test(means.join(hit, "gid", "left").select(F.col("mean").alias("value"), F.coalesce("hit", F.lit(False)).alias("flag")))


def zonal_event_tests(polygons: DataFrame, cells: DataFrame, grid: tuple[float, float, float], events: DataFrame, terms: dict[str, str] = C.ZONAL_TERMS) -> dict[str, DataFrame]:
    """Rank-sum tests of each country and disaster type, and the polygons they compare.

    ``polygons`` has poly_id, gid, country and rings, ``cells`` one layer a term
    (term, row, col, value). ``polygons`` of the result: country, term, gid,
    mean, has_event; ``summary``: country, term, polygons with and without an
    event, and the columns of :func:`rank_sum_test`. A type without a layer
    (storms) has no test.
    """
    names = F.broadcast(cells.sparkSession.createDataFrame(sorted({*terms.values()}), "string").toDF("term"))
    means = spatial.zonal_mean(cells.join(names, "term", "left_semi"), grid, polygons, ("term",), names)
    hit = exploded(events, terms).select("term", "gid").distinct().withColumn("hit", F.lit(True))
    each = polygons.select("poly_id", "gid", "country").join(means, "poly_id").join(hit, ["term", "gid"], "left")
    compared = sinks.kept(each.select("country", "term", "gid", "mean", F.coalesce("hit", F.lit(False)).alias("has_event")))
    sizes = compared.groupBy("country", "term").agg(F.count_if("has_event").alias("polygons_with"), F.count_if(~F.col("has_event")).alias("polygons_without"))
    tests = rank_sum_test(compared.select("country", "term", F.col("mean").alias("value"), F.col("has_event").alias("flag")), ("country", "term"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n1", "n2")}
    return {"polygons": compared, "summary": sizes.join(tests, ["country", "term"], "left").withColumns(zero | {"reason": F.when(F.col("u").isNull(), "group below 3")})}


def track_summary(tracks: DataFrame, countries: DataFrame) -> DataFrame:
    """Track points and distinct storms (sid) of each country's basin; 0 where it has none.

    ``countries`` has country and basin, one row a country; a basin serves
    several countries. Points are counted by storm before the join, so it moves
    one row a storm and basin.
    """
    storms = tracks.filter("lat is not null and lon is not null").groupBy("basin", "sid").agg(F.count(F.lit(1)).alias("_n"))
    joined = countries.select("country", "basin").join(storms, "basin", "left")
    return joined.groupBy("country").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("points"), F.count("sid").alias("storms"))
