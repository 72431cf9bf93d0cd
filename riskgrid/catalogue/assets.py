"""Asset cleaning over units made of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators import assets, quality
from riskgrid.plans import carriers
from riskgrid.sources.tables import read_table

from .base import query, r

carriers.SQL["units"] = """units AS (SELECT n_name AS country, p_brand AS plant_name, CASE WHEN l_orderkey % 29 <> 0 THEN l_quantity END AS capacity_mw, CASE WHEN l_partkey % 13 <> 0 THEN year(l_shipdate)::DOUBLE END AS commissioning_year,
  CASE WHEN l_partkey % 7 = 0 THEN 'geothermal' WHEN l_returnflag = 'A' THEN 'coal' WHEN l_returnflag = 'R' THEN 'wind' WHEN l_partkey % 3 = 0 THEN 'oil/gas' ELSE 'nuclear' END AS fuel_type,
  CASE WHEN l_linenumber % 7 = 0 THEN ' Retired' WHEN l_linenumber % 5 = 0 THEN 'Construction ' ELSE 'operating' END AS status,
  (l_partkey % 8) * 5.0::DOUBLE + (l_suppkey % 2) * 0.0003::DOUBLE AS lat, (l_partkey % 4) * 10.0::DOUBLE - 20.0::DOUBLE AS lon, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
carriers.SQL["built"] = """built AS (SELECT country, arg_min(plant_name, seq) AS plant_name, sum(capacity_mw) AS capacity_mw, avg(lat) AS lat, avg(lon) AS lon, min(commissioning_year) AS commissioning_year,
  list_sort(list(DISTINCT fuel_type)) AS fuels, count(*) AS units FROM units WHERE lower(trim(status)) = 'operating' GROUP BY country, lower(trim(plant_name)), round_even(lat / 0.0009::DOUBLE, 0) * 0.0009::DOUBLE, round_even(lon / 0.0009::DOUBLE, 0) * 0.0009::DOUBLE)"""
carriers.NEEDS["built"] = ("units",)
carriers.SQL["bucketed"] = """bucketed AS (SELECT *, len(fuels) > 1 AS mixed_fuel_type, list_distinct(list_transform(fuels, lambda f: CASE WHEN f = 'wind' THEN 'wind' ELSE 'thermal' END)) AS kinds,
  CASE WHEN len(fuels) > 1 THEN CASE WHEN plant_name = 'Brand#11' THEN 'thermal' WHEN len(kinds) = 1 THEN kinds[1] END WHEN fuels[1] = 'wind' THEN 'wind' ELSE 'thermal' END AS bucket FROM built)"""
carriers.NEEDS["bucketed"] = ("built",)
OVERRIDES = {"Brand#11": "thermal"}


def units(spark, folder) -> DataFrame:
    li, k = read_table(spark, folder, "lineitem"), F.col("l_partkey")
    nation = F.broadcast(read_table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country")))
    supplier = read_table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "country")
    part = read_table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("plant_name"))
    joined = li.join(part, k == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    fuel = F.when(k % 7 == 0, "geothermal").when(F.col("l_returnflag") == "A", "coal").when(F.col("l_returnflag") == "R", "wind").when(k % 3 == 0, "oil/gas").otherwise("nuclear")
    status = F.when(F.col("l_linenumber") % 7 == 0, " Retired").when(F.col("l_linenumber") % 5 == 0, "Construction ").otherwise("operating")
    return joined.select(
        "country", "plant_name", F.when(F.col("l_orderkey") % 29 != 0, F.col("l_quantity")).alias("capacity_mw"),
        F.when(k % 13 != 0, F.year("l_shipdate").cast("double")).alias("commissioning_year"), fuel.alias("fuel_type"), status.alias("status"),
        ((k % 8) * 5.0 + (F.col("l_suppkey") % 2) * 0.0003).alias("lat"), ((k % 4) * 10.0 - 20.0).alias("lon"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def plants(spark, folder) -> DataFrame:
    return assets.to_plants(assets.with_status(units(spark, folder)).filter("status_class = 'operating'"))


def boxes(spark) -> DataFrame:
    rows = [("NATION_1", -15.0, 1.0, 15.0, 32.0, True), ("NATION_2", -15.0, 1.0, 15.0, 32.0, False), ("NATION_3", -25.0, -1.0, 15.0, 20.0, True)]
    return spark.createDataFrame(rows, "country string, xmin double, ymin double, xmax double, ymax double, mainland_only boolean")


@query("p1_status_split", """SELECT CASE WHEN lower(trim(status)) = 'operating' THEN 'operating' WHEN lower(trim(status)) IN ('construction', 'pre-construction', 'announced') THEN 'planned' ELSE 'other' END AS status_class,
count(*) AS units, string_agg(DISTINCT lower(trim(status)), ',' ORDER BY lower(trim(status))) AS statuses FROM units GROUP BY 1""", "units")
def p1(spark, folder):
    return assets.status_counts(units(spark, folder))


@query("p2_scope", "SELECT country, count(*) AS units FROM units WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1", "units")
def p2(spark, folder):
    return assets.in_scope(units(spark, folder), ["NATION_1", "NATION_2", "NATION_3"]).groupBy("country").agg(F.count(F.lit(1)).alias("units"))


@query("a1_units_to_plants", """SELECT country, plant_name, capacity_mw, round(lat, 9) AS lat, round(lon, 9) AS lon, commissioning_year, array_to_string(fuels, ';') AS fuel_types_found, len(fuels) > 1 AS mixed_fuel_type, units,
CASE WHEN len(fuels) = 1 THEN fuels[1] END AS fuel_type FROM built""", "built")
def a1(spark, folder):
    return plants(spark, folder).withColumns({"lat": r("lat", 9), "lon": r("lon", 9)})


@query("p3_box_exclusion", """SELECT country, plant_name, round(lat, 9) AS lat, CASE country WHEN 'NATION_3' THEN lon BETWEEN -25 AND 15 AND lat BETWEEN -1 AND 20 ELSE lon BETWEEN -15 AND 15 AND lat BETWEEN 1 AND 32 END AS inside,
inside OR country = 'NATION_2' AS stays, units FROM built WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3')""", "built")
def p3(spark, folder):
    found = assets.boxed(plants(spark, folder).filter(F.col("country").isin("NATION_1", "NATION_2", "NATION_3")), boxes(spark))
    return found.select("country", "plant_name", r("lat", 9).alias("lat"), "inside", "stays", "units")


@query("p4_fuel_bucket", "SELECT country, plant_name, round(lat, 9) AS lat, round(lon, 9) AS lon, bucket FROM bucketed", "bucketed")
def p4(spark, folder):
    return assets.with_bucket(plants(spark, folder), OVERRIDES).select("country", "plant_name", r("lat", 9).alias("lat"), r("lon", 9).alias("lon"), "bucket")


@query("q11_unmapped", "SELECT country, plant_name, round(lat, 9) AS lat, round(lon, 9) AS lon FROM bucketed WHERE bucket IS NULL", "bucketed")
def q11(spark, folder):
    return assets.unmapped(assets.with_bucket(plants(spark, folder), OVERRIDES)).select("country", "plant_name", r("lat", 9).alias("lat"), r("lon", 9).alias("lon"))


@query("a2_bucket_distribution", "SELECT country, bucket, count(*) AS plants, round(sum(capacity_mw), 1) AS capacity_mw FROM bucketed GROUP BY 1, 2", "bucketed")
def a2(spark, folder):
    return assets.bucket_distribution(assets.with_bucket(plants(spark, folder), OVERRIDES))


@query("c1_clean_assets", """SELECT 'planned' AS part, country, count(*) AS n, round(sum(capacity_mw), 1) AS capacity_mw FROM units WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3') AND lower(trim(status)) = 'construction' GROUP BY 2
UNION ALL SELECT CASE WHEN stays THEN 'plants' ELSE 'excluded' END, country, count(*), round(sum(capacity_mw), 1) FROM (SELECT *, country = 'NATION_2' OR CASE country WHEN 'NATION_3' THEN lon BETWEEN -25 AND 15 AND lat BETWEEN -1 AND 20
ELSE lon BETWEEN -15 AND 15 AND lat BETWEEN 1 AND 32 END AS stays FROM bucketed WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3')) GROUP BY 1, 2""", "bucketed")
def c1(spark, folder):
    made = assets.clean_assets(units(spark, folder), boxes(spark), ["NATION_1", "NATION_2", "NATION_3"], OVERRIDES)
    out = None
    for part, df in made.items():
        summed = df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), r(F.sum("capacity_mw"), 1).alias("capacity_mw")).withColumn("part", F.lit(part))
        out = summed if out is None else out.unionByName(summed)
    return out


@query("c1_report", """SELECT country, (SELECT count(*) FROM units u WHERE u.country = c.country AND lower(trim(status)) = 'operating') AS units_before, count(b.country) FILTER (stays) AS plants_after, count(b.country) FILTER (stays AND coalesce(capacity_mw = 0, true)) AS missing_or_zero_capacity,
CASE WHEN country <> 'NATION_4' AND country <> 'NOWHERE' THEN count(b.country) FILTER (NOT inside) END AS outside_box, count(b.country) FILTER (NOT stays) AS excluded, count(b.country) FILTER (stays AND mixed_fuel_type) AS mixed_fuel, 0 AS n_hydro, count(b.country) FILTER (stays AND bucket = 'thermal') AS n_thermal,
count(b.country) FILTER (stays AND bucket = 'wind') AS n_wind, 0 AS n_solar, count(b.country) FILTER (stays AND bucket IS NULL) AS n_unmapped, CASE WHEN plants_after = 0 THEN 'no operating plants' END AS note FROM (SELECT unnest(['NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NOWHERE']) AS country) c
LEFT JOIN (SELECT *, coalesce(CASE country WHEN 'NATION_3' THEN lon BETWEEN -25 AND 15 AND lat BETWEEN -1 AND 20 WHEN 'NATION_4' THEN false ELSE lon BETWEEN -15 AND 15 AND lat BETWEEN 1 AND 32 END, false) AS inside, inside OR country IN ('NATION_2', 'NATION_4') AS stays FROM bucketed) b USING (country) GROUP BY country""", "bucketed")
def c1r(spark, folder):
    """Counts by reason of four countries, one of them without a box, and of one without any plant."""
    return assets.asset_report(units(spark, folder), boxes(spark), ["NATION_1", "NATION_2", "NATION_3", "NATION_4", "NOWHERE"], OVERRIDES)


@query("p5_box_union", """SELECT country, least(xmin, xmin + n) AS xmin, least(ymin, n - 2) AS ymin, greatest(xmax, n + 1.0) AS xmax, greatest(ymax, 3.0 * n) AS ymax FROM (SELECT n_name AS country, n_nationkey::DOUBLE AS n, n_nationkey % 5 - 5.0::DOUBLE AS xmin,
n_nationkey % 3 - 3.0::DOUBLE AS ymin, 10.0::DOUBLE AS xmax, 12.0::DOUBLE AS ymax FROM nation)""")
def p5(spark, folder):
    n = read_table(spark, folder, "nation").select(F.col("n_name").alias("country"), F.col("n_nationkey").cast("double").alias("n"), (F.col("n_nationkey") % 5 - 5.0).alias("xmin"), (F.col("n_nationkey") % 3 - 3.0).alias("ymin"), F.lit(10.0).alias("xmax"), F.lit(12.0).alias("ymax"))
    other = n.select("country", (F.col("xmin") + F.col("n")).alias("xmin"), (F.col("n") - 2).alias("ymin"), (F.col("n") + 1.0).alias("xmax"), (3.0 * F.col("n")).alias("ymax"))
    return assets.box_union(n.drop("n"), other)


@query("p9_valid_share", """SELECT country, round(sum(capacity_mw) FILTER (ok), 4) AS valid_mw, round(sum(capacity_mw), 4) AS total_mw, count(*) FILTER (ok) AS valid, round(sum(capacity_mw) FILTER (ok) / sum(capacity_mw), 8) AS share
FROM (SELECT *, NOT (lat = 0 AND lon = 0) AND lat BETWEEN -90 AND 90 AS ok FROM (SELECT country, capacity_mw, CASE WHEN lat < 20 THEN 0 ELSE lat END AS lat, CASE WHEN lat < 20 THEN 0 ELSE lon END AS lon FROM plants)) GROUP BY 1""", "plants")
def p9(spark, folder):
    p = carriers.plants(spark, folder)
    moved = p.withColumns({"lon": F.when(F.col("lat") < 20, 0.0).otherwise(F.col("lon")), "lat": F.when(F.col("lat") < 20, 0.0).otherwise(F.col("lat"))})
    return assets.valid_share(moved).select("country", r("valid_mw", 4).alias("valid_mw"), r("total_mw", 4).alias("total_mw"), "valid", r("share", 8).alias("share"))


@query("q1_duplicate_keys", "SELECT country, plant_name, count(*) AS count FROM built GROUP BY 1, 2 HAVING count(*) > 1", "built")
def q1(spark, folder):
    return quality.duplicate_keys(plants(spark, folder), "country", "plant_name")


@query("q2_orphans", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def q2(spark, folder):
    orders = read_table(spark, folder, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return quality.orphans(read_table(spark, folder, "customer"), orders, "c_custkey").select("c_custkey")


@query("o7_set_difference", """(SELECT DISTINCT n_name AS country, 'missing' AS side FROM nation ANTI JOIN built ON n_name = country WHERE n_nationkey < 20) UNION ALL (SELECT DISTINCT country, 'extra' FROM built
ANTI JOIN (SELECT n_name FROM nation WHERE n_nationkey < 20) ON n_name = country)""", "built")
def o7(spark, folder):
    expected = read_table(spark, folder, "nation").filter("n_nationkey < 20").select(F.col("n_name").alias("country"))
    return quality.set_difference(expected, plants(spark, folder).select("country").distinct())


@query("a40_table_profile", """SELECT name, type, (SELECT count(*) FROM supplier) AS rows, CASE name WHEN 's_acctbal' THEN (SELECT count(*) FROM supplier WHERE s_acctbal < 0) ELSE 0 END AS missing, example FROM (SELECT unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']) AS name, unnest(['bigint', 'string', 'int', 'double']) AS type,
unnest([min(s_suppkey::VARCHAR), min(s_name), min(s_nationkey::VARCHAR), min(CASE WHEN s_acctbal >= 0 THEN s_acctbal END::VARCHAR)]) AS example FROM supplier)""")
def a40(spark, folder):
    return quality.profile(read_table(spark, folder, "supplier").withColumn("s_acctbal", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))))
