"""Spatial joins, events, tracks and validators over polygons made of nations and events made of orders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators import events, spatial
from riskgrid.plans import carriers
from riskgrid.sources.tables import read_table

from .base import query, r

carriers.SQL["polys"] = """polys AS (SELECT n_nationkey AS poly_id, n_nationkey AS seq, 'N' || n_nationkey // 5 || '.' || n_nationkey || '_1' AS gid, n_nationkey % 7 + 0.5::DOUBLE AS value, n_nationkey % 5 * 10.0::DOUBLE AS x0, n_nationkey // 5 * 8.0::DOUBLE AS y0 FROM nation),
pts AS (SELECT poly_id, 1 AS ring, [x0, x0 + 11, x0 + 10, x0 - 1] AS xs, [y0, y0 + 1, y0 + 9, y0 + 8] AS ys FROM polys UNION ALL SELECT poly_id, 2, [x0 + 2, x0 + 5, x0 + 4], [y0 + 2, y0 + 3, y0 + 6] FROM polys WHERE poly_id % 6 = 0),
edge AS (SELECT poly_id, ring, xs[i] AS x1, ys[i] AS y1, xs[i % len(xs) + 1] AS x2, ys[i % len(ys) + 1] AS y2 FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM pts))"""
carriers.SQL["located"] = """located AS (SELECT plant_uid, arg_min(gid, seq) AS gid FROM (SELECT plant_uid, poly_id FROM plants CROSS JOIN edge WHERE least(y1, y2) <= lat AND lat < greatest(y1, y2) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
  GROUP BY ALL HAVING count(*) % 2 = 1) JOIN polys USING (poly_id) GROUP BY 1)"""
carriers.NEEDS["located"] = ("polys", "plants")
carriers.SQL["disasters"] = """disasters AS (SELECT o_orderkey AS event_id, 'N' || (o_orderkey % 25) // 5 AS country, ['Flood', 'Storm', 'Drought', 'Extreme temperature', 'Earthquake'][o_orderkey % 5 + 1] AS disaster_type, (1990 + o_orderkey % 35)::INTEGER AS start_year,
  o_orderkey % 6 AS form, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS location, CASE WHEN o_orderkey % 3 <> 0 THEN 1.5::DOUBLE END AS lat, CASE WHEN o_orderkey % 2 <> 0 THEN 2.5::DOUBLE END AS lon,
  o_orderkey % 40 AS deaths, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 300 END AS affected, CASE WHEN o_orderkey % 9 = 0 THEN 'Yes' END AS declaration, CASE WHEN o_orderkey % 11 = 0 THEN 'Yes' ELSE 'No' END AS appeal FROM orders),
hits AS (SELECT event_id, country, CASE disaster_type WHEN 'Flood' THEN 'precip' WHEN 'Storm' THEN 'wind' WHEN 'Drought' THEN 'spei' WHEN 'Extreme temperature' THEN 'heat' END AS term, start_year,
  unnest(CASE form WHEN 1 THEN ['N' || (event_id % 25) // 5 || '.' || event_id % 25 || '_1'] WHEN 2 THEN ['N' || (event_id % 25) // 5 || '.' || event_id % 25 || '_1']
    WHEN 5 THEN list_distinct(['N' || (event_id % 25) // 5 || '.' || event_id % 25 || '_1', 'N' || (event_id % 25) // 5 || '.' || event_id % 7 || '_1']) END) AS gid FROM disasters WHERE disaster_type <> 'Earthquake')"""
carriers.SQL["placed"] = """placed AS (SELECT d.* REPLACE (n_name AS country), r_name AS region FROM disasters d JOIN orders ON o_orderkey = event_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
carriers.NEEDS["placed"] = ("disasters",)
carriers.SQL["tracks"] = "tracks AS (SELECT event_id, (1990 + event_id % 35)::INTEGER AS season, event_id % 4000 / 100.0::DOUBLE AS lat, event_id * 7 % 5000 / 100.0::DOUBLE AS lon, value AS wind_kt FROM events)"
carriers.SQL["near"] = """near AS (SELECT plant_uid, count(t.event_id) AS n_near FROM plants p LEFT JOIN (SELECT * FROM tracks WHERE season >= 2000 AND wind_kt >= 34) t ON abs(t.lat - p.lat) < 1 AND 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(t.lat - p.lat) / 2), 2)
  + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))) <= 100 GROUP BY 1)"""
carriers.NEEDS["near"] = ("plants", "tracks")


def polygons(spark, folder) -> DataFrame:
    n, k = read_table(spark, folder, "nation"), F.col("n_nationkey")
    x0, y0 = (k % 5) * 10.0, F.floor(k / 5) * 8.0
    ring = lambda *ps: F.array(*(F.struct((x0 + float(a)).alias("x"), (y0 + float(b)).alias("y")) for a, b in ps))
    outer, inner = ring((0, 0), (11, 1), (10, 9), (-1, 8)), ring((2, 2), (5, 3), (4, 6))
    gid = F.concat(F.lit("N"), F.floor(k / 5).cast("string"), F.lit("."), k.cast("string"), F.lit("_1"))
    return n.select(k.alias("poly_id"), k.alias("seq"), gid.alias("gid"), (k % 7 + 0.5).alias("value"), F.when(k % 6 == 0, F.array(outer, inner)).otherwise(F.array(outer)).alias("rings"))


def disasters(spark, folder) -> DataFrame:
    o, k = read_table(spark, folder, "orders"), F.col("o_orderkey")
    m, top = (k % 25).cast("string"), F.floor(k % 25 / 5).cast("string")
    code = lambda level, a, tail="_1": F.concat(F.lit(f'{{"gid_{level}": "N'), top, F.lit("."), a, F.lit(f'{tail}"}}'))
    cell = (
        F.when(k % 6 == 1, F.concat(F.lit("["), code(1, m), F.lit("]"))).when(k % 6 == 2, F.concat(F.lit("[1, "), code(2, m, ".3_1"), F.lit("]")))
        .when(k % 6 == 3, F.lit("not json")).when(k % 6 == 4, F.concat(F.lit('[{"gid_0": "N'), top, F.lit('"}]')))
        .when(k % 6 == 5, F.concat(F.lit("["), code(1, m), F.lit(", "), code(2, (k % 7).cast("string"), ".9_1"), F.lit("]")))
    )
    kinds = F.array(*map(F.lit, ("Flood", "Storm", "Drought", "Extreme temperature", "Earthquake")))
    return o.select(
        k.alias("event_id"), F.concat(F.lit("N"), top).alias("country"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("disaster_type"), (1990 + k % 35).cast("int").alias("start_year"), cell.alias("admin_units"),
        F.when(k % 4 != 0, F.col("o_orderpriority")).alias("location"), F.when(k % 3 != 0, 1.5).alias("lat"), F.when(k % 2 != 0, 2.5).alias("lon"), (k % 40).alias("deaths"), F.when(k % 8 != 0, k % 300).alias("affected"),
        F.when(k % 9 == 0, "Yes").alias("declaration"), F.when(k % 11 == 0, "Yes").otherwise("No").alias("appeal"),
    )


def tracks(spark, folder) -> DataFrame:
    k = F.col("event_id")
    return read_table(spark, folder, "events").select(k, (1990 + k % 35).cast("int").alias("season"), (k % 4000 / 100.0).alias("lat"), (k * 7 % 5000 / 100.0).alias("lon"), F.col("value").alias("wind_kt"))


def points(spark, folder) -> DataFrame:
    return carriers.plants(spark, folder).select(F.col("plant_uid").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))


@query("j4_point_in_polygon", "SELECT plant_uid, gid FROM plants LEFT JOIN located USING (plant_uid)", "located")
def j4(spark, folder):
    return spatial.first_polygon(points(spark, folder), polygons(spark, folder)).select(F.col("point_id").alias("plant_uid"), "gid")


#: Grids of the rasterised layers: the plants' extent in about as many cells as there are parts, and the same in SQL.
carriers.SQL["fine"] = "fine AS (SELECT ceil(sqrt(count(*) / 2000.0::DOUBLE))::BIGINT AS f, 1.0::DOUBLE / f AS res FROM part), centre AS (SELECT id // (50 * f) AS row, id % (50 * f) AS col, 0.0 + (col + 0.5) * res AS cx, 40.0 - (row + 0.5) * res AS cy FROM fine CROSS JOIN range(2000 * f * f) t(id))"
BURNT = """SELECT c.row, c.col, poly_id FROM centre c JOIN edge ON least(y1, y2) <= cy AND cy < greatest(y1, y2) AND cx < x1 + (cy - y1) * (x2 - x1) / (y2 - y1) GROUP BY c.row, c.col, poly_id HAVING count(*) % 2 = 1"""


def fine_grid(spark, folder) -> tuple[tuple[float, float, float], int, int]:
    """Grid, width and height of about as many cells as there are parts."""
    f = math.ceil(math.sqrt(read_table(spark, folder, "part").count() / 2000.0))
    return (0.0, 40.0, 1.0 / f), 50 * f, 40 * f


CENTRES = """SELECT c.id, {pick} AS v FROM range(2000) c(id) JOIN edge ON least(y1, y2) <= 40 - (c.id // 50 + 0.5) AND 40 - (c.id // 50 + 0.5) < greatest(y1, y2)
AND c.id % 50 + 0.5 < x1 + (40 - (c.id // 50 + 0.5) - y1) * (x2 - x1) / (y2 - y1) GROUP BY c.id, poly_id HAVING count(*) % 2 = 1"""


@query("j5_rasterise", f"""SELECT row, col, value FROM centre LEFT JOIN (SELECT row, col, arg_max(value, seq) AS value FROM ({BURNT}) JOIN polys USING (poly_id) GROUP BY 1, 2) USING (row, col)""", "polys", "fine")
def j5(spark, folder):
    found = spatial.rasterise(*fine_grid(spark, folder), polygons(spark, folder))
    return found.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")


carriers.SQL["zones"] = f"""zones AS (SELECT poly_id, gid, avg(value) AS mean, count(value) AS cells FROM polys LEFT JOIN (SELECT v AS poly_id, CASE WHEN (p_partkey + 31) % 31 <> 0 THEN ((p_partkey * 31 + p_size * 7 + 11) % 89) / 4.0::DOUBLE END AS value
  FROM ({CENTRES.format(pick="poly_id")}) JOIN part ON p_partkey = id WHERE (p_partkey + 31) % 31 <> 0) z USING (poly_id) GROUP BY 1, 2)""".replace("polys LEFT JOIN", "(SELECT poly_id, gid FROM polys) LEFT JOIN")
carriers.NEEDS["zones"] = ("polys",)


def precip_cells(spark, folder) -> DataFrame:
    return carriers.cells(spark, folder).filter("term = 'precip' and scenario = 'bau' and model = 'gfdl_esm4'").select("row", "col", "value")


@query("j6_zonal_mean", "SELECT poly_id, round(mean, 9) AS mean, CASE WHEN cells > 0 THEN cells END AS cells FROM zones", "zones")
def j6(spark, folder):
    return spatial.zonal_mean(precip_cells(spark, folder), carriers.GRID, polygons(spark, folder)).select("poly_id", r("mean", 9).alias("mean"), "cells")


@query("j7_radius_join", "SELECT plant_uid, n_near FROM near", "near")
def j7(spark, folder):
    strong = tracks(spark, folder).filter("season >= 2000 and wind_kt >= 34")
    p = carriers.plants(spark, folder).select(F.col("plant_uid").alias("point_id"), "lat", "lon")
    return spatial.within_radius(p, strong).select(F.col("point_id").alias("plant_uid"), "n_near")


@query("j14_largest_part", """SELECT poly_id, ring - 1 AS part, round(area, 9) AS area FROM (SELECT *, row_number() OVER (PARTITION BY poly_id ORDER BY area DESC) AS k FROM (SELECT poly_id, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edge GROUP BY poly_id, ring)) WHERE k = 1""", "polys")
def j14(spark, folder):
    found = spatial.largest_part(polygons(spark, folder))
    return found.select("poly_id", F.when(F.size(F.col("rings")[0]) == 4, 0).otherwise(1).alias("part"), r("area", 9).alias("area"))


@query("s3_basins", """SELECT n_nationkey AS poly_id, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 2.0::DOUBLE END AS bau, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 THEN 9999.0::DOUBLE END AS opt, CASE WHEN n_nationkey % 8 <> 0 THEN n_nationkey * 1.0::DOUBLE END AS pes
FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 8 <> 0""")
def s3(spark, folder):
    k = F.col("poly_id")
    wide = polygons(spark, folder).select(
        "poly_id", F.when(k % 5 != 0, F.col("rings")).alias("rings"), F.when(k % 4 != 0, k / 2.0).alias("bau50_ws_x_r"),
        F.when((k % 4 != 0) & (k % 3 != 0), 9999.0).alias("opt50_ws_x_r"), F.when(k % 8 != 0, k * 1.0).alias("pes50_ws_x_r"),
    )
    return spatial.read_basins(wide).drop("rings")


@query("s5_events", "SELECT event_id, country, disaster_type, start_year FROM disasters WHERE country IN ('N1', 'N3') AND disaster_type IN ('Flood', 'Drought')", "disasters")
def s5(spark, folder):
    return events.of_types(disasters(spark, folder), ["N1", "N3"], ["Flood", "Drought"]).select("event_id", "country", "disaster_type", "start_year")


@query("s6_tracks", """SELECT event_id::VARCHAR AS sid, (1990 + event_id % 35)::INTEGER AS season, event_id % 4000 / 100.0::DOUBLE AS lat, CASE WHEN event_id % 5 = 0 THEN value WHEN event_id % 7 = 0 THEN round(value / 2, 6) ELSE greatest(value, 50.5::DOUBLE) END AS wind_kt FROM events WHERE event_id % 13 <> 0""")
def s6(spark, folder):
    k = F.col("event_id")
    raw = read_table(spark, folder, "events").select(
        k.cast("string").alias("sid"), F.when(k % 13 == 0, "Year").otherwise((1990 + k % 35).cast("string")).alias("season"), (k % 4000 / 100.0).cast("string").alias("lat"), F.lit("1.0").alias("lon"),
        F.when(k % 7 == 0, F.when(k % 5 == 0, F.col("value")).otherwise(F.round(F.col("value") / 2, 6))).otherwise(F.col("value")).cast("string").alias("wmo_wind"),
        F.when((k % 5 != 0) & (k % 7 != 0), "50.5").otherwise(" ").alias("usa_wind"), F.lit("x").alias("name"), F.lit("t").alias("iso_time"),
    )
    return events.read_tracks(raw).select("sid", "season", "lat", "wind_kt")


COVERAGE = """SELECT country, count(*) AS events, count(location) AS with_location, count(*) FILTER (form <> 0) AS with_admin, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS with_coords,
round(100.0::DOUBLE * count(location) / count(*), 1) AS pct_location, round(100.0::DOUBLE * count(*) FILTER (form <> 0) / count(*), 1) AS pct_admin, round(100.0::DOUBLE * count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) / count(*), 1) AS pct_coords FROM disasters GROUP BY 1"""
SEVERITY = """SELECT country, count(*) FILTER (deaths >= 10) AS n_deaths, count(*) FILTER (affected >= 100) AS n_affected, count(*) FILTER (declaration = 'Yes') AS n_declaration, count(*) FILTER (appeal = 'Yes') AS n_appeal,
count(*) FILTER (deaths >= 10 OR coalesce(affected >= 100, false) OR declaration IS NOT NULL OR appeal = 'Yes') AS n_any, count(*) FILTER (form = 4) AS n_gid_0, count(*) FILTER (form IN (1, 5)) AS n_gid_1, count(*) FILTER (form IN (2, 5)) AS n_gid_2,
count(*) FILTER (form = 3) AS n_unreadable FROM disasters GROUP BY 1"""
MULTIPLIERS = "SELECT country, count(*) AS events, round(count(*) / 124.0::DOUBLE, 9) AS rate, round(1 + 0.5 * count(*) / max(count(*)) OVER (), 9) AS multiplier FROM disasters GROUP BY 1"


def placed(spark, folder) -> DataFrame:
    """The events in their customers' nations (and ``region``), which hold different numbers of them."""
    nation = read_table(spark, folder, "nation").join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owner = read_table(spark, folder, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    order = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("c_custkey"))
    return disasters(spark, folder).drop("country").join(order.join(owner, "c_custkey").drop("c_custkey"), "event_id")


@query("a21_event_coverage", COVERAGE, "disasters")
def a21(spark, folder):
    return events.coverage(disasters(spark, folder))


@query("a22_event_counts", "SELECT country, disaster_type, start_year, count(*) AS count FROM disasters GROUP BY ALL", "disasters")
def a22(spark, folder):
    return events.counts(disasters(spark, folder))


@query("a23_severity", SEVERITY, "disasters")
def a23(spark, folder):
    return events.severity(disasters(spark, folder))


@query("a24_event_multipliers", MULTIPLIERS, "disasters")
def a24(spark, folder):
    return events.multipliers(disasters(spark, folder)).withColumns({"rate": r("rate", 9), "multiplier": r("multiplier", 9)})


@query("a21_nation_coverage", COVERAGE.replace("FROM disasters", "FROM placed"), "placed")
def a21n(spark, folder):
    return events.coverage(placed(spark, folder))


@query("a23_nation_severity", SEVERITY.replace("FROM disasters", "FROM placed"), "placed")
def a23n(spark, folder):
    return events.severity(placed(spark, folder))


@query("a24_nation_multipliers", MULTIPLIERS.replace("FROM disasters", "FROM placed"), "placed")
def a24n(spark, folder):
    return events.multipliers(placed(spark, folder)).withColumns({"rate": r("rate", 9), "multiplier": r("multiplier", 9)})


@query("j10_region_multiplier", """SELECT plant_uid, round(capacity_mw * coalesce(m, 1), 6) AS weighted FROM plants LEFT JOIN (SELECT region AS country, 1 + 0.5 * count(*) / max(count(*)) OVER () AS m FROM placed WHERE disaster_type = 'Flood' AND region <> 'EUROPE' GROUP BY region) USING (country)""", "plants", "placed")
def j10r(spark, folder):
    """Capacity times the flood multiplier of the plant's region; one region has none."""
    floods = placed(spark, folder).filter("disaster_type = 'Flood' and region <> 'EUROPE'").drop("country").withColumnRenamed("region", "country")
    return events.weighted_by_country(carriers.plants(spark, folder), events.multipliers(floods), "capacity_mw").select("plant_uid", r("weighted", 6).alias("weighted"))


@query("f31_event_codes", "SELECT event_id, country, term, start_year, gid FROM hits", "disasters")
def f31(spark, folder):
    return events.exploded(disasters(spark, folder))


@query("o6_event_polygons", "SELECT DISTINCT term, gid FROM hits JOIN polys USING (gid)", "disasters", "polys")
def o6(spark, folder):
    return events.exploded(disasters(spark, folder)).join(F.broadcast(polygons(spark, folder).select("gid")), "gid").select("term", "gid").distinct()


@query("j9_polygon_has_event", "SELECT poly_id, gid IN (SELECT gid FROM hits WHERE term = 'wind') AS hit FROM polys", "disasters", "polys")
def j9(spark, folder):
    hit = events.exploded(disasters(spark, folder)).filter("term = 'wind'").select("gid").distinct().withColumn("hit", F.lit(True))
    return polygons(spark, folder).select("poly_id", "gid").join(hit, "gid", "left").select("poly_id", F.coalesce("hit", F.lit(False)).alias("hit"))


BROAD = """SELECT plant_uid, country, bucket, 'broad_impact' AS validator_class, term, CASE WHEN term NOT IN ('heat', 'spei', 'precip', 'wind') OR gid IS NULL THEN 'Not Applicable' WHEN n > 0 THEN 'Corroborated' ELSE 'No Record' END AS state,
CASE WHEN gid IS NULL THEN 0 ELSE coalesce(n, 0) END AS n_events, gid FROM plants LEFT JOIN located USING (plant_uid) JOIN applicable USING (bucket) LEFT JOIN (SELECT term, gid, count(*) AS n FROM hits WHERE start_year >= 2000 GROUP BY ALL) USING (term, gid)"""
PHYSICAL = """SELECT plant_uid, country, bucket, 'physical_occurrence' AS validator_class, term, CASE WHEN term <> 'wind' THEN 'Not Applicable' WHEN n_near > 0 THEN 'Corroborated' ELSE 'No Record' END AS state,
CASE WHEN term = 'wind' THEN n_near ELSE 0 END AS n_events, NULL::VARCHAR AS gid FROM plants JOIN near USING (plant_uid) JOIN applicable USING (bucket)"""
carriers.SQL["validated"] = f"validated AS ({BROAD} UNION ALL {PHYSICAL})"
carriers.NEEDS["validated"] = ("located", "disasters", "near", "applicable")


def validated(spark, folder) -> DataFrame:
    return events.contextual_validation(carriers.plants(spark, folder), polygons(spark, folder), disasters(spark, folder), tracks(spark, folder))


@query("j8_broad_impact", BROAD, "located", "disasters", "applicable")
def j8(spark, folder):
    located = spatial.first_polygon(points(spark, folder), polygons(spark, folder)).select(F.col("point_id").alias("plant_uid"), "gid")
    return events.broad_impact(carriers.plants(spark, folder).join(located, "plant_uid"), events.exploded(disasters(spark, folder)))


@query("c13_contextual_validation", "SELECT * FROM validated", "validated")
def c13(spark, folder):
    return validated(spark, folder)


@query("a38_track_summary", "SELECT season, count(*) AS points, count(DISTINCT event_id % 100) AS storms FROM tracks GROUP BY 1", "tracks")
def a38(spark, folder):
    return tracks(spark, folder).groupBy("season").agg(F.count(F.lit(1)).alias("points"), F.count_distinct(F.col("event_id") % 100).alias("storms"))


@query("c14_spatial_event_test", """SELECT n1, n2, median1, median2, CASE WHEN n1 >= 3 AND n2 >= 3 THEN round(u, 6) END AS u, CASE WHEN n1 >= 3 AND n2 >= 3 THEN round((abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))), 8) END AS z FROM (SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2, round(quantile_cont(mean, 0.5) FILTER (flag), 9) AS median1, round(quantile_cont(mean, 0.5) FILTER (NOT flag), 9) AS median2,
sum(rk) FILTER (flag) - n1 * (n1 + 1) / 2 AS u, (SELECT coalesce(sum(t * t * t - t), 0)::DOUBLE FROM (SELECT count(*) AS t FROM zones WHERE mean IS NOT NULL GROUP BY mean)) AS ties FROM (SELECT *, rank() OVER (ORDER BY mean) + (count(*) OVER (PARTITION BY mean) - 1) / 2 AS rk FROM (SELECT mean, gid IN (SELECT gid FROM hits WHERE term = 'precip' AND start_year >= 2010) AS flag FROM zones WHERE mean IS NOT NULL)))""", "zones", "disasters")
def c14(spark, folder):
    found = events.exploded(disasters(spark, folder)).filter("start_year >= 2010")
    out = events.spatial_event_test(polygons(spark, folder), precip_cells(spark, folder), carriers.GRID, found, "precip")
    return out.select("n1", "n2", r("median1", 9).alias("median1"), r("median2", 9).alias("median2"), r("u", 6).alias("u"), r("z", 8).alias("z"))


@query("a38_tracks_by_country", "SELECT n_name AS country, count(t.event_id) AS points, count(DISTINCT t.event_id % 100) AS storms FROM nation LEFT JOIN (SELECT * FROM tracks WHERE event_id % 6 <> 5) t ON t.event_id % 6 = n_nationkey % 7 GROUP BY 1", "tracks")
def a38c(spark, folder):
    """Basins serve several countries, and two have no basin with points."""
    k = F.col("event_id")
    points_ = tracks(spark, folder).withColumns({"basin": k % 6, "sid": k % 100}).filter("basin <> 5")
    countries = read_table(spark, folder, "nation").select(F.col("n_name").alias("country"), (F.col("n_nationkey") % 7).alias("basin"))
    return events.track_summary(points_, countries)


def normal_p(z: str) -> str:
    """Two-sided p of a z in SQL, by the engine's own polynomial."""
    t = f"(1.0::DOUBLE / (1.0 + 0.2316419::DOUBLE * abs({z})))"
    upper = f"0.3989422804014327::DOUBLE * exp(-{z} * {z} / 2.0) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"least(greatest(2 * CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END, 0), 1)"


#: Sizes, medians, U, z and asymptotic p of rows rk(keys, value, flag, rk).
TESTED = """{name} AS (SELECT {keys}, count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2, quantile_cont(value, 0.5) FILTER (flag) AS median1, quantile_cont(value, 0.5) FILTER (NOT flag) AS median2, sum(rk) FILTER (flag) - n1 * (n1 + 1) / 2 AS u0, any_value(ties) AS tied,
  (abs(u0 - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - tied / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) AS z0 FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2 AS rk FROM {rows} WHERE value IS NOT NULL)
  JOIN (SELECT {keys}, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT {keys}, value, count(*)::DOUBLE AS t FROM {rows} WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING ({keys}) GROUP BY ALL)"""


@query("a16_rank_sum_test", f"""WITH flagged AS (SELECT l_linestatus, l_quantity AS value, l_returnflag = 'R' AS flag FROM lineitem), {TESTED.format(name="tested", keys="l_linestatus", rows="flagged")}
SELECT l_linestatus, n1, n2, median1, median2, CASE WHEN least(n1, n2) >= 3 THEN round(u0, 1) END AS u, CASE WHEN least(n1, n2) >= 3 THEN round(z0, 6) END AS z, CASE WHEN least(n1, n2) >= 3 THEN round({normal_p("z0")}, 6) END AS p, CASE WHEN least(n1, n2) >= 3 THEN 'asymptotic' END AS method,
CASE WHEN least(n1, n2) < 3 THEN 'group below 3' END AS reason FROM tested""")
def a16(spark, folder):
    rows = read_table(spark, folder, "lineitem").select("l_linestatus", F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").alias("flag"))
    return events.rank_sum_test(rows, ("l_linestatus",)).withColumns({"u": r("u", 1), "z": r("z", 6), "p": r("p", 6)})


ZONAL = f"""z AS (SELECT poly_id, gid, term, avg(v) AS mean FROM polys CROSS JOIN (SELECT unnest(['heat', 'spei', 'ws']) AS term) LEFT JOIN (SELECT v AS poly_id, term, ((p_partkey * a + p_size * 7 + 11) % modulus) / divisor AS v FROM (SELECT id, v FROM ({CENTRES.format(pick="poly_id")})) JOIN part ON p_partkey = id CROSS JOIN rules
  WHERE term IN ('heat', 'spei', 'ws') AND (p_partkey + a) % 31 <> 0) USING (poly_id, term) GROUP BY 1, 2, 3),
flagged AS (SELECT unnest(['N' || poly_id // 5, 'all']) AS country, term, mean AS value, (term, gid) IN (SELECT CASE term WHEN 'precip' THEN 'ws' ELSE term END, gid FROM hits WHERE term IN ('heat', 'spei', 'precip')) AS flag FROM z),
dp AS (SELECT 0 AS i, 0 AS size, 0 AS s, 1::HUGEINT AS c UNION ALL SELECT i + 1, size + t, s + t * (i + 1), sum(c)::HUGEINT FROM dp CROSS JOIN (VALUES (0), (1)) x(t) WHERE i < 25 GROUP BY i, size + t, s + t * (i + 1)),
{TESTED.format(name="tested", keys="country, term", rows="flagged")},
orders_of AS (SELECT i, size, s - size * (size + 1) // 2 AS u, sum(c) OVER (PARTITION BY i, size ORDER BY s DESC)::DOUBLE / sum(c) OVER (PARTITION BY i, size)::DOUBLE AS tail FROM dp),
counted AS (SELECT country, term, count(*) FILTER (flag) AS polygons_with, count(*) FILTER (NOT flag) AS polygons_without FROM flagged GROUP BY 1, 2)
SELECT country, term, polygons_with, polygons_without, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, round(median1, 9) AS median1, round(median2, 9) AS median2, CASE WHEN ok THEN round(u0, 1) END AS u, CASE WHEN ok THEN round(CASE WHEN exact THEN least(2 * tail, 1) ELSE {normal_p("z0")} END, 9) END AS p,
CASE WHEN ok THEN CASE WHEN exact THEN 'exact' ELSE 'asymptotic' END END AS method, CASE WHEN NOT coalesce(ok, false) THEN 'group below 3' END AS reason
FROM counted LEFT JOIN (SELECT *, least(n1, n2) >= 3 AS ok, tied = 0 AND least(n1, n2) BETWEEN 3 AND 8 AS exact FROM tested) USING (country, term) LEFT JOIN orders_of o ON exact AND o.i = n1 + n2 AND o.size = n1 AND o.u = greatest(u0, n1 * n2 - u0)"""


@query("c14_zonal_validation", carriers.with_sql(ZONAL, "polys", "disasters", "rules").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nz AS", ",\nz AS", 1))
def c14z(spark, folder):
    """Every country and all together, for the disaster types that have a zonal layer."""
    layers = carriers.cells(spark, folder).filter("scenario = 'bau' and model in ('-', 'gfdl_esm4')").select("term", "row", "col", "value")
    areas, found = polygons(spark, folder).withColumn("country", F.substring_index("gid", ".", 1)), disasters(spark, folder)
    both = [events.zonal_event_tests(a, layers, carriers.GRID, found)["summary"] for a in (areas, areas.withColumn("country", F.lit("all")))]
    out = both[0].unionByName(both[1])
    return out.select("country", "term", "polygons_with", "polygons_without", "n1", "n2", r("median1", 9).alias("median1"), r("median2", 9).alias("median2"), r("u", 1).alias("u"), r("p", 9).alias("p"), "method", "reason")
