"""Result tables, map layers, diagnostics, sources and sinks, streaming."""

from __future__ import annotations


from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.operators import events, quality, report, risk
from riskgrid.plans import carriers
from riskgrid.sources import sinks, tables
from riskgrid.sources.tables import read_table
from riskgrid.streaming import annual_max

from . import places
from .base import bands, bounds, cuts, index, own_ids, query, r, sampled, samples, single


@query("a27_band_distribution", """SELECT k.country, k.bucket, k.term, k.water_scenario, k.model, l AS risk_band, count(b.plant_uid) FILTER (b.risk_band = l) AS n, round(coalesce(sum(capacity_mw) FILTER (b.risk_band = l), 0), 4) AS mw,
round(100.0::DOUBLE * coalesce(sum(capacity_mw) FILTER (b.risk_band = l), 0) / sum(capacity_mw), 6) AS pct, count(*) FILTER (b.risk_band IS NULL) AS n_missing FROM bands b JOIN (SELECT DISTINCT country, bucket, term, water_scenario, model FROM bands) k
USING (country, bucket, term, water_scenario, model) CROSS JOIN (SELECT unnest(['Low', 'Medium', 'High', 'Extreme']) AS l) GROUP BY ALL""", "bands")
def a27(spark, folder):
    return report.band_distribution(bands(spark, folder)).withColumns({"mw": r("mw", 4), "pct": r("pct", 6)})


@query("a28_label_distribution", """SELECT country, bucket, water_scenario, model, l AS label, count(*) FILTER (coalesce(label, 'INCOMPLETE') = l) AS n, round(coalesce(sum(capacity_mw) FILTER (coalesce(label, 'INCOMPLETE') = l), 0), 4) AS mw,
round(count(*) FILTER (coalesce(label, 'INCOMPLETE') = l) / count(*)::DOUBLE, 9) AS share FROM (SELECT country, bucket, water_scenario, model, label, capacity_mw, unnest(['LOW', 'MEDIUM', 'HIGH', 'EXTREME', 'INCOMPLETE']) AS l FROM idx) GROUP BY 1, 2, 3, 4, 5""", "idx")
def a28(spark, folder):
    return report.label_distribution(index(spark, folder)).withColumns({"mw": r("mw", 4), "share": r("share", 9)})


@query("a30_validator_overlay", """SELECT validator_class, country, term, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY validator_class, country, term), 9) AS share FROM validated GROUP BY validator_class, country, term, state""", "validated")
def a30(spark, folder):
    return report.overlay(places.validated(spark, folder)).withColumn("share", r("share", 9))


@query("a31_spread", """SELECT term, model, count(value) AS n, round(quantile_cont(value, 0.01), 8) AS p1, round(quantile_cont(value, 0.05), 8) AS p5, round(quantile_cont(value, 0.25), 8) AS p25, round(quantile_cont(value, 0.5), 8) AS p50,
round(quantile_cont(value, 0.75), 8) AS p75, round(quantile_cont(value, 0.95), 8) AS p95, round(quantile_cont(value, 0.99), 8) AS p99, max(value) AS top, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skewness
FROM (SELECT *, avg(value) OVER (PARTITION BY term, model) AS m FROM samples) GROUP BY 1, 2""", "samples")
def a31(spark, folder):
    found = report.spread(samples(spark, folder), "term", "model")
    return found.withColumns({c: r(c, 8) for c in found.columns if c[0] == "p"} | {"skewness": r("skewness", 6)})


@query("a34_unmatched", "SELECT plant_uid, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT plant_uid, term FROM samples GROUP BY 1, 2 HAVING count(value) = 0) GROUP BY 1", "samples")
def a34(spark, folder):
    return report.unmatched(samples(spark, folder)).withColumn("terms", F.concat_ws(",", "terms"))


@query("a32_cross_table", """SELECT bucket, model, a AS band_a, b AS band_b, round(sum(capacity_mw), 4) AS mw, round(sum(capacity_mw) / sum(sum(capacity_mw)) OVER (PARTITION BY bucket, model), 8) AS share FROM (SELECT x.bucket, x.model, x.risk_band AS a, y.risk_band AS b, x.capacity_mw
FROM bands x JOIN bands y USING (plant_uid, water_scenario, model) WHERE x.term = 'ws' AND y.term = 'precip' AND x.risk_band IS NOT NULL AND y.risk_band IS NOT NULL) GROUP BY bucket, model, a, b""", "bands")
def a32(spark, folder):
    return report.cross_table(bands(spark, folder), "ws", "precip").withColumns({"mw": r("mw", 4), "share": r("share", 8)})


@query("a33_dominance", """SELECT * FROM (SELECT bucket, term, water_scenario, model, risk_band, round(sum(capacity_mw) / sum(sum(capacity_mw)) OVER (PARTITION BY bucket, term, water_scenario, model), 8) AS share FROM bands WHERE risk_band IS NOT NULL GROUP BY bucket, term, water_scenario, model, risk_band) WHERE share > 0.5""", "bands")
def a33(spark, folder):
    return report.dominance(bands(spark, folder)).withColumn("share", r("share", 8))


@query("a35_age_summary", """SELECT country, CASE WHEN bucket = 'thermal' THEN 'thermal:' || CASE WHEN mixed_fuel_type THEN 'mixed' ELSE fuel_type END ELSE bucket END AS curve, round(min(age_factor), 9) AS low, round(avg(age_factor), 9) AS mean, round(max(age_factor), 9) AS high,
count(*) AS n, count(*) FILTER (commissioning_year IS NULL) AS n_missing FROM age GROUP BY 1, 2""", "age")
def a35(spark, folder):
    return report.age_summary(risk.age_factors(carriers.plants(spark, folder))).withColumns({c: r(c, 9) for c in ("low", "mean", "high")})


@query("f5_robust_transform", """SELECT plant_uid, term, water_scenario, model, round((least(greatest(value, p1), p99) - p1) / (p99 - p1), 8) AS robust, round((rk - 1) / (n - 1), 9) AS rank_quantile FROM (SELECT *, rank() OVER (PARTITION BY term, model ORDER BY value) + (count(*) OVER (PARTITION BY term, model, value) - 1) / 2 AS rk
FROM samples WHERE value IS NOT NULL) JOIN (SELECT term, model, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99, count(value) AS n FROM samples GROUP BY 1, 2) USING (term, model)""", "samples")
def f5(spark, folder):
    return report.robust(samples(spark, folder), "term", "model").select("plant_uid", "term", "water_scenario", "model", r("robust", 8).alias("robust"), r("rank_quantile", 9).alias("rank_quantile"))


carriers.SQL["cw"] = "cw(bucket, term, w) AS (VALUES " + ", ".join(f"('{b}', '{t}', {w!r}::DOUBLE)" for b, t, w in report.composite_weights()) + ")"
W = report.water_weights()
CUTS = report.water_cuts()


@query("f26_water_bands", f"""SELECT plant_uid, water_scenario, model, round(s, 9) AS score, CASE WHEN s IS NULL THEN NULL WHEN s >= {CUTS[3]} THEN 'Extremely High' WHEN s >= {CUTS[2]} THEN 'High' WHEN s >= {CUTS[1]} THEN 'Medium-High' WHEN s >= {CUTS[0]} THEN 'Low-Medium' ELSE 'Low' END AS band
FROM (SELECT plant_uid, water_scenario, model, CASE WHEN count(value) = 3 THEN sum(value * CASE term WHEN 'ws' THEN {W["ws"]} WHEN 'sv' THEN {W["sv"]} ELSE {W["iv"]} END::DOUBLE) END AS s FROM samples WHERE term IN ('ws', 'sv', 'iv') GROUP BY ALL)""", "samples")
def f26(spark, folder):
    return report.water_bands(samples(spark, folder)).select("plant_uid", "water_scenario", "model", r("score", 9).alias("score"), "band")


@query("f27_composite_score", """SELECT plant_uid, water_scenario, model, round(CASE WHEN k = p THEN s * age_factor * coalesce(multiplier, 1) END, 8) AS score FROM (SELECT s.plant_uid, any_value(s.country) AS country, s.water_scenario, s.model, count(s.value) AS k, count(*) AS p, sum(w * CASE WHEN s.term IN ('sv', 'iv')
THEN (value - lo) / (hi - lo) ELSE (ln(1 + value) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo)) END) AS s FROM samples s JOIN cw USING (bucket, term) JOIN bounds b ON b.term = s.term AND b.bound_model = CASE WHEN s.term IN ('heat', 'spei', 'precip') THEN s.model ELSE '-' END
GROUP BY s.plant_uid, s.water_scenario, s.model) JOIN age USING (plant_uid) LEFT JOIN (SELECT r_name AS country, 1 + count(*) / 8.0::DOUBLE AS multiplier FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY 1) m ON m.country = age.country""", "samples", "bounds", "age", "cw")
def f27(spark, folder):
    named = read_table(spark, folder, "nation").join(read_table(spark, folder, "region").filter("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = named.groupBy(F.col("r_name").alias("country")).agg((1 + F.count(F.lit(1)) / F.lit(8.0)).alias("multiplier"))
    return report.composite_score(samples(spark, folder), bounds(spark, folder), m).select("plant_uid", "water_scenario", "model", r("score", 8).alias("score"))




@query("c22_map_layer", """SELECT plant_uid, term, water_scenario, model, risk_band, lon, lat, round(6 + 162 * sqrt(greatest(coalesce(capacity_mw, 0), 0) / max(capacity_mw) OVER ()), 8) AS marker_size FROM bands""", "bands")
def c22(spark, folder):
    return report.map_layer(bands(spark, folder)).select("plant_uid", "term", "water_scenario", "model", "risk_band", "lon", "lat", r("marker_size", 8).alias("marker_size"))


@query("j12_screening_map", """SELECT plant_uid, i.bucket, water_scenario, model, label, plant_uid IN (SELECT plant_uid FROM validated WHERE validator_class = 'broad_impact' AND state = 'Corroborated') AS broad_impact,
plant_uid IN (SELECT plant_uid FROM validated WHERE validator_class = 'physical_occurrence' AND state = 'Corroborated') AS physical_occurrence FROM idx i""", "idx", "validated")
def j12(spark, folder):
    return report.screening_map(index(spark, folder), places.validated(spark, folder))


@query("c21_threshold_provenance", """SELECT bucket, term, CASE WHEN term = 'ws' OR bucket = 'wind' THEN 1 ELSE 3 END AS tier, CASE WHEN term = 'ws' THEN 'absolute' WHEN bucket = 'wind' THEN 'binary' ELSE 'percentile' END AS kind,
CASE WHEN term = 'ws' THEN '0.1, 0.4, 0.8' WHEN bucket = 'wind' THEN '25' WHEN term = 'wind' THEN '75, 90, 95, 99' ELSE '50, 75, 90, 95' END AS cuts, count(value) AS n FROM samples JOIN applicable USING (bucket, term) GROUP BY ALL""", "samples", "applicable")
def c21(spark, folder):
    return report.threshold_provenance(samples(spark, folder))


@query("j11_risk_with_bands", """SELECT r.plant_uid, r.term, r.water_scenario, r.model, risk::FLOAT::DOUBLE AS risk, risk_band FROM risk r LEFT JOIN bands b USING (plant_uid, term, water_scenario, model)""", "risk", "bands")
def j11(spark, folder):
    """Where no plants share an id, a row's band is that of its own sample, so that nothing is joined."""
    keys = ["plant_uid", "term", "water_scenario", "model"]
    if own_ids(spark, folder):
        graded = risk.risk_bands(sampled(spark, folder), cuts(spark, folder), others=True)
        found = risk.risk_by_hazard(graded, bounds(spark, folder), keep=("risk_band",))
    else:
        found = risk.risk_by_hazard(samples(spark, folder), bounds(spark, folder)).join(bands(spark, folder).select(*keys, "risk_band"), keys, "left")
    return found.select(*keys, single("risk").alias("risk"), "risk_band")


@query("j10_country_multiplier", """SELECT plant_uid, round(capacity_mw * coalesce(m, 1), 6) AS weighted FROM plants LEFT JOIN (SELECT CASE country WHEN 'N0' THEN 'AFRICA' WHEN 'N1' THEN 'AMERICA' WHEN 'N2' THEN 'ASIA' WHEN 'N3' THEN 'EUROPE' END AS country, 1 + 0.5 * count(*) / max(count(*)) OVER () AS m FROM disasters GROUP BY country) USING (country)""", "plants", "disasters")
def j10(spark, folder):
    names = F.create_map(*(F.lit(x) for kv in (("N0", "AFRICA"), ("N1", "AMERICA"), ("N2", "ASIA"), ("N3", "EUROPE")) for x in kv))
    m = events.multipliers(places.disasters(spark, folder)).select(F.try_element_at(names, F.col("country")).alias("country"), "multiplier")
    return events.weighted_by_country(carriers.plants(spark, folder), m, "capacity_mw").select("plant_uid", r("weighted", 6).alias("weighted"))


@query("q4_bounds_drift", """SELECT coalesce(b.term, z.term) AS term, coalesce(b.bound_model, z.bound_model) AS bound_model FROM bounds b FULL JOIN (SELECT term, bound_model, CASE WHEN term = 'heat' THEN lo - 0.0002 ELSE lo END AS lo, CASE term WHEN 'ws' THEN hi + 0.00005 WHEN 'precip' THEN hi + 0.00011 ELSE hi END AS hi
FROM bounds WHERE term <> 'sv' UNION ALL SELECT 'snow', '-', 0, 1) z USING (term, bound_model) WHERE NOT coalesce(abs(b.lo - z.lo) <= 0.0001 AND abs(b.hi - z.hi) <= 0.0001, false)""", "bounds")
def q4(spark, folder):
    """Frozen bounds that lack a term, have one more, and move others within and beyond the tolerance."""
    now, t = bounds(spark, folder), F.col("term")
    moved = now.filter(t != "sv").select("term", "bound_model", F.when(t == "heat", F.col("lo") - 0.0002).otherwise(F.col("lo")).alias("lo"), F.when(t == "ws", F.col("hi") + 0.00005).when(t == "precip", F.col("hi") + 0.00011).otherwise(F.col("hi")).alias("hi"))
    frozen = moved.unionByName(spark.createDataFrame([("snow", "-", 0.0, 1.0)], moved.schema))
    return quality.drifted(now, frozen, "term", "bound_model").select("term", "bound_model")


@query("q5_null_hazards", """SELECT t AS term, rows, banded FROM (SELECT unnest(['ws', 'heat', 'sv', 'iv', 'spei', 'precip', 'wind', 'absent']) AS t) LEFT JOIN (SELECT term, count(*) AS rows, count(CASE WHEN term NOT IN ('iv', 'wind') OR plant_uid < 'AM' AND term = 'wind' THEN risk_band END) AS banded
FROM bands GROUP BY 1) ON term = t WHERE coalesce(banded, 0) = 0""", "bands")
def q5(spark, folder):
    """Bands of one term are all taken away, those of another in part, and one term has no row."""
    gone = (F.col("term") == "iv") | ((F.col("term") == "wind") & (F.col("plant_uid") >= "AM"))
    return quality.null_hazards(bands(spark, folder).withColumn("risk_band", F.when(~gone, F.col("risk_band"))), *C.TERMS, "absent")


@query("q3_grid_mismatch", """WITH m AS (SELECT n_regionkey AS country, n_name AS layer, CASE WHEN n_nationkey % 7 = 3 THEN 1e-6 WHEN n_nationkey % 2 = 0 THEN 1e-12 ELSE 0 END::DOUBLE AS xmin, CASE WHEN n_nationkey % 11 = 2 THEN 40.5 ELSE 40 END::DOUBLE AS ymax, CASE n_nationkey WHEN 5 THEN 0.5 ELSE 1 END::DOUBLE AS res,
CASE n_nationkey WHEN 4 THEN 51 ELSE 50 END AS width, CASE n_nationkey WHEN 16 THEN 39 ELSE 40 END AS height, CASE n_nationkey WHEN 23 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs FROM nation), f AS (SELECT country, arg_min(m, layer) AS r FROM m GROUP BY 1)
SELECT layer FROM m JOIN f USING (country) WHERE abs(xmin - r.xmin) > 1e-9 OR abs(ymax - r.ymax) > 1e-9 OR abs(res - r.res) > 1e-9 OR width <> r.width OR height <> r.height OR crs <> r.crs""")
def q3(spark, folder):
    n, k = read_table(spark, folder, "nation"), F.col("n_nationkey")
    meta = n.select(
        F.col("n_regionkey").alias("country"), F.col("n_name").alias("layer"), F.when(k % 7 == 3, 1e-6).when(k % 2 == 0, 1e-12).otherwise(0.0).alias("xmin"), F.when(k % 11 == 2, 40.5).otherwise(40.0).alias("ymax"), F.when(k == 5, 0.5).otherwise(1.0).alias("res"),
        F.when(k == 4, 51).otherwise(50).alias("width"), F.when(k == 16, 39).otherwise(40).alias("height"), F.when(k == 23, "EPSG:3857").otherwise("EPSG:4326").alias("crs"),
    )
    return quality.other_grid(meta).select("layer")


@query("q7_buckets", "SELECT string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS buckets FROM plants HAVING count(DISTINCT bucket) > 1", "plants")
def q7(spark, folder):
    return quality.buckets_in(carriers.plants(spark, folder)).select(F.concat_ws(",", "buckets").alias("buckets"))


@query("s9_csv_round_trip", "SELECT plant_uid, country, capacity_mw FROM plants", "plants")
def s9(spark, folder):
    made = carriers.plants(spark, folder).select("plant_uid", "country", "capacity_mw")
    return sinks.read_csv(spark, sinks.write_csv(made, sinks.scratch(spark)), made.schema)


@query("s10_nested_round_trip", "SELECT term, bound_model, lo, hi FROM bounds", "bounds")
def s10(spark, folder):
    made = bounds(spark, folder).select("term", "bound_model", F.struct("lo", "hi").alias("bounds"))
    return sinks.read_json(spark, sinks.write_json(made, sinks.scratch(spark)), made.schema).select("term", "bound_model", "bounds.lo", "bounds.hi")


@query("s1_read_assets", "SELECT plant_name, country, CASE WHEN capacity_mw = 10 THEN NULL ELSE capacity_mw END AS capacity_mw, commissioning_year FROM (SELECT s_name AS plant_name, 'N' || s_nationkey AS country, (s_suppkey % 30)::DOUBLE AS capacity_mw, (1960 + s_suppkey % 60)::DOUBLE AS commissioning_year FROM supplier)")
def s1(spark, folder):
    from riskgrid.operators import assets

    k = F.col("s_suppkey")
    raw = read_table(spark, folder, "supplier").select(
        F.col("s_name").alias("Plant / Project name"), F.lit("1.5").alias("Latitude"), F.lit("2.5").alias("Longitude"), F.when(k % 30 == 10, "n/a").otherwise((k % 30).cast("string")).alias("Capacity (MW)"),
        F.lit("coal").alias("Type"), (1960 + k % 60).cast("string").alias("Start year"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("Country/area"), F.lit("operating").alias("Status"),
    )
    return assets.read_assets(spark, sinks.write_csv(raw, sinks.scratch(spark))).select("plant_name", "country", "capacity_mw", "commissioning_year")


@query("s7_partitioned_series", "SELECT user_id % 40 AS cell, (event_id % 30 + 2041)::INTEGER AS year, round(avg(value), 8) AS mean, count(*) AS n FROM events WHERE event_id % 30 BETWEEN 5 AND 14 GROUP BY ALL")
def s7(spark, folder):
    """A series in one file a year, of which ten years are read."""
    e = read_table(spark, folder, "events").select((F.col("event_id") % 30 + 2041).cast("int").alias("year"), (F.col("user_id") % 40).alias("cell"), F.col("value").alias("tas"), F.lit("x").alias("note"))
    path = sinks.write_partitioned(e, sinks.scratch(spark), "year")
    series = tables.read_series(spark, path, ("pr", "tas"), 2046, 2055)
    return series.groupBy("cell", "year").agg(r(F.avg("value"), 8).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("t1_annual_max_stream", "SELECT user_id % 40 AS cell, event_id % 30 + 2041 AS year, max(value) AS top FROM events GROUP BY ALL")
def t1(spark, folder):
    top = sinks.scratch(spark)
    feed = read_table(spark, folder, "events").select((F.col("user_id") % 40).alias("cell"), (F.col("event_id") % 30 + 2041).alias("year"), "value")
    feed.repartition(4).write.parquet(f"{top}/feed")
    return annual_max.fold(spark, f"{top}/feed", "cell long, year long, value double", f"{top}/state", f"{top}/progress")


@query("q4_frozen_bounds", "SELECT coalesce(b.term, z.term) AS term, coalesce(b.bound_model, z.bound_model) AS bound_model FROM bounds b FULL JOIN (VALUES " + ", ".join(f"('{t}', '{m or '-'}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for (t, m), (lo, hi) in C.FROZEN_BOUNDS.items()) + """) z(term, bound_model, lo, hi) USING (term, bound_model)
WHERE NOT coalesce(abs(b.lo - z.lo) <= 0.0001 AND abs(b.hi - z.hi) <= 0.0001, false)""", "bounds")
def q4f(spark, folder):
    """The tables' bounds against the registry's frozen ones."""
    return quality.frozen_drift(bounds(spark, folder)).select("term", "bound_model")
