"""Plants, samples, risk, bands and the screening index."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.functions import exprs as X
from riskgrid.operators import grid, quality, risk
from riskgrid.plans import carriers
from riskgrid.sources import sinks

from .base import bands, bounds, counted, index, query, r, risks, samples, single

#: Cells along a tile's side, small beside the tables' grids.
TILE = 16


@query("s2_plants", "SELECT * FROM plants", "plants")
def s2(spark, folder):
    return carriers.plants(spark, folder)


@query("j1_point_sample", """SELECT plant_uid, CASE WHEN (q.p_partkey + 13) % 31 <> 0 THEN ((q.p_partkey * 13 + q.p_size * 7 + 11) % 101) / 100.0::DOUBLE END AS value
FROM plants p LEFT JOIN part q ON q.p_partkey // 50 = floor(40.0 - lat)::BIGINT AND q.p_partkey % 50 = floor(lon)::BIGINT""", "plants")
def j1(spark, folder):
    cells = carriers.cells(spark, folder).filter("term = 'ws' and scenario = 'bau'").select("row", "col", "value")
    return grid.sample_points(carriers.plants(spark, folder).select("plant_uid", "lon", "lat"), cells, carriers.GRID).select("plant_uid", "value")


@query("j2_hazard_samples", "SELECT plant_uid, bucket, water_scenario, heat_scenario, model, term, value FROM samples", "samples")
def j2(spark, folder):
    return samples(spark, folder).select("plant_uid", "bucket", "water_scenario", "heat_scenario", "model", "term", "value")


@query("j2_tiled_samples", "SELECT plant_uid, bucket, water_scenario, heat_scenario, model, term, value FROM samples", "samples")
def j2t(spark, folder):
    """Layers written by tile and read through the plants' tiles."""
    tiled = spark.read.parquet(sinks.write_tiled(carriers.cells(spark, folder), sinks.scratch(spark), TILE))
    found = grid.sample_tiled(carriers.plants(spark, folder), tiled, carriers.scenario_keys(spark), carriers.GRID, TILE)
    return found.select("plant_uid", "bucket", "water_scenario", "heat_scenario", "model", "term", "value")


@query("o5_wide_samples", """SELECT plant_uid, water_scenario, model, max(value) FILTER (term = 'ws') AS ws, max(value) FILTER (term = 'heat') AS heat, max(value) FILTER (term = 'sv') AS sv,
max(value) FILTER (term = 'iv') AS iv, max(value) FILTER (term = 'spei') AS spei, max(value) FILTER (term = 'precip') AS precip, max(value) FILTER (term = 'wind') AS wind FROM samples GROUP BY ALL""", "samples")
def o5(spark, folder):
    return grid.wide(samples(spark, folder), "plant_uid", "water_scenario", "model")


@query("j3_age_join", "SELECT s.plant_uid, s.term, s.water_scenario, s.model, round(age_factor, 9) AS age_factor FROM samples s LEFT JOIN age USING (plant_uid)", "samples", "age")
def j3(spark, folder):
    ages = risk.age_factors(carriers.plants(spark, folder)).select("plant_uid", "age_factor")
    return quality.many_to_one(samples(spark, folder), ages, "plant_uid").select("plant_uid", "term", "water_scenario", "model", r("age_factor", 9).alias("age_factor"))


@query("c7_age_factors", "SELECT plant_uid, round(age_factor, 9) AS age_factor, commissioning_year IS NULL AS year_missing FROM age", "age")
def c7(spark, folder):
    return risk.age_factors(carriers.plants(spark, folder)).select("plant_uid", r("age_factor", 9).alias("age_factor"), "year_missing")


@query("a11_global_bounds", "SELECT * FROM bounds", "bounds")
def a11(spark, folder):
    return bounds(spark, folder)


@query("c8_risk_by_hazard", "SELECT plant_uid, water_scenario, model, term, round(hazard, 8) AS hazard, round(age_factor, 8) AS age_factor, risk::FLOAT::DOUBLE AS risk FROM risk", "risk")
def c8(spark, folder):
    return risks(spark, folder).select("plant_uid", "water_scenario", "model", "term", r("hazard", 8).alias("hazard"), r("age_factor", 8).alias("age_factor"), single("risk").alias("risk"))


@query("c8_top_risk", """SELECT country, term, water_scenario, model, rank, plant_uid, round(risk, 6) AS risk FROM (SELECT *, row_number() OVER (PARTITION BY country, term, water_scenario, model
ORDER BY round(risk, 6) DESC, plant_uid)::INTEGER AS rank FROM risk WHERE risk IS NOT NULL) WHERE rank <= 10""", "risk")
def top(spark, folder):
    return risk.top_risk(risks(spark, folder).withColumn("risk", r("risk", 6))).select("country", "term", "water_scenario", "model", "rank", "plant_uid", "risk")


@query("p6_computable_base", """SELECT country, bucket, count(*) AS plants, round(sum(capacity_mw), 4) AS capacity_mw FROM plants WHERE commissioning_year IS NOT NULL AND capacity_mw IS NOT NULL GROUP BY ALL""", "plants")
def p6(spark, folder):
    base = quality.computable(carriers.plants(spark, folder))
    return base.groupBy("country", "bucket").agg(F.count(F.lit(1)).alias("plants"), r(quality.guarded_sum("capacity_mw"), 4).alias("capacity_mw"))


@query("p7_scenario_pairs", "SELECT DISTINCT water_scenario, heat_scenario FROM samples", "samples")
def p7(spark, folder):
    return samples(spark, folder).select("water_scenario", "heat_scenario").distinct()


@query("a12_percentile_cuts", "SELECT term, model, round(p50, 8) AS p50, round(p75, 8) AS p75, round(p90, 8) AS p90, round(p95, 8) AS p95, round(p99, 8) AS p99, n FROM cuts", "bands")
def a12(spark, folder):
    return risk.percentile_cuts(counted(spark, folder, "bucket"), F.col("plants")).select("term", "model", *(r(c, 8).alias(c) for c in ("p50", "p75", "p90", "p95", "p99")), "n")


@query("c23_cuts_table", """SELECT bucket, term, model, round(CASE WHEN term = 'wind' THEN p75 ELSE p50 END, 8) AS diagnostic, round(CASE WHEN term = 'wind' THEN p90 ELSE p75 END, 8) AS cut_1,
round(CASE WHEN term = 'wind' THEN p95 ELSE p90 END, 8) AS cut_2, round(CASE WHEN term = 'wind' THEN p99 ELSE p95 END, 8) AS cut_3, n FROM applicable JOIN cuts USING (term)
WHERE term <> 'ws' AND bucket <> 'wind'""", "bands")
def c23(spark, folder):
    return risk.band_cuts(counted(spark, folder, "bucket"), F.col("plants")).filter("kind = 'percentile'").select("bucket", "term", "model", *(r(c, 8).alias(c) for c in ("diagnostic", "cut_1", "cut_2", "cut_3")), "n")


@query("c9_risk_bands", "SELECT plant_uid, water_scenario, model, term, risk_band FROM bands", "bands")
def c9(spark, folder):
    return bands(spark, folder).select("plant_uid", "water_scenario", "model", "term", "risk_band")


@query("c10_screening_index", "SELECT plant_uid, water_scenario, model, set_size, n_missing, n_high, round(index_value, 9) AS index_value, label, coalesce(missing, '') AS missing FROM idx", "idx")
def c10(spark, folder):
    return index(spark, folder).select("plant_uid", "water_scenario", "model", "set_size", "n_missing", "n_high", r("index_value", 9).alias("index_value"), "label", F.concat_ws(",", "missing_hazards").alias("missing"))


@query("a26_index_coverage", "SELECT bucket, country, model, count_if(index_value IS NULL)::BIGINT AS incomplete, count(*) AS total, round(incomplete / total::DOUBLE, 8) AS share FROM idx GROUP BY ALL", "idx")
def a26(spark, folder):
    return risk.index_coverage(index(spark, folder), "bucket", "country", "model").withColumn("share", r("share", 8))


@query("w5_rank_in_bucket", """SELECT plant_uid, water_scenario, model, rank() OVER (PARTITION BY water_scenario, model ORDER BY index_value DESC NULLS LAST)::INTEGER AS rank FROM idx WHERE bucket = 'hydro'""", "idx")
def w5(spark, folder):
    return risk.rank_within_bucket(index(spark, folder), "hydro").select("plant_uid", "water_scenario", "model", "rank")


@query("w6_scenario_invariance", """SELECT a.plant_uid, bands, round(spread, 6) AS spread FROM (SELECT plant_uid, count(DISTINCT risk_band) AS bands FROM bands WHERE term = 'precip' GROUP BY 1) a
JOIN (SELECT plant_uid, max(risk) - min(risk) AS spread FROM risk WHERE term = 'precip' GROUP BY 1) b USING (plant_uid) WHERE bands > 1 OR spread > 1e-9""", "bands", "risk")
def w6(spark, folder):
    s = samples(spark, folder)
    found = risk.scenario_invariance(risk.risk_bands(s), risk.risk_by_hazard(s, bounds(spark, folder)), "precip")
    return found.withColumn("spread", r("spread", 6))


@query("a10_layer_domains", """SELECT term, model, min(value) AS lo, max(value) AS hi, count(value) AS n FROM (SELECT r.term, CASE WHEN r.term IN ('heat', 'spei', 'precip') THEN d.model ELSE '-' END AS model,
CASE WHEN (p_partkey + r.a) % 31 <> 0 THEN ((p_partkey * r.a + p_size * 7 + CASE WHEN r.term = 'wind' THEN 0 ELSE c.s END * 11 + CASE WHEN r.term IN ('heat', 'spei', 'precip') THEN d.m ELSE 0 END * 5) % modulus) / divisor END AS value
FROM part CROSS JOIN rules r CROSS JOIN (SELECT * FROM scen) c CROSS JOIN mods d WHERE (r.term <> 'wind' OR c.s = 0) AND (r.term IN ('heat', 'spei', 'precip') OR d.m = 0)) GROUP BY ALL""", "rules", "scen", "mods")
def a10(spark, folder):
    return grid.domain(carriers.cells(spark, folder), "term", "model")


@query("f8_normalised_layer", """SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, round((v - lo) / (hi - lo), 9) AS scaled FROM (SELECT *, CASE WHEN raw = 100 THEN hi0 ELSE raw END AS v, lo0 AS lo, hi0 AS hi
FROM (SELECT *, min(CASE WHEN raw <> 100 THEN raw END) OVER () AS lo0, max(CASE WHEN raw <> 100 THEN raw END) OVER () AS hi0
FROM (SELECT p_partkey, CASE WHEN (p_partkey + 13) % 31 <> 0 THEN ((p_partkey * 13 + p_size * 7 + 11) % 101)::DOUBLE END AS raw FROM part)))""")
def f8(spark, folder):
    cells = carriers.cells(spark, folder).filter("term = 'ws' and scenario = 'bau'").withColumn("value", F.round(F.col("value") * 100.0, 6))
    found = grid.normalise(cells, grid.domain(cells, "term", sentinel=100.0), "term", sentinel=100.0)
    return found.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r("scaled", 9).alias("scaled"))


@query("j13_regrid", """SELECT t.id // 100 AS target_row, t.id % 100 AS target_col, CASE WHEN (p_partkey + 37) % 31 <> 0 THEN ((p_partkey * 37 + p_size * 7) % 71) / 1.5::DOUBLE END AS value
FROM (SELECT unnest(range((max(p_partkey) // 50 + 1) * 200)) AS id FROM part) t LEFT JOIN part ON p_partkey // 50 = floor((t.id // 100 + 0.5) * 0.5)::BIGINT AND p_partkey % 50 = floor((t.id % 100 + 0.5) * 0.5)::BIGINT""")
def j13(spark, folder):
    """All rows of the layer, which grow with the parts, at half the cell size."""
    cells = carriers.cells(spark, folder).filter("term = 'wind'").select("row", "col", "value")
    rows = cells.agg(F.max("row")).first()[0] + 1
    found = grid.regrid(cells, carriers.GRID, (0.0, 40.0, 0.5), (50.0, float(rows)))
    return found.select(F.col("target_row").cast("long").alias("target_row"), F.col("target_col").cast("long").alias("target_col"), "value")


@query("f_transforms", """SELECT term, water_scenario, model, plant_uid, round(least(greatest((value - lo) / (hi - lo), 0), 1), 8) AS direct,
round(least(greatest((ln(1 + greatest(value, 0)) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo)), 0), 1), 8) AS log1p FROM samples JOIN bounds USING (term) WHERE bound_model = CASE WHEN term IN ('heat', 'spei', 'precip') THEN model ELSE '-' END AND value IS NOT NULL""", "samples", "bounds")
def transforms(spark, folder):
    s = samples(spark, folder)
    b = F.broadcast(bounds(spark, folder).withColumnRenamed("term", "_t"))
    found = s.filter("value is not null").join(b, (F.col("term") == F.col("_t")) & (risk.bound_model() == F.col("bound_model")))
    return found.select("term", "water_scenario", "model", "plant_uid", r(X.minmax("value", F.col("lo"), F.col("hi")), 8).alias("direct"), r(X.log1p_minmax("value", F.col("lo"), F.col("hi")), 8).alias("log1p"))
