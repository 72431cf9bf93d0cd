"""Result readers, rankings, registries, basin layers and composite reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.operators import assets, gate, grid, quality, report, risk, spatial
from riskgrid.plans import carriers
from riskgrid.sources import sinks
from riskgrid.sources.tables import read_table

from . import gates, places  # noqa: F401
from .base import bands, index, query, r, risks, samples

carriers.SQL["wide4"] = """wide4 AS (SELECT plant_uid, any_value(country) AS country, any_value(bucket) AS bucket, water_scenario, model, any_value(capacity_mw) AS capacity_mw, max(value) FILTER (term = 'ws') AS ws, max(value) FILTER (term = 'heat') AS heat, max(value) FILTER (term = 'sv') AS sv,
  max(value) FILTER (term = 'iv') AS iv FROM samples WHERE value IS NOT NULL AND term IN ('ws', 'heat', 'sv', 'iv') GROUP BY plant_uid, water_scenario, model HAVING count(*) = 4),
scored AS (SELECT *, 0.25::DOUBLE * (ln(1 + ws) - min(ln(1 + ws)) OVER m) / (max(ln(1 + ws)) OVER m - min(ln(1 + ws)) OVER m) + 0.25::DOUBLE * (ln(1 + heat) - min(ln(1 + heat)) OVER m) / (max(ln(1 + heat)) OVER m - min(ln(1 + heat)) OVER m)
  + 0.25::DOUBLE * (sv - min(sv) OVER m) / (max(sv) OVER m - min(sv) OVER m) + 0.25::DOUBLE * (iv - min(iv) OVER m) / (max(iv) OVER m - min(iv) OVER m) AS score FROM wide4 WINDOW m AS (PARTITION BY model)),
heated AS (SELECT s.*, CASE WHEN heat >= c THEN 'EXTREME' WHEN heat >= b THEN 'HIGH' WHEN heat >= a THEN 'MEDIUM' ELSE 'LOW' END AS heat_band FROM scored s JOIN (SELECT model, quantile_cont(heat, 0.25) AS a, quantile_cont(heat, 0.75) AS b, quantile_cont(heat, 0.95) AS c FROM scored GROUP BY 1) USING (model))"""
carriers.NEEDS["wide4"] = ("samples",)
_W, _CUTS = report.water_weights(), report.water_cuts()
carriers.SQL["watered"] = f"""watered AS (SELECT *, CASE WHEN s >= {_CUTS[3]} THEN 'Extremely High' WHEN s >= {_CUTS[2]} THEN 'High' WHEN s >= {_CUTS[1]} THEN 'Medium-High' WHEN s >= {_CUTS[0]} THEN 'Low-Medium' ELSE 'Low' END AS water_band
  FROM (SELECT *, ws * {_W["ws"]}::DOUBLE + sv * {_W["sv"]}::DOUBLE + iv * {_W["iv"]}::DOUBLE AS s FROM heated))"""
carriers.NEEDS["watered"] = ("wide4",)


@query("c25_hazard_scores", """SELECT plant_uid, water_scenario, model, round(score, 8) AS score, CASE WHEN score >= 0.647 THEN 'EXTREME' WHEN score >= 0.386 THEN 'HIGH' WHEN score >= 0.128 THEN 'MEDIUM' ELSE 'LOW' END AS band, heat_band FROM heated""", "wide4")
def c25(spark, folder):
    found = report.heat_bands(report.hazard_scores(samples(spark, folder)))
    return found.select("plant_uid", "water_scenario", "model", r("score", 8).alias("score"), "band", "heat_band")


@query("c25_water_heat_table", """SELECT country, model, water_band, heat_band, count(*) AS n, round(sum(coalesce(capacity_mw, 0)), 4) AS mw, round(sum(coalesce(capacity_mw, 0)) / sum(sum(coalesce(capacity_mw, 0))) OVER w, 8) AS share,
round(sum(CASE WHEN water_band IN ('High', 'Extremely High') AND heat_band IN ('HIGH', 'EXTREME') THEN sum(coalesce(capacity_mw, 0)) ELSE 0 END) OVER w / sum(sum(coalesce(capacity_mw, 0))) OVER w, 8) AS high_high,
round(sum(CASE WHEN water_band = 'Extremely High' AND heat_band = 'EXTREME' THEN sum(coalesce(capacity_mw, 0)) ELSE 0 END) OVER w / sum(sum(coalesce(capacity_mw, 0))) OVER w, 8) AS top_top FROM watered GROUP BY country, model, water_band, heat_band WINDOW w AS (PARTITION BY country, model)""", "watered")
def c25t(spark, folder):
    s = samples(spark, folder)
    found = report.water_heat_table(report.hazard_scores(s), report.water_bands(s))
    return found.withColumns({"mw": r("mw", 4)} | {c: r(c, 8) for c in ("share", "high_high", "top_top")})


@query("a32_matched_coverage", """SELECT country, model, round(sum(s.capacity_mw), 4) AS matched_mw, round(any_value(d), 4) AS declared_mw, round(sum(s.capacity_mw) / any_value(d), 8) AS matched_share FROM wide4 s JOIN (SELECT country, sum(capacity_mw) AS d FROM plants GROUP BY 1) USING (country) WHERE water_scenario = 'opt' GROUP BY 1, 2""", "wide4")
def a32c(spark, folder):
    found = report.matched_coverage(report.hazard_scores(samples(spark, folder)), carriers.plants(spark, folder))
    return found.withColumns({"matched_mw": r("matched_mw", 4), "declared_mw": r("declared_mw", 4), "matched_share": r("matched_share", 8)})


@query("c21_gate_matrix", "SELECT term_a || ' vs ' || term_b AS pair_label, gated, bucket, country, model, n, CASE WHEN nonlinear THEN 'spearman' ELSE 'pearson' END AS method, round(abs(decision_r), 8) AS strength, verdict FROM gate", "gate")
def c21g(spark, folder):
    return report.gate_matrix(gates.gated(spark, folder)).withColumn("strength", r("strength", 8))


@query("c21_invariant_wind", """SELECT bucket, risk_band, count(*) AS n, round(sum(capacity_mw), 4) AS mw FROM (SELECT plant_uid, any_value(bucket) AS bucket, min(risk_band) AS risk_band, any_value(capacity_mw) AS capacity_mw FROM bands WHERE term = 'wind' AND risk_band IS NOT NULL GROUP BY 1) GROUP BY 1, 2""", "bands")
def c21w(spark, folder):
    return report.invariant_band(bands(spark, folder)).withColumn("mw", r("mw", 4))


@query("c24_plant_against_grid", """SELECT term, model, water_scenario, p.n AS plants_known, round(p.p5, 8) AS plants_p5, round(p.p50, 8) AS plants_p50, round(p.p95, 8) AS plants_p95, plants, c.n AS cells_known, round(c.p5, 8) AS cells_p5, round(c.p50, 8) AS cells_p50, round(c.p95, 8) AS cells_p95, round(p.n / plants::DOUBLE, 9) AS match_rate
FROM (SELECT term, model, water_scenario, count(value) AS n, count(*) AS plants, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM samples WHERE term IN ('heat', 'spei', 'precip') GROUP BY 1, 2, 3) p
JOIN (SELECT term, model, water_scenario, count(v) AS n, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95 FROM (SELECT term, model, water_scenario, CASE WHEN (p_partkey + a) % 31 <> 0 THEN ((p_partkey * a + p_size * 7 + s * 11 + m * 5) % modulus) / divisor END AS v FROM part CROSS JOIN rules CROSS JOIN mods CROSS JOIN scen WHERE term IN ('heat', 'spei', 'precip')) GROUP BY 1, 2, 3) c USING (term, model, water_scenario)""", "samples")
def c24(spark, folder):
    own = samples(spark, folder).filter(F.col("term").isin(*C.MODEL_TERMS))
    cells = carriers.cells(spark, folder).filter(F.col("term").isin(*C.MODEL_TERMS)).withColumnRenamed("scenario", "water_scenario")
    found = report.plant_against_grid(own, cells, "term", "model", "water_scenario")
    return found.withColumns({c: r(c, 8) for c in found.columns if "_p" in c} | {"match_rate": r("match_rate", 9)})


@query("c24_two_hazards", """SELECT term_a, term_b, bucket, country, model, n, round(pearson_r, 8) AS pearson_r FROM gate WHERE term_a = 'precip' AND term_b = 'ws'""", "gate")
def c24h(spark, folder):
    found = gates.gated(spark, folder, pairs=tuple(p for p in C.PAIRS if p[:2] == ("precip", "ws")))
    return found.select("term_a", "term_b", "bucket", "country", "model", "n", r("pearson_r", 8).alias("pearson_r"))


@query("a13_water_thresholds", "SELECT term, water_scenario, round(avg((value >= CASE term WHEN 'ws' THEN 0.4 WHEN 'iv' THEN 0.665 ELSE 0.5 END::DOUBLE)::INTEGER), 9) AS share, count(value) AS n, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM samples WHERE term IN ('ws', 'iv', 'sv') GROUP BY 1, 2", "samples")
def a13w(spark, folder):
    found = report.water_thresholds(samples(spark, folder), "water_scenario")
    return found.select("term", "water_scenario", "n", *(r(c, 9).alias(c) for c in ("share", "p90", "p95", "p99")))


@query("s11_results_with_capacity", "SELECT r.plant_uid, r.term, r.water_scenario, r.model, p.capacity_mw FROM risk r LEFT JOIN (SELECT * FROM plants WHERE country <> 'ASIA') p USING (plant_uid)", "risk")
def s11(spark, folder):
    """Stored results without capacity, read again and joined with an inventory that lacks some plants."""
    stored = risks(spark, folder).select("plant_uid", "term", "water_scenario", "model")
    back = sinks.read_csv(spark, sinks.write_csv(stored, sinks.scratch(spark)), stored.schema)
    return report.with_capacity(back, carriers.plants(spark, folder).filter("country <> 'ASIA'"))


@query("w7_plant_places", "SELECT plant_uid, lon, lat FROM plants", "plants")
def w7(spark, folder):
    return report.plant_places(samples(spark, folder))


@query("s2_read_plants", """SELECT upper(substr(r_name, 1, 3)) || '-' || substr(sha256(c_name || chr(31) || c_nationkey || '.5' || chr(31) || c_custkey % 50 || '.0'), 1, 12) AS plant_uid, c_name AS plant_name, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS capacity_mw, c_custkey % 4 = 1 AS mixed_fuel_type
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def s2(spark, folder):
    k = F.col("c_custkey")
    nation = read_table(spark, folder, "nation").join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = read_table(spark, folder, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("country"), F.col("c_name").alias("plant_name"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".5")).alias("lat"), F.concat((k % 50).cast("string"), F.lit(".0")).alias("lon"),
        F.when(k % 9 == 0, F.when(k % 2 == 0, "n/a").otherwise("NaN")).otherwise(F.col("c_acctbal").cast("string")).alias("capacity_mw"), F.lit("x").alias("commissioning_year"), F.lit("coal").alias("fuel_type"),
        F.when(k % 4 == 1, "true").when(k % 4 == 2, "false").when(k % 4 == 3, "perhaps").alias("mixed_fuel_type"), F.lit("thermal").alias("bucket"),
    )
    return assets.read_plants(raw).select("plant_uid", "plant_name", "capacity_mw", "mixed_fuel_type")


@query("f21_colliding_ids", "SELECT s_nationkey % 9 AS id, count(DISTINCT (s_nationkey, s_suppkey % 3)) AS field_sets FROM supplier GROUP BY 1 HAVING count(DISTINCT (s_nationkey, s_suppkey % 3)) > 1")
def f21(spark, folder):
    rows = read_table(spark, folder, "supplier").select((F.col("s_nationkey") % 9).alias("id"), "s_nationkey", (F.col("s_suppkey") % 3).alias("part"))
    return quality.colliding_ids(rows, "id", "s_nationkey", "part")


@query("p10_disputed", "SELECT r_name AS country, bool_or(n_nationkey % 10 = 7) AS disputed FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def p10(spark, folder):
    areas = read_table(spark, folder, "nation").join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.when(F.col("n_nationkey") % 10 == 7, "Z01.14_1").otherwise(F.concat(F.substring("n_name", 1, 2), F.lit("Z.1_1")))
    return assets.disputed(areas.select(F.col("r_name").alias("country"), code.alias("gid")))


@query("w11_country_ranks", """SELECT country, water_scenario, model, round(m, 9) AS mean_index, rank() OVER (PARTITION BY water_scenario, model ORDER BY m DESC NULLS LAST)::INTEGER AS rank FROM (SELECT country, water_scenario, model, sum(index_value * capacity_mw) / sum(capacity_mw) FILTER (index_value IS NOT NULL) AS m FROM idx GROUP BY 1, 2, 3)""", "idx")
def w11(spark, folder):
    return report.country_ranks(index(spark, folder)).withColumn("mean_index", r("mean_index", 9))


@query("a17_weighted_mean", "SELECT bucket, term, model, round(sum(hazard * capacity_mw) / sum(capacity_mw) FILTER (hazard IS NOT NULL), 9) AS mean FROM risk GROUP BY 1, 2, 3", "risk")
def a17(spark, folder):
    return risks(spark, folder).groupBy("bucket", "term", "model").agg(r(X.weighted_mean("hazard", "capacity_mw"), 9).alias("mean"))


@query("o2_by_absolute", "SELECT o_orderpriority, total, rank() OVER (ORDER BY abs(total) DESC NULLS LAST)::INTEGER AS place FROM (SELECT o_orderpriority, round(sum(o_totalprice - mean), 2) AS total FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS mean FROM orders) GROUP BY 1)")
def o2(spark, folder):
    """Priorities by how far their orders' total lies from what the mean price gives, above or below."""
    orders = read_table(spark, folder, "orders")
    mean = F.broadcast(orders.agg(F.avg("o_totalprice").alias("mean")))
    rows = orders.crossJoin(mean).groupBy("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice") - F.col("mean")), 2).alias("total"))
    return report.by_absolute(rows, "total")


@query("o5_long_samples", "SELECT plant_uid, water_scenario, model, term, value FROM samples", "samples")
def o5(spark, folder):
    keys = ("plant_uid", "water_scenario", "model")
    return grid.long(grid.wide(samples(spark, folder), *keys), *keys)


@query("f9_display_exposure", "SELECT plant_uid, round(log10(greatest(capacity_mw, 0) + 1), 9) AS exposure_log10_display FROM plants WHERE capacity_mw IS NOT NULL UNION ALL SELECT plant_uid, NULL FROM plants WHERE capacity_mw IS NULL", "plants")
def f9(spark, folder):
    return risk.display_exposure(carriers.plants(spark, folder)).select("plant_uid", r(risk.DISPLAY, 9).alias(risk.DISPLAY))


@query("f7_named_transforms", """SELECT plant_uid, term, water_scenario, model, round(CASE WHEN value IS NULL THEN NULL WHEN abs(g) > 0.5 THEN least(greatest(-ln(1 - least(greatest((value - lo) / (hi + 0.05::DOUBLE * (hi - lo) - lo), 0), 1 - 1e-9::DOUBLE)) / ln(1 + 1 / 0.05::DOUBLE), 0), 1) + 0.0::DOUBLE
ELSE (value - lo) / (hi - lo) END, 7) AS scaled FROM (SELECT s.*, lo, hi, b.bound_model FROM samples s JOIN bounds b ON b.term = s.term AND b.bound_model = CASE WHEN s.term IN ('heat', 'spei', 'precip') THEN s.model ELSE '-' END)
JOIN (SELECT term, bound_model, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS g FROM (SELECT term, CASE WHEN term IN ('heat', 'spei', 'precip') THEN model ELSE '-' END AS bound_model, value, avg(value) OVER (PARTITION BY term, bound_model) AS m FROM samples
WHERE value IS NOT NULL AND (term IN ('heat', 'spei', 'precip') OR model = 'gfdl_esm4')) GROUP BY 1, 2) USING (term, bound_model)""", "samples", "bounds")
def f7(spark, folder):
    """Each term scaled to its own range by the transform that its skewness names."""
    s = samples(spark, folder)
    chosen = gate.normalisation_origin(s).select("term", "bound_model", "transform", "lo", "hi").withColumnRenamed("term", "_t")
    joined = s.join(F.broadcast(chosen), (F.col("term") == F.col("_t")) & (risk.bound_model() == F.col("bound_model")))
    return joined.select("plant_uid", "term", "water_scenario", "model", r(X.transform("transform", "value", F.col("lo"), F.col("hi")), 7).alias("scaled"))


@query("q8_registry_conflicts", """WITH app AS (SELECT DISTINCT bucket, term FROM applicable), ruled AS (SELECT DISTINCT bucket, term FROM samples WHERE value >= 10 AND plant_uid < 'AM'), kinds AS (SELECT DISTINCT coalesce(fuel_type, bucket) AS bucket FROM plants),
gone AS (SELECT term FROM samples GROUP BY term HAVING max(value) < 5)
SELECT bucket, term, 'applicable without a rule' AS problem FROM app ANTI JOIN ruled USING (bucket, term) UNION ALL SELECT bucket, term, 'rule that isn''t applicable' FROM ruled ANTI JOIN app USING (bucket, term)
UNION ALL SELECT bucket, NULL, 'bucket without a hazard' FROM kinds ANTI JOIN app USING (bucket) UNION ALL SELECT bucket, term, 'excluded hazard' FROM app SEMI JOIN gone USING (term)""".replace("WITH app", "SELECT * FROM (WITH app", 1) + ")", "samples", "applicable")
def q8(spark, folder):
    """Rules for what one region's samples reach, buckets named as the plants' fuels are, and terms ruled out whose samples stay low, against the registry."""
    s = samples(spark, folder)
    applicable = spark.createDataFrame(C.applicability(), "bucket string, term string, pos int, size int").select("bucket", "term")
    rules = s.filter("value >= 10 and plant_uid < 'AM'").select("bucket", "term")
    wanted = carriers.plants(spark, folder).select(F.coalesce("fuel_type", "bucket").alias("bucket"))
    excluded = s.groupBy("term").agg(F.max("value").alias("most")).filter("most < 5").select("term")
    return quality.registry_conflicts(rules, applicable, excluded, wanted)


Q10 = """SELECT t AS name, 'no column ' || c AS problem FROM (SELECT unnest(['events', 'part', 'orders', 'supplier']) AS t) CROSS JOIN (SELECT unnest(['event_id', 'ts', 'value']) AS c) WHERE NOT EXISTS (SELECT 1 FROM duckdb_columns() d WHERE d.table_name = t AND d.column_name = c)
UNION ALL SELECT 'events', 'no row' WHERE NOT EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'part', 'no row' WHERE NOT EXISTS (SELECT 1 FROM part) UNION ALL SELECT 'orders', 'no row' WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > (SELECT 2 * max(o_totalprice) FROM orders))
UNION ALL SELECT 'supplier', 'no row' WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < (SELECT avg(c_acctbal) FROM customer))"""


@query("q10_usable_tables", Q10)
def q10(spark, folder):
    """Tables with all columns and rows, without some columns, and with no row beyond a limit that the data set."""
    orders, customer = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    most, mean = F.broadcast(orders.agg(F.max("o_totalprice").alias("most"))), F.broadcast(customer.agg(F.avg("c_acctbal").alias("mean")))
    tables = {
        "events": read_table(spark, folder, "events"), "part": read_table(spark, folder, "part"), "orders": orders.crossJoin(most).filter("o_totalprice > 2 * most"),
        "supplier": read_table(spark, folder, "supplier").crossJoin(mean).filter("s_acctbal < mean"),
    }
    found = [quality.usable_table(t, "event_id", "ts", "value").withColumn("name", F.lit(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("a37_first_step", "SELECT y AS year, round(count(*) FILTER (event_id % 7 <> 0) / count(*)::DOUBLE, 9) AS share, count(*) AS rows FROM (SELECT *, event_id % 30 + 2041 AS y FROM events) WHERE y = 2041 GROUP BY 1")
def a37(spark, folder):
    k = F.col("event_id")
    return quality.first_step_share(read_table(spark, folder, "events").select((k % 30 + 2041).alias("year"), F.when(k % 7 == 0, F.when(k % 2 == 0, float("nan"))).otherwise(F.col("value")).alias("value"))).withColumn("share", r("share", 9))


@query("w5_rank_one_bucket", "SELECT plant_uid, water_scenario, model, rank() OVER (PARTITION BY water_scenario, model ORDER BY index_value DESC NULLS LAST)::INTEGER AS rank FROM idx WHERE bucket = 'hydro'", "idx")
def w5(spark, folder):
    return risk.rank_within_bucket(index(spark, folder).filter("bucket = 'hydro'"), "hydro", only=True).select("plant_uid", "water_scenario", "model", "rank")


@query("s4_ceiling", "SELECT n_nationkey AS poly_id, n_nationkey / 2.0::DOUBLE AS bau, CASE WHEN n_nationkey % 3 = 0 THEN 9999.0::DOUBLE ELSE 50.0::DOUBLE END AS opt FROM nation")
def s4(spark, folder):
    """Values at the ceiling and sentinels beyond it pass; tests cover the raise."""
    k = F.col("poly_id")
    wide = places.polygons(spark, folder).select("poly_id", "rings", (k / 2.0).alias("bau50_sv_x_r"), F.when(k % 3 == 0, 9999.0).otherwise(50.0).alias("opt50_sv_x_r"))
    return spatial.read_basins(wide, "sv", ("opt", "bau")).drop("rings")


BASIN = f"""WITH {{polys}}, val AS (SELECT n_nationkey AS poly_id, s AS scenario, CASE WHEN n_nationkey % 4 = 1 AND s = 'opt' THEN 9999.0::DOUBLE WHEN n_nationkey % 6 = 5 AND s = 'pes' THEN NULL ELSE n_nationkey % 11 + CASE s WHEN 'opt' THEN 0.5 WHEN 'bau' THEN 1.25 ELSE 3 END END::DOUBLE AS v
FROM nation CROSS JOIN (SELECT unnest(['opt', 'bau', 'pes']) AS s) WHERE n_nationkey % 8 <> 0), span AS (SELECT min(v) AS lo, max(v) AS hi FROM val WHERE v <> 9999),
{carriers.SQL["fine"]}, hit AS (SELECT row, col, max(poly_id) AS poly_id FROM ({places.BURNT}) WHERE poly_id % 8 <> 0 GROUP BY 1, 2)
SELECT s AS scenario, c.row, c.col, CASE WHEN v = 9999 THEN hi ELSE v END AS value, round((CASE WHEN v = 9999 THEN hi ELSE v END - lo) / (hi - lo), 9) AS scaled FROM centre c CROSS JOIN (SELECT unnest(['opt', 'bau', 'pes']) AS s)
LEFT JOIN hit USING (row, col) LEFT JOIN val ON val.poly_id = hit.poly_id AND scenario = s CROSS JOIN span"""


@query("c6_basin_layer", BASIN.replace("{polys}", carriers.SQL["polys"]))
def c6(spark, folder):
    k = F.col("poly_id")
    table = places.polygons(spark, folder).select(
        "poly_id", F.when(k % 8 != 0, F.col("rings")).alias("rings"), F.when(k % 4 == 1, 9999.0).otherwise(k % 11 + 0.5).alias("opt50_ws_x_r"), (k % 11 + 1.25).alias("bau50_ws_x_r"),
        F.when(k % 6 != 5, k % 11 + 3.0).alias("pes50_ws_x_r"),
    )
    found = spatial.basin_layer(table, *places.fine_grid(spark, folder))
    return found.select("scenario", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value", r("scaled", 9).alias("scaled"))


@query("j14_inside_largest", """WITH {polys}, tops AS (SELECT n_regionkey AS country_id, n_nationkey AS k FROM nation) SELECT poly_id FROM polys JOIN tops ON k = poly_id WHERE x0 + CASE WHEN poly_id % 6 = 0 THEN 31 / 7.0 ELSE 5 END BETWEEN country_id * 8 AND country_id * 8 + 20 AND
  y0 + CASE WHEN poly_id % 6 = 0 THEN 29 / 7.0 ELSE 4.5 END BETWEEN 0 AND 30""".replace("{polys}", carriers.SQL["polys"]))
def j14(spark, folder):
    """Countries of two boxes each; areas stay where the mean of their vertices lies in the larger one."""
    k = F.col("n_regionkey").cast("double")
    corner = lambda x, y: F.struct((k * 8.0 + x).alias("x"), F.lit(float(y)).alias("y"))
    big = F.array(corner(0, 0), corner(20, 0), corner(20, 30), corner(0, 30))
    islet = F.array(corner(30, 0), corner(32, 0), corner(32, 40), corner(30, 40))
    countries = read_table(spark, folder, "nation").select("n_regionkey").distinct().select(F.col("n_regionkey").alias("poly_id"), F.array(islet, big).alias("rings"))
    of = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("poly_id"), F.col("n_regionkey").alias("country_id"))
    return spatial.inside_largest_part(places.polygons(spark, folder).join(of, "poly_id"), countries).select("poly_id")
