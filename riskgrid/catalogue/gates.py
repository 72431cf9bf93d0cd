"""Normalisation origin, correlation gate and threshold sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.operators import gate
from riskgrid.plans import carriers, ranks

from .base import counted, own_ids, query, r, samples

carriers.SQL["rules2"] = "tie(term_a, term_b, bucket, keep, crit) AS (VALUES " + ", ".join(str(x) for x in C.tie_breakers()) + ")"
carriers.SQL["gate"] = """pairs(term_a, term_b, gated, bucket, by_model) AS (VALUES ('precip', 'ws', true, 'hydro', true), ('precip', 'ws', true, 'thermal', true), ('precip', 'spei', true, 'hydro', true), ('sv', 'ws', true, 'hydro', false),
  ('sv', 'ws', true, 'thermal', false), ('iv', 'ws', true, 'hydro', false), ('iv', 'ws', true, 'thermal', false), ('sv', 'iv', true, 'hydro', false), ('sv', 'iv', true, 'thermal', false), ('ws', 'spei', false, 'hydro', true)),
xy AS (SELECT p.term_a, p.term_b, p.gated, p.bucket, CASE WHEN by_model THEN a.model ELSE 'not_model_dependent' END AS model, unnest([a.country, 'pooled']) AS country, a.value AS x, b.value AS y
  FROM pairs p JOIN samples a ON a.term = p.term_a AND a.bucket = p.bucket JOIN samples b ON b.term = p.term_b AND b.plant_uid = a.plant_uid AND b.water_scenario = a.water_scenario AND b.model = a.model
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND (by_model OR a.model = 'gfdl_esm4')),
rk AS (SELECT *, rank() OVER (PARTITION BY term_a, term_b, bucket, country, model ORDER BY x) + (count(*) OVER (PARTITION BY term_a, term_b, bucket, country, model, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY term_a, term_b, bucket, country, model ORDER BY y) + (count(*) OVER (PARTITION BY term_a, term_b, bucket, country, model, y) - 1) / 2 AS ry FROM xy),
st AS (SELECT term_a, term_b, gated, bucket, country, model, count(*) AS n, corr(x, y) AS pearson_r, corr(rx, ry) AS spearman_rho FROM rk GROUP BY ALL),
gate AS (SELECT st.*, coalesce(abs(spearman_rho) - abs(pearson_r) > 0.1, false) AS nonlinear, CASE WHEN nonlinear THEN spearman_rho ELSE pearson_r END AS decision_r,
  CASE WHEN country = 'pooled' THEN NULL WHEN NOT gated THEN 'report_only' WHEN decision_r IS NULL THEN 'insufficient_data' WHEN abs(decision_r) >= 0.8 THEN 'fail' ELSE 'pass' END AS verdict FROM st)"""
carriers.NEEDS["gate"] = ("samples",)
carriers.SQL["blended"] = """blended AS (SELECT s.* REPLACE (CASE WHEN term = 'iv' THEN 3 * w + 0.05::DOUBLE * value WHEN term = 'sv' THEN (w * w) * (w * w) * ((w * w) * (w * w)) + 0 * value WHEN term = 'precip' THEN value + 29 * w
  WHEN term = 'spei' AND country = 'ASIA' THEN 1 + 0 * value WHEN term = 'heat' THEN (value * value) * (value * value) ELSE value END AS value)
  FROM samples s JOIN (SELECT plant_uid, water_scenario, model, value AS w FROM samples WHERE term = 'ws') USING (plant_uid, water_scenario, model))"""
carriers.NEEDS["blended"] = ("samples",)
carriers.SQL["blended_gate"] = carriers.SQL["gate"].replace("JOIN samples", "JOIN blended")
for _a, _b in (("x", "y"), ("rx", "ry")):  # a side without spread has no correlation, where DuckDB's corr is not a number
    carriers.SQL["blended_gate"] = carriers.SQL["blended_gate"].replace(f"corr({_a}, {_b})", f"CASE WHEN count(*) >= 3 AND min({_a}) < max({_a}) AND min({_b}) < max({_b}) THEN corr({_a}, {_b}) END")
carriers.NEEDS["blended_gate"] = ("blended",)
GATED = """SELECT g.term_a, g.term_b, gated, g.bucket, country, model, n, round(pearson_r, 8) AS pearson_r, round(spearman_rho, 8) AS spearman_rho, nonlinear, verdict, CASE WHEN verdict = 'fail' THEN keep END AS retained,
CASE WHEN verdict = 'fail' THEN CASE WHEN keep = g.term_a THEN g.term_b ELSE g.term_a END END AS excluded, CASE WHEN verdict = 'fail' THEN crit END AS criterion FROM gate g LEFT JOIN tie USING (term_a, term_b, bucket)"""
ORIGIN = """SELECT term, bound_model, n, lo, hi, round(g, 6) AS skewness, CASE WHEN abs(g) > 0.5 THEN 'neg_log_minmax' ELSE 'direct_minmax' END AS transform FROM (SELECT term, bound_model, count(*) AS n, min(value) AS lo, max(value) AS hi,
avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS g FROM (SELECT term, CASE WHEN term IN ('heat', 'spei', 'precip') THEN model ELSE '-' END AS bound_model, value, avg(value) OVER (PARTITION BY term, bound_model) AS m FROM samples
WHERE value IS NOT NULL AND (term IN ('heat', 'spei', 'precip') OR model = 'gfdl_esm4')) GROUP BY 1, 2)"""
SWEPT = """SELECT g.term_a, g.term_b, g.bucket, country, model, threshold, CASE WHEN decision_r IS NULL THEN 'insufficient_data' WHEN abs(decision_r) >= threshold THEN 'fail' ELSE 'pass' END AS verdict_at, verdict_at <> verdict AS flipped
FROM gate g CROSS JOIN (SELECT unnest([0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90])::DOUBLE AS threshold) WHERE gated AND country <> 'pooled'"""


def blended(spark, folder):
    """Samples whose terms follow water stress closely (iv), steeply (sv) or in part (precip), with skewed heat and one region's drought constant, so that every verdict, flip and transform occurs."""
    return mixed(samples(spark, folder))


def mixed(s):
    keys = ["plant_uid", "water_scenario", "model"]
    w, v = F.col("w"), F.col("value")
    steep = (w * w) * (w * w) * ((w * w) * (w * w))
    terms = (
        F.when(F.col("term") == "iv", 3 * w + 0.05 * v).when(F.col("term") == "sv", steep + 0 * v).when(F.col("term") == "precip", v + 29 * w)
        .when((F.col("term") == "spei") & (F.col("country") == "ASIA"), 1 + 0 * v).when(F.col("term") == "heat", (v * v) * (v * v)).otherwise(v)
    )
    return s.join(s.filter("term = 'ws'").select(*keys, v.alias("w")), keys).withColumn("value", terms).drop("w")


def gated(spark, folder, change=lambda s: s, **more):
    """The gate over one plant a country, bucket and cell, counted; over every plant where ids are shared."""
    if own_ids(spark, folder):
        return gate.run_gate(change(counted(spark, folder, "country", "bucket")), weight=F.col("plants"), **more)
    return gate.run_gate(change(samples(spark, folder)), **more)


@query("c11_normalisation_origin", ORIGIN, "samples")
def c11(spark, folder):
    return gate.normalisation_origin(samples(spark, folder)).withColumn("skewness", r("skewness", 6))


@query("c12_correlation_gate", GATED, "gate", "rules2")
def c12(spark, folder):
    found = gated(spark, folder)
    return found.withColumns({"pearson_r": r("pearson_r", 8), "spearman_rho": r("spearman_rho", 8)}).drop("decision_r")


@query("c19_gate_sweep", SWEPT, "gate")
def c19(spark, folder):
    found = gate.sweep(gated(spark, folder))
    return found.select("term_a", "term_b", "bucket", "country", "model", "threshold", F.col("verdict").alias("verdict_at"), "flipped")


@query("c11_skewed_origins", ORIGIN.replace("FROM samples", "FROM blended"), "blended")
def c11s(spark, folder):
    return gate.normalisation_origin(blended(spark, folder)).withColumn("skewness", r("skewness", 6))


@query("c12_gate_decisions", GATED, "blended_gate", "rules2")
def c12d(spark, folder):
    found = gated(spark, folder, mixed)
    return found.withColumns({"pearson_r": r("pearson_r", 8), "spearman_rho": r("spearman_rho", 8)}).drop("decision_r")


@query("c19_gate_flips", SWEPT, "blended_gate")
def c19f(spark, folder):
    found = gate.sweep(gated(spark, folder, mixed))
    return found.select("term_a", "term_b", "bucket", "country", "model", "threshold", F.col("verdict").alias("verdict_at"), "flipped")


@query("w3_average_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank FROM lineitem")
def w3(spark, folder):
    from riskgrid.sources.tables import read_table

    rows = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return ranks.with_average_ranks(rows, {"avg_rank": "l_quantity"}, "l_returnflag").select("l_orderkey", "l_linenumber", "avg_rank")


@query("a39_grouping_sets", "SELECT term, model, coalesce(country, 'pooled') AS country, count(value) AS n, round(avg(value), 8) AS mean FROM samples GROUP BY GROUPING SETS ((term, model, country), (term, model))", "samples")
def a39(spark, folder):
    s = samples(spark, folder)
    found = s.groupingSets([["term", "model", "country"], ["term", "model"]], "term", "model", "country").agg(F.count("value").alias("n"), r(F.avg("value"), 8).alias("mean"))
    return found.withColumn("country", F.coalesce("country", F.lit("pooled")))
