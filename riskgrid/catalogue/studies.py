"""Draws, recomputation, Monte Carlo, variance-based and one-at-a-time studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.operators import risk, sensitivity
from riskgrid.plans import carriers
from riskgrid.sources.tables import read_table

from .base import ORACLES, bands, index, query, r, samples

SEED = "20260915"
U = "('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def sql_draw(key: str, name: str, lo: float, hi: float) -> str:
    return f"{lo}::DOUBLE + {U.format(key=key)} * ({hi}::DOUBLE - {lo}::DOUBLE) AS {name}"


carriers.SQL["streams"] = "streams AS (SELECT DISTINCT country, water_scenario FROM plants CROSS JOIN scen)"
carriers.NEEDS["streams"] = ("plants", "scen")
carriers.SQL["draws"] = "draws AS (SELECT country, water_scenario, id AS draw, " + ", ".join(sql_draw(f"'{SEED}|' || country || '|' || water_scenario || '|general_mc|' || id || '|{n}'", n, lo, hi) for n, lo, hi in C.PARAMETERS) + " FROM streams CROSS JOIN range(50) t(id))"
carriers.NEEDS["draws"] = ("streams",)
_AB = {m: ", ".join(sql_draw(f"'{SEED}|{m}|' || id || '|{n}'", f"{m}_{n}", lo, hi) for n, lo, hi in C.PARAMETERS) for m in "AB"}
carriers.SQL["saltelli"] = (
    f"base AS (SELECT id AS draw, {_AB['A']}, {_AB['B']} FROM range(16) t(id)),\nmats(matrix) AS (VALUES " + ", ".join(f"('{m}')" for m in ("A", "B", *sensitivity.NAMES)) + "),\n"
    "saltelli AS (SELECT draw, matrix, " + ", ".join(f"CASE WHEN matrix IN ('B', '{n}') THEN B_{n} ELSE A_{n} END AS {n}" for n in sensitivity.NAMES) + " FROM base CROSS JOIN mats)"
)


def sql_recompute(draws: str, keys: str, on: str, strata: str = "", risk_strata: str = "") -> str:
    """Row-by-row recomputation: every sample row meets every draw (the naive plan)."""
    shift = "CASE s.term " + " ".join(f"WHEN '{t}' THEN {t}_percentile_shift" for t in ("spei", "precip", "heat", "sv", "iv")) + " ELSE least(wind_percentile_shift, 0.5) END"
    coal = "CASE WHEN y <= 0 THEN 1 ELSE 1 - floor(y / cyc) * (1 - rec) * dec * cyc - dec * (y - floor(y / cyc) * cyc) END"
    return f"""pool AS (SELECT term, model, list_sort(list(value)) AS v FROM samples WHERE value IS NOT NULL GROUP BY ALL),
cutd AS (SELECT {keys}, s.term, s.model, least(greatest(CASE WHEN s.term = 'wind' THEN 95 ELSE 90 END + {shift}, 0), 100) / 100.0::DOUBLE * (len(v) - 1) AS pos_,
  v[floor(pos_)::BIGINT + 1] + (pos_ - floor(pos_)) * (v[ceil(pos_)::BIGINT + 1] - v[floor(pos_)::BIGINT + 1]) AS cut FROM {draws} d CROSS JOIN pool s WHERE s.term <> 'ws'),
full_ AS (SELECT s.*, a.size FROM samples s JOIN applicable a USING (bucket, term) WHERE (plant_uid, water_scenario, model) NOT IN (SELECT (plant_uid, water_scenario, model) FROM samples JOIN applicable USING (bucket, term) WHERE value IS NULL)),
im AS (SELECT {keys}{strata}, f.model, sum(CASE WHEN CASE WHEN f.term = 'ws' THEN value >= 0.4 WHEN f.bucket = 'wind' THEN value >= 25 ELSE value >= cut END THEN 1.0::DOUBLE / size ELSE 0 END) / sum(1.0::DOUBLE / size) AS index_mean
  FROM full_ f JOIN {draws} d ON {on} LEFT JOIN cutd c ON c.term = f.term AND c.model = f.model AND {' AND '.join(f'c.{k.strip().split(".")[1]} = {k.strip()}' for k in keys.split(','))} GROUP BY {keys}{strata}, f.model),
age_ AS (SELECT f.*, d.*, 2050 - commissioning_year AS y, coal_decay_rate AS dec, coal_overhaul_cycle_years AS cyc, coal_overhaul_recovery AS rec, lo, hi FROM (SELECT * EXCLUDE (country, water_scenario), country AS c0, water_scenario AS w0 FROM samples WHERE value IS NOT NULL AND capacity_mw IS NOT NULL) f
  JOIN (SELECT * FROM {draws}) d ON {on.replace('f.country', 'f.c0').replace('f.water_scenario', 'f.w0')} JOIN bounds b ON b.term = f.term AND b.bound_model = CASE WHEN f.term IN ('heat', 'spei', 'precip') THEN f.model ELSE '-' END),
rm AS (SELECT {keys.replace('d.', '')}{risk_strata}, model, sum(capacity_mw * capacity_mw * h * g) / sum(capacity_mw) AS risk_mean FROM (SELECT *, CASE WHEN term IN ('ws', 'heat', 'wind') THEN
  least(greatest(-ln(1 - least(greatest((value - lo) / (hi + upper_tail_padding_fraction * (hi - lo) - lo), 0), 1 - 1e-9::DOUBLE)) / ln(1 + 1 / upper_tail_padding_fraction), 0), 1) ELSE least(greatest((value - lo) / (hi - lo), 0), 1) END AS h,
  {coal} AS coal, CASE WHEN y IS NULL THEN 1 WHEN bucket = 'hydro' THEN 2 - least(greatest(1 - hydro_retention_rate * y, 0), 1) WHEN bucket = 'wind' THEN 2 - least(greatest(1 - wind_relative_rate * y, 0), 1)
  WHEN bucket = 'solar' THEN 2 - least(greatest(pow(1 - solar_retention_rate, y), 0), 1) WHEN mixed_fuel_type THEN (3 - least(greatest(coal, 0), 1)) / 2 WHEN fuel_type = 'coal' THEN 2 - least(greatest(coal, 0), 1) ELSE 1.0 END AS g FROM age_) GROUP BY ALL)"""


MC = sql_recompute("draws", "d.country, d.water_scenario, d.draw", "f.country = d.country AND f.water_scenario = d.water_scenario")
carriers.SQL["mc"] = MC + ",\nmc AS (SELECT * FROM rm JOIN im USING (country, water_scenario, draw, model))"
carriers.NEEDS["mc"] = ("samples", "applicable", "bounds", "draws")
carriers.SQL["sob"] = sql_recompute("saltelli", "d.draw, d.matrix", "true") + ",\nsob AS (SELECT * FROM rm JOIN im USING (draw, matrix, model))"
carriers.NEEDS["sob"] = ("samples", "applicable", "bounds", "saltelli")


def streams(s: DataFrame) -> DataFrame:
    return s.select("country", "water_scenario").distinct()


def monte_carlo(spark, folder, n: int = 50) -> DataFrame:
    s = samples(spark, folder)
    return sensitivity.recompute(s, risk.global_bounds(s), sensitivity.stream_draws(spark, streams(s), n), ("draw",), ("country", "water_scenario"))


def sobol(spark, folder, n0: int = 16) -> DataFrame:
    s = samples(spark, folder)
    return sensitivity.recompute(s, risk.global_bounds(s), sensitivity.saltelli_draws(spark, n0), ("draw", "matrix"))


@query("f30_stream_draws", "SELECT country, water_scenario, draw, round(coal_decay_rate, 12) AS coal_decay_rate, round(wind_percentile_shift, 9) AS wind_percentile_shift FROM draws", "draws")
def f30(spark, folder):
    found = sensitivity.stream_draws(spark, streams(carriers.plants(spark, folder).crossJoin(F.broadcast(carriers.scenario_keys(spark).select("water_scenario").distinct()))), 50)
    return found.select("country", "water_scenario", "draw", r("coal_decay_rate", 12).alias("coal_decay_rate"), r("wind_percentile_shift", 9).alias("wind_percentile_shift"))


@query("c17_recompute", "SELECT country, water_scenario, draw, model, round(risk_mean, 6) AS risk_mean, round(index_mean, 9) AS index_mean FROM mc", "mc")
def c17(spark, folder):
    return monte_carlo(spark, folder).select("country", "water_scenario", "draw", "model", r("risk_mean", 6).alias("risk_mean"), r("index_mean", 9).alias("index_mean"))


@query("c15_monte_carlo", """SELECT country, water_scenario, model, count(*) AS n, round(avg(risk_mean), 6) AS mean, round(quantile_cont(risk_mean, 0.025), 5) AS ci_low, round(quantile_cont(risk_mean, 0.975), 5) AS ci_high, round(stddev_samp(risk_mean) / sqrt(count(*)), 6) AS mcse,
abs(stddev_samp(risk_mean) / sqrt(count(*)) / avg(risk_mean)) * 100 < 5 AS converged FROM mc GROUP BY 1, 2, 3""", "mc")
def c15(spark, folder):
    found = sensitivity.summaries(monte_carlo(spark, folder), "risk_mean", "country", "water_scenario", "model")
    return found.select("country", "water_scenario", "model", "n", r("mean").alias("mean"), r("ci_low", 5).alias("ci_low"), r("ci_high", 5).alias("ci_high"), r("mcse").alias("mcse"), "converged")


@query("w8_convergence", """SELECT *, min(step) FILTER (converged) OVER (PARTITION BY country, water_scenario, model) AS first_converged, max(step) OVER (PARTITION BY country, water_scenario, model) AS last_step FROM (SELECT country, water_scenario, model, step, round(m, 9) AS mean,
round(abs((m - lag(m) OVER w) / lag(m) OVER w), 8) AS change, converged FROM (SELECT country, water_scenario, model, step, avg(index_mean) AS m, coalesce(abs(stddev_samp(index_mean) / sqrt(count(*)) / avg(index_mean)) * 100 < 5, false) AS converged
FROM mc CROSS JOIN (SELECT unnest([10, 20, 50])::INTEGER AS step) WHERE draw < step GROUP BY ALL) WINDOW w AS (PARTITION BY country, water_scenario, model ORDER BY step))""", "mc")
def w8(spark, folder):
    found = sensitivity.convergence(monte_carlo(spark, folder), "index_mean", (10, 20, 50), "country", "water_scenario", "model")
    return found.select("country", "water_scenario", "model", "step", r("mean", 9).alias("mean"), r("change", 8).alias("change"), "converged", "first_converged", "last_step")


@query("c16_sobol_evaluations", "SELECT draw, matrix, model, round(risk_mean, 6) AS risk_mean, round(index_mean, 9) AS index_mean FROM sob", "sob")
def c16e(spark, folder):
    return sobol(spark, folder).select("draw", "matrix", "model", r("risk_mean", 6).alias("risk_mean"), r("index_mean", 9).alias("index_mean"))


def sql_indices(value: str, by: str, source: str = "sob") -> str:
    """Saltelli's and Jansen's estimators on standardised outputs, with half-widths over hashed Poisson weights."""
    on = " AND ".join(f"{{0}}.{c.strip()} = {{1}}.{c.strip()}" for c in by.split(","))
    u = U.format(key="'7|' || copy || '|' || draw")
    steps = " + ".join(f"CASE WHEN {u} > {p} THEN 1.0::DOUBLE ELSE 0 END" for p in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317))
    own = ", ".join(f"x.{c.strip()}" for c in by.split(","))
    return f"""mom AS (SELECT {by}, avg({value}) AS m, stddev_pop({value}) AS sd FROM {source} WHERE matrix IN ('A', 'B') GROUP BY ALL),
trio AS (SELECT x.matrix AS param, {own}, x.draw, (x.{value} - m) / sd AS ab, (a.{value} - m) / sd AS a, (b.{value} - m) / sd AS b FROM {source} x JOIN {source} a ON a.matrix = 'A' AND a.draw = x.draw AND {on.format("a", "x")}
  JOIN {source} b ON b.matrix = 'B' AND b.draw = x.draw AND {on.format("b", "x")} JOIN mom ON {on.format("mom", "x")} WHERE x.matrix NOT IN ('A', 'B')),
wt AS (SELECT *, CASE WHEN copy = 0 THEN 1.0::DOUBLE ELSE {steps} END AS k FROM trio CROSS JOIN range(51) c(copy)),
rep AS (SELECT param, {by}, copy, sum(k * (a * a + b * b)) / (2 * sum(k)) - pow(sum(k * (a + b)) / (2 * sum(k)), 2) AS v, sum(k * b * (ab - a)) / sum(k) / v AS s1, 0.5 * sum(k * (a - ab) * (a - ab)) / sum(k) / v AS st FROM wt GROUP BY param, {by}, copy)
SELECT param, {by}, round(max(s1) FILTER (copy = 0), 5) + 0.0 AS s1, round(1.96 * stddev_samp(s1) FILTER (copy > 0), 5) AS s1_conf, round(max(st) FILTER (copy = 0), 5) AS st, round(1.96 * stddev_samp(st) FILTER (copy > 0), 5) AS st_conf FROM rep GROUP BY param, {by}"""


def _indices(found: DataFrame, *by: str) -> DataFrame:
    return found.select("param", *by, *(r(c, 5).alias(c) for c in ("s1", "s1_conf", "st", "st_conf")))


def own_query(name: str, needs: tuple[str, ...], tail: str):
    """Register a query whose oracle goes on with further common table expressions."""

    def keep(f):
        query(name)(f)
        ORACLES[name] = carriers.with_sql("", *needs).rstrip() + ",\n" + tail
        return f

    return keep


@own_query("c16_sobol_indices", ("sob",), sql_indices("risk_mean", "model"))
def c16(spark, folder):
    return _indices(sensitivity.sobol_indices(sobol(spark, folder), "risk_mean", ("model",)), "model")


@own_query("c16_sobol_of_index", ("sob",), sql_indices("index_mean", "model"))
def c16i(spark, folder):
    return _indices(sensitivity.sobol_indices(sobol(spark, folder), "index_mean", ("model",)), "model")


carriers.SQL["sobs"] = sql_recompute("saltelli", "d.draw, d.matrix", "true", ", f.country, f.bucket", ", c0 AS country, bucket") + ",\nsobs AS (SELECT * FROM rm JOIN im USING (draw, matrix, country, bucket, model))"
carriers.NEEDS["sobs"] = ("samples", "applicable", "bounds", "saltelli")


def sobol_strata(spark, folder, n0: int = 16) -> DataFrame:
    s = samples(spark, folder)
    return sensitivity.recompute(s, risk.global_bounds(s), sensitivity.saltelli_draws(spark, n0), ("draw", "matrix"), strata=("country", "bucket"))


@query("c17_by_stratum", "SELECT draw, matrix, country, bucket, model, round(risk_mean, 6) AS risk_mean, round(index_mean, 9) AS index_mean FROM sobs", "sobs")
def c17s(spark, folder):
    return sobol_strata(spark, folder).select("draw", "matrix", "country", "bucket", "model", r("risk_mean", 6).alias("risk_mean"), r("index_mean", 9).alias("index_mean"))


@own_query("c16_sobol_by_stratum", ("sobs",), sql_indices("risk_mean", "country, bucket, model", "sobs"))
def c16s(spark, folder):
    """Strata without a value in some draw are left out; q6 lists them."""
    return _indices(sensitivity.sobol_indices(sobol_strata(spark, folder), "risk_mean", ("country", "bucket", "model")), "country", "bucket", "model")


@query("q6_missing_strata", """SELECT country, bucket, count(index_mean) AS known FROM (SELECT DISTINCT r_name AS country FROM region) CROSS JOIN (SELECT unnest(['hydro', 'thermal', 'wind', 'solar', 'tidal']) AS bucket) LEFT JOIN sobs USING (country, bucket) GROUP BY ALL HAVING count(index_mean) = 0""", "sobs")
def q6(spark, folder):
    from riskgrid.operators import quality

    kinds = spark.createDataFrame([(b,) for b in (*C.BUCKETS, "tidal")], "bucket string")
    expected = read_table(spark, folder, "region").select(F.col("r_name").alias("country")).crossJoin(F.broadcast(kinds))
    return quality.missing_strata(sobol_strata(spark, folder), expected, "index_mean", "country", "bucket").select("country", "bucket", "known")


@query("c15_pooled", """SELECT country, water_scenario, count(*) AS n, round(avg(index_mean), 9) AS mean, round(quantile_cont(index_mean, 0.025), 8) AS ci_low, round(quantile_cont(index_mean, 0.975), 8) AS ci_high, round(stddev_samp(index_mean) / sqrt(count(*)), 9) AS mcse,
abs(stddev_samp(index_mean) / sqrt(count(*)) / avg(index_mean)) * 100 < 5 AS converged FROM mc GROUP BY 1, 2""", "mc")
def c15p(spark, folder):
    """Both models' draws as one sample of a stream."""
    found = sensitivity.summaries(monte_carlo(spark, folder), "index_mean", "country", "water_scenario")
    return found.select("country", "water_scenario", "n", r("mean", 9).alias("mean"), r("ci_low", 8).alias("ci_low"), r("ci_high", 8).alias("ci_high"), r("mcse", 9).alias("mcse"), "converged")


carriers.SQL["removal"] = """gone AS (SELECT DISTINCT bucket, term AS removed FROM applicable WHERE size > 1 UNION ALL SELECT DISTINCT bucket, 'none' FROM applicable WHERE size > 1),
rem AS (SELECT b.plant_uid, b.water_scenario, b.model, g.removed, any_value(b.bucket) AS bucket, any_value(b.country) AS country, any_value(b.capacity_mw) AS mw, CASE WHEN count(*) = count(b.risk_band) THEN count(*) FILTER (b.risk_band IN ('High', 'Extreme')) / count(*)::DOUBLE END AS v
  FROM bands b JOIN gone g ON b.bucket = g.bucket AND b.term <> g.removed GROUP BY 1, 2, 3, 4),
lab AS (SELECT *, CASE WHEN v >= 1 THEN 'EXTREME' WHEN v >= 0.5 THEN 'HIGH' WHEN v > 0 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM rem WHERE v IS NOT NULL),
shares AS (SELECT t.*, l.label, coalesce(sum(mw) FILTER (x.label = l.label), 0) / any_value(total) AS share FROM (SELECT bucket, country, water_scenario, model, removed, sum(mw) AS total FROM lab GROUP BY ALL) t CROSS JOIN (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'EXTREME']) AS label) l
  JOIN lab x USING (bucket, country, water_scenario, model, removed) GROUP BY ALL)"""
carriers.NEEDS["removal"] = ("bands",)


@query("c18_hazard_removal", """SELECT a.bucket, a.country, a.water_scenario, a.model, a.removed, a.label, round(a.share, 8) AS share, round(a.share - b.share, 8) AS shift FROM shares a JOIN shares b USING (bucket, country, water_scenario, model, label) WHERE b.removed = 'none' AND a.removed <> 'none'""", "removal")
def c18(spark, folder):
    found = sensitivity.hazard_removal(bands(spark, folder))
    return found.select("bucket", "country", "water_scenario", "model", "removed", "label", r("share", 8).alias("share"), r("shift", 8).alias("shift"))


@query("a29_label_shares", """SELECT bucket, country, model, label, round(coalesce(sum(capacity_mw) FILTER (label = l), 0) / sum(capacity_mw), 8) AS share FROM (SELECT bucket, country, model, l AS label, idx.label AS l0, capacity_mw FROM idx CROSS JOIN (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'EXTREME']) AS l)
WHERE index_value IS NOT NULL) t(bucket, country, model, label, l, capacity_mw) GROUP BY 1, 2, 3, 4""", "idx")
def a29(spark, folder):
    return sensitivity.label_shares(index(spark, folder), "bucket", "country", "model").withColumn("share", r("share", 8))


@query("c20_cut_points", """SELECT DISTINCT bucket, round(index_value, 9) AS index_value, cut, CASE WHEN index_value >= 1 THEN 'EXTREME' WHEN index_value >= cut THEN 'HIGH' WHEN index_value > 0 THEN 'MEDIUM' ELSE 'LOW' END AS label, label_0 AS base_label, label <> label_0 AS flipped
FROM (SELECT bucket, index_value, label AS label_0, unnest([0.4, 0.5, 0.6])::DOUBLE AS cut FROM idx WHERE index_value IS NOT NULL)""", "idx")
def c20(spark, folder):
    return sensitivity.cut_points(index(spark, folder)).withColumn("index_value", r("index_value", 9))


@query("f32_jitter_draws", f"""SELECT id AS draw, round(0.0025::DOUBLE * (0.9 + {U.format(key="'1|' || id || '|coal_decay_rate'")} * 0.2), 10) AS coal_decay_rate, round(-5 + {U.format(key="'1|' || id || '|shift'")} * 10, 9) AS percentile_shift FROM (SELECT c_custkey AS id FROM customer)""")
def f32(spark, folder):
    """One draw for each plant."""
    return sensitivity.jitter_draws(read_table(spark, folder, "customer").select(F.col("c_custkey").alias("draw"))).select("draw", r("coal_decay_rate", 10).alias("coal_decay_rate"), r("percentile_shift", 9).alias("percentile_shift"))


@query("f16_normal")
def f16(spark, folder):
    u = X.uniform(F.lit("n"), F.col("event_id").cast("string"))
    return read_table(spark, folder, "events").select("event_id", X.normal_cdf(X.normal_quantile(F.greatest(u, F.lit(1e-9)))).alias("back"), u.alias("u"))
