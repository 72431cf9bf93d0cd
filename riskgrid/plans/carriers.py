"""Operator inputs built from the driver's star-schema tables by plain arithmetic.

The tables hold no climate data, so customers stand for plants, parts for grid
cells, orders and events for daily and monthly series, nations for polygons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.plans.sizes import dealt
from riskgrid.sources.tables import read_table

#: Term, multiplier, modulus and divisor of the layer values.
LAYER_RULES = (("ws", 13, 101, 100.0), ("heat", 23, 97, 1.0), ("sv", 17, 131, 26.0), ("iv", 19, 113, 30.0), ("spei", 29, 61, 10.0), ("precip", 31, 89, 4.0), ("wind", 37, 71, 1.5))
#: The plants' grid: left edge, upper edge and cell size.
GRID = (0.0, 40.0, 1.0)
#: Parts, about, that one task spells out by layer.
PARTS_A_TASK = 20_000


def plants(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    c, k = read_table(spark, folder, "customer"), F.col("c_custkey")
    where = F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("country")))
    kind = F.floor(k / 4) % 4
    fuel = F.when(k % 4 == 0, "hydropower").when(k % 4 == 2, "wind").when(k % 4 == 3, "utility-scale solar").when(kind == 0, "coal").when(kind == 1, "oil/gas").when(kind == 2, "nuclear")
    return c.join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.substring("country", 1, 3), F.lit("-"), F.substring(F.sha2("c_name", 256), 1, 12)).alias("plant_uid"),
        "country", F.col("c_name").alias("plant_name"),
        F.element_at(F.array(*map(F.lit, C.BUCKETS)), (k % 4 + 1).cast("int")).alias("bucket"),
        F.when(k % 41 != 0, F.abs("c_acctbal")).alias("capacity_mw"),
        F.when(k % 17 != 0, (1960 + k % 70).cast("double")).alias("commissioning_year"),
        fuel.alias("fuel_type"), ((k % 4 == 1) & (kind == 3)).alias("mixed_fuel_type"),
        F.coalesce(fuel, F.lit("coal;oil/gas")).alias("fuel_types_found"),
        ((k * 37 % 5100) / 100.0).alias("lon"), (F.lit(40.0) - (k * 53 % 4100) / 100.0).alias("lat"),
    )


def layers(spark: SparkSession) -> DataFrame:
    """One row a layer: term, its scenario and model (``-`` where it has none), and the value rule."""
    rows = []
    for term, a, mod, div in LAYER_RULES:
        for s, scenario in enumerate(("opt", "bau", "pes") if term != "wind" else ("-",)):
            for m, model in enumerate(C.MODELS if term in C.MODEL_TERMS else ("-",)):
                rows.append((term, scenario, model, s, m, a, mod, div))
    return spark.createDataFrame(rows, "term string, scenario string, model string, s int, m int, a int, modulus int, divisor double")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    p, k = read_table(spark, folder, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    value = ((k * F.col("a") + F.col("p_size") * 7 + F.col("s") * 11 + F.col("m") * 5) % F.col("modulus")) / F.col("divisor")
    return dealt(p, PARTS_A_TASK).crossJoin(F.broadcast(layers(spark))).select(
        "term", "scenario", "model", F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.when((k + F.col("a")) % 31 != 0, value).alias("value")
    )


def scenario_keys(spark: SparkSession) -> DataFrame:
    """Every (scenario, model, term) with the layer that serves it."""
    rows = [
        (s, h, m, t, "-" if t == "wind" else s, m if t in C.MODEL_TERMS else "-")
        for s, h in C.SCENARIOS for m in C.MODELS for t in C.TERMS
    ]
    return spark.createDataFrame(rows, "water_scenario string, heat_scenario string, model string, term string, layer_scenario string, layer_model string")


#: The same carriers as DuckDB common table expressions.
SQL = {
    "plants": """plants AS (SELECT substr(r_name, 1, 3) || '-' || substr(sha256(c_name), 1, 12) AS plant_uid, r_name AS country, c_name AS plant_name,
  ['hydro', 'thermal', 'wind', 'solar'][c_custkey % 4 + 1] AS bucket, CASE WHEN c_custkey % 41 <> 0 THEN abs(c_acctbal) END AS capacity_mw,
  CASE WHEN c_custkey % 17 <> 0 THEN (1960 + c_custkey % 70)::DOUBLE END AS commissioning_year,
  CASE WHEN c_custkey % 4 = 0 THEN 'hydropower' WHEN c_custkey % 4 = 2 THEN 'wind' WHEN c_custkey % 4 = 3 THEN 'utility-scale solar'
    WHEN c_custkey // 4 % 4 = 0 THEN 'coal' WHEN c_custkey // 4 % 4 = 1 THEN 'oil/gas' WHEN c_custkey // 4 % 4 = 2 THEN 'nuclear' END AS fuel_type,
  (c_custkey % 4 = 1 AND c_custkey // 4 % 4 = 3) AS mixed_fuel_type, coalesce(fuel_type, 'coal;oil/gas') AS fuel_types_found,
  (c_custkey * 37 % 5100) / 100.0::DOUBLE AS lon, 40.0::DOUBLE - (c_custkey * 53 % 4100) / 100.0::DOUBLE AS lat
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "rules": """rules(term, a, modulus, divisor) AS (VALUES ('ws', 13, 101, 100.0::DOUBLE), ('heat', 23, 97, 1.0::DOUBLE), ('sv', 17, 131, 26.0::DOUBLE), ('iv', 19, 113, 30.0::DOUBLE),
  ('spei', 29, 61, 10.0::DOUBLE), ('precip', 31, 89, 4.0::DOUBLE), ('wind', 37, 71, 1.5::DOUBLE))""",
    "scen": "scen(water_scenario, heat_scenario, s) AS (VALUES ('opt', 'ssp126', 0), ('bau', 'ssp370', 1), ('pes', 'ssp585', 2))",
    "mods": "mods(model, m) AS (VALUES ('gfdl_esm4', 0), ('miroc6', 1))",
    "applicable": """applicable(bucket, term, pos, size) AS (VALUES ('hydro', 'ws', 0, 5), ('hydro', 'spei', 1, 5), ('hydro', 'precip', 2, 5), ('hydro', 'sv', 3, 5), ('hydro', 'iv', 4, 5),
  ('thermal', 'ws', 0, 3), ('thermal', 'heat', 1, 3), ('thermal', 'precip', 2, 3), ('wind', 'wind', 0, 1), ('solar', 'heat', 0, 3), ('solar', 'precip', 1, 3), ('solar', 'wind', 2, 3))""",
    "samples": """samples AS (SELECT p.*, c.water_scenario, c.heat_scenario, d.model, r.term,
  CASE WHEN (q.p_partkey + r.a) % 31 <> 0 THEN ((q.p_partkey * r.a + q.p_size * 7 + CASE WHEN r.term = 'wind' THEN 0 ELSE c.s END * 11
    + CASE WHEN r.term IN ('heat', 'spei', 'precip') THEN d.m ELSE 0 END * 5) % r.modulus) / r.divisor END AS value
  FROM plants p CROSS JOIN scen c CROSS JOIN mods d CROSS JOIN rules r
  LEFT JOIN part q ON q.p_partkey // 50 = floor(40.0 - p.lat)::BIGINT AND q.p_partkey % 50 = floor(p.lon)::BIGINT AND p.lon < 50)""",
    "age": """age AS (SELECT *, 2050.0::DOUBLE - commissioning_year AS years,
  CASE WHEN years <= 0 THEN 1.0::DOUBLE ELSE 1.0 - floor(years / 5.0) * ((1.0::DOUBLE - 0.7::DOUBLE) * 0.0025::DOUBLE * 5.0) - 0.0025::DOUBLE * (years - floor(years / 5.0) * 5.0) END AS coal,
  CASE WHEN years IS NULL THEN 1.0::DOUBLE WHEN bucket = 'hydro' THEN 2 - least(greatest(1.0::DOUBLE - 0.0055::DOUBLE * years, 0), 1)
    WHEN bucket = 'wind' THEN 2 - least(greatest(1.0::DOUBLE - 0.004::DOUBLE * years, 0), 1) WHEN bucket = 'solar' THEN 2 - least(greatest(pow(1.0::DOUBLE - 0.007::DOUBLE, years), 0), 1)
    WHEN mixed_fuel_type THEN (2 - least(greatest(coal, 0), 1) + 1.0) / 2 WHEN fuel_type = 'coal' THEN 2 - least(greatest(coal, 0), 1) ELSE 1.0::DOUBLE END AS age_factor FROM plants)""",
    "bounds": """bounds AS (SELECT term, CASE WHEN term IN ('heat', 'spei', 'precip') THEN model ELSE '-' END AS bound_model, min(value) AS lo, max(value) AS hi FROM samples WHERE value IS NOT NULL GROUP BY ALL)""",
    "risk": """risk AS (SELECT s.plant_uid, s.country, s.plant_name, s.bucket, s.capacity_mw, s.water_scenario, s.model, s.term,
  CASE WHEN s.value IS NULL THEN NULL WHEN hi <= lo THEN 0.0::DOUBLE WHEN s.term IN ('ws', 'heat', 'wind') THEN
    0.0::DOUBLE + least(greatest(-ln(1 - least(greatest((s.value - lo) / (hi + 0.05::DOUBLE * (hi - lo) - lo), 0), 1 - 1e-9::DOUBLE)) / ln(1 + 1 / 0.05::DOUBLE), 0), 1)
    ELSE least(greatest((s.value - lo) / (hi - lo), 0), 1) END AS hazard, a.age_factor, hazard * s.capacity_mw * a.age_factor AS risk
  FROM samples s JOIN age a USING (plant_uid) JOIN bounds b ON b.term = s.term AND b.bound_model = CASE WHEN s.term IN ('heat', 'spei', 'precip') THEN s.model ELSE '-' END)""",
    "bands": """cuts AS (SELECT term, model, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
  count(value) AS n FROM samples GROUP BY term, model),
bands AS (SELECT s.plant_uid, s.country, s.plant_name, s.bucket, s.capacity_mw, s.lon, s.lat, s.water_scenario, s.heat_scenario, s.model, s.term, s.value, CASE WHEN s.value IS NULL THEN NULL
  WHEN s.term = 'ws' THEN CASE WHEN s.value >= 0.8 THEN 'Extreme' WHEN s.value >= 0.4 THEN 'High' WHEN s.value >= 0.1 THEN 'Medium' ELSE 'Low' END
  WHEN s.bucket = 'wind' THEN CASE WHEN s.value >= 25.0 THEN 'Extreme' ELSE 'Low' END
  WHEN s.term = 'wind' THEN CASE WHEN s.value >= p99 THEN 'Extreme' WHEN s.value >= p95 THEN 'High' WHEN s.value >= p90 THEN 'Medium' ELSE 'Low' END
  ELSE CASE WHEN s.value >= p95 THEN 'Extreme' WHEN s.value >= p90 THEN 'High' WHEN s.value >= p75 THEN 'Medium' ELSE 'Low' END END AS risk_band
  FROM samples s JOIN applicable USING (bucket, term) JOIN cuts c ON c.term = s.term AND c.model = s.model)""",
    "idx": """idx AS (SELECT b.plant_uid, any_value(b.country) AS country, any_value(b.plant_name) AS plant_name, any_value(b.bucket) AS bucket, any_value(b.capacity_mw) AS capacity_mw, b.water_scenario, b.model, any_value(a.size) AS set_size,
  count(*) FILTER (b.risk_band IS NULL) AS n_missing, count(*) FILTER (b.risk_band IN ('High', 'Extreme')) AS n_high,
  CASE WHEN n_missing = 0 THEN n_high / set_size::DOUBLE END AS index_value,
  CASE WHEN index_value IS NULL THEN NULL WHEN index_value >= 1 THEN 'EXTREME' WHEN index_value >= 0.5 THEN 'HIGH' WHEN index_value > 0 THEN 'MEDIUM' ELSE 'LOW' END AS label,
  array_to_string(list(b.term ORDER BY a.pos) FILTER (b.risk_band IS NULL), ',') AS missing FROM bands b JOIN applicable a USING (bucket, term) GROUP BY b.plant_uid, b.water_scenario, b.model)""",
}
NEEDS = {
    "samples": ("plants", "rules", "scen", "mods"), "age": ("plants",), "bounds": ("samples",), "risk": ("samples", "age", "bounds"), "bands": ("samples", "applicable"), "idx": ("bands",),
}


def with_sql(body: str, *names: str) -> str:
    """``body`` after the named common table expressions and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(SQL[x] for x in order) + "\n" + body
