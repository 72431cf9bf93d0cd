"""Result tables: distributions, overlays, map layers, composite diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.plans import ranks

from . import gate, grid, risk

# Water category boundaries and bucket weights of the composite score.
WATER_BOUNDARIES = {"ws": (0.1, 0.2, 0.4, 0.8), "sv": (0.33, 0.66, 1.00, 1.33), "iv": (0.25, 0.50, 0.75, 1.00)}
WATER_BANDS = ("Low", "Low-Medium", "Medium-High", "High", "Extremely High")
EQUAL_TERMS = ("ws", "heat", "sv", "iv")
SCORE_CUTS = (0.128, 0.386, 0.647)
COMPOSITE = {"hydro": (0.55, 0.0, 0.45), "thermal": (0.525, 0.175, 0.30), "wind": (0.0, 0.95, 0.05), "solar": (0.0, 0.95, 0.05)}


def band_distribution(bands: DataFrame) -> DataFrame:
    """Plants, MW and share of the bucket's MW by country, bucket, term, scenario, model and band; empty bands have zero rows."""
    spark = bands.sparkSession
    keys = ("country", "bucket", "term", "water_scenario", "model")
    grid = bands.select(*keys).distinct().crossJoin(F.broadcast(spark.createDataFrame([(b,) for b in C.BANDS], "risk_band string")))
    own = bands.groupBy(*keys, "risk_band").agg(F.count(F.lit(1)).alias("n"), F.sum("capacity_mw").alias("mw"))
    total = bands.groupBy(*keys).agg(F.sum("capacity_mw").alias("total_mw"), F.count_if(F.col("risk_band").isNull()).alias("n_missing"))
    out = grid.join(own, [*keys, "risk_band"], "left").join(total, list(keys))
    return out.select(*keys, "risk_band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mw", F.lit(0.0)).alias("mw"), (100.0 * F.try_divide(F.coalesce("mw", F.lit(0.0)), F.col("total_mw"))).alias("pct"), "n_missing")


def label_distribution(index: DataFrame) -> DataFrame:
    """Plants and MW by country, bucket, scenario, model and label, INCOMPLETE included; empty labels have zero rows."""
    spark = index.sparkSession
    keys = ("country", "bucket", "water_scenario", "model")
    rows = index.withColumn("label", F.coalesce("label", F.lit("INCOMPLETE")))
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in (*C.LABELS, "INCOMPLETE")], "label string")))
    own = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("capacity_mw").alias("mw"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return grid.join(own, [*keys, "label"], "left").join(total, list(keys)).select(*keys, "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mw", F.lit(0.0)).alias("mw"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def overlay(validated: DataFrame) -> DataFrame:
    """Plants and their share by validator class, country, term and state."""
    keys = ("validator_class", "country", "term")
    own = validated.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"))
    return own.join(validated.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), list(keys)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def spread(values: DataFrame, *by: str) -> DataFrame:
    """n, percentiles, largest value and skewness of each group."""
    at = {f"p{round(p * 100)}": p for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    rest = values.groupBy(*by).agg(F.max("value").alias("top"), gate.skewness("value").alias("skewness"))
    return ranks.percentiles(values, "value", at, *by).join(rest, list(by)).select(*by, "n", *at, "top", "skewness")


def unmatched(samples: DataFrame) -> DataFrame:
    """Plants without any value in a term, with those terms."""
    hit = samples.groupBy("plant_uid", "term").agg(F.bool_or(F.col("value").isNotNull()).alias("hit"))
    return hit.filter(~F.col("hit") & F.col("term").isNotNull()).groupBy("plant_uid").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def cross_table(bands: DataFrame, a: str, b: str) -> DataFrame:
    """Capacity share by the bands of two terms of a bucket, per bucket and model."""
    keys = ("plant_uid", "bucket", "water_scenario", "model", "capacity_mw")
    wide = bands.filter(F.col("term").isin(a, b) & F.col("risk_band").isNotNull()).groupBy(*keys).pivot("term", [a, b]).agg(F.max("risk_band")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = wide.groupBy("bucket", "model").agg(F.sum("capacity_mw").alias("_t"))
    return wide.groupBy("bucket", "model", F.col(a).alias("band_a"), F.col(b).alias("band_b")).agg(F.sum("capacity_mw").alias("mw")).join(total, ["bucket", "model"]).withColumn("share", F.try_divide("mw", "_t")).drop("_t")


def dominance(bands: DataFrame, most: float = 0.5) -> DataFrame:
    """Bands that hold more than a share of their group's capacity."""
    keys = ("bucket", "term", "water_scenario", "model")
    own = bands.filter("risk_band is not null").groupBy(*keys, "risk_band").agg(F.sum("capacity_mw").alias("mw"))
    total = own.groupBy(*keys).agg(F.sum("mw").alias("_t"))
    return own.join(total, list(keys)).withColumn("share", F.try_divide("mw", "_t")).filter(F.col("share") > most).drop("_t", "mw")


def water_weights() -> dict[str, float]:
    """Weights in proportion to one over each indicator's last boundary."""
    inverse = {k: 1.0 / v[-1] for k, v in WATER_BOUNDARIES.items()}
    return {k: v / sum(inverse.values()) for k, v in inverse.items()}


def water_cuts() -> list[float]:
    """The score where all indicators stand on their n-th boundary."""
    w = water_weights()
    return [sum(w[k] * v[n] for k, v in WATER_BOUNDARIES.items()) for n in range(4)]


def water_bands(samples: DataFrame) -> DataFrame:
    """Weighted water score and its band; a missing indicator leaves both missing."""
    w = water_weights()
    weight = reduce(lambda c, k: c.when(F.col("term") == k, w[k]), w, F.when(F.lit(False), 0.0))
    keys = ("plant_uid", "bucket", "water_scenario", "model")
    scored = samples.filter(F.col("term").isin(*w)).groupBy(*keys).agg(F.when(F.count("value") == 3, F.sum(F.col("value") * weight)).alias("score"))
    return scored.withColumn("band", X.band("score", [F.lit(c) for c in water_cuts()], WATER_BANDS))


def composite_weights() -> list[tuple[str, str, float]]:
    """Rows (bucket, term, weight): the water share is spread over its three indicators."""
    water = water_weights()
    return [(b, t, w) for b, (x, heat, dry) in COMPOSITE.items() for t, w in (*((k, x * v) for k, v in water.items()), ("heat", heat), ("spei", dry)) if w]


def composite_score(samples: DataFrame, bounds: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Weighted sum of scaled terms x age factor x the country's event multiplier; a missing term leaves the score missing.

    Water stress, heat and drought are scaled after log1p, the variabilities linearly.
    """
    spark = samples.sparkSession
    rows = composite_weights()
    weights = spark.createDataFrame([(b, t, w, sum(x[0] == b for x in rows)) for b, t, w in rows], "bucket string, term string, weight double, parts int")
    joined = samples.join(F.broadcast(weights), ["bucket", "term"]).join(
        F.broadcast(bounds.withColumnRenamed("term", "_t")), (F.col("term") == F.col("_t")) & (risk.bound_model() == F.col("bound_model"))
    )
    low, high = F.col("lo"), F.col("hi")
    scaled = F.when(F.col("term").isin("sv", "iv"), X.minmax("value", low, high)).otherwise(X.log1p_minmax("value", low, high))
    summed = joined.withColumn("_x", scaled).groupBy("plant_uid", "country", "bucket", "water_scenario", "model").agg(
        F.count("_x").alias("_k"), F.max("parts").alias("_p"), F.sum(F.col("weight") * F.col("_x")).alias("_s"), F.max(X.age_factor()).alias("_a")
    )
    score = F.when(F.col("_k") == F.col("_p"), F.col("_s") * F.col("_a") * F.coalesce("multiplier", F.lit(1.0)))
    return summed.join(multipliers.select("country", "multiplier"), "country", "left").select("plant_uid", "country", "bucket", "water_scenario", "model", score.alias("score"))


def with_capacity(result: DataFrame, inventory: DataFrame) -> DataFrame:
    """A result table with its plants' capacity (null where the inventory lacks a plant); one already there is replaced."""
    own = inventory.groupBy("plant_uid").agg(F.max("capacity_mw").alias("capacity_mw"))
    return result.drop("capacity_mw").join(own, "plant_uid", "left")


def plant_places(table: DataFrame) -> DataFrame:
    """Coordinates of each plant, once: those of its first row by longitude and latitude."""
    return table.filter("lon is not null and lat is not null").groupBy("plant_uid").agg(F.min(F.struct("lon", "lat")).alias("p")).select("plant_uid", "p.lon", "p.lat")


def country_ranks(index: DataFrame) -> DataFrame:
    """Countries by their capacity-weighted mean index, ranked within scenario and model; without a known index last."""
    mean = index.groupBy("country", "water_scenario", "model").agg(X.weighted_mean("index_value", "capacity_mw").alias("mean_index"))
    return mean.withColumn("rank", F.rank().over(Window.partitionBy("water_scenario", "model").orderBy(F.col("mean_index").desc_nulls_last())))


def by_absolute(table: DataFrame, value: str) -> DataFrame:
    """Rows by falling absolute value, missing last, with their place, equal ones sharing it.

    Places come from ranks over ranges of values, so no task holds the table.
    """
    size = table.withColumn("_size", -F.abs(value))
    places = ranks.value_ranks(size, "_size")
    known = F.broadcast(places.agg(F.coalesce(F.max("n"), F.lit(0)).alias("_known")))
    joined = size.join(places.select("_size", "low"), "_size", "left").crossJoin(known)
    return joined.withColumn("place", (F.coalesce("low", "_known") + 1).cast("int")).orderBy("place").drop("_size", "low", "_known")


def gate_matrix(gate_rows: DataFrame) -> DataFrame:
    """The gate's rows with a label a pair and how their statistic was decided."""
    label = F.concat_ws(" vs ", "term_a", "term_b")
    return gate_rows.select(label.alias("pair_label"), "gated", "bucket", "country", "model", "n", F.when(F.col("nonlinear"), "spearman").otherwise("pearson").alias("method"), F.abs("decision_r").alias("strength"), "verdict")


def invariant_band(bands: DataFrame, term: str = "wind") -> DataFrame:
    """One row a bucket and band of a term that no scenario or model moves: plants and MW, each plant once."""
    once = bands.filter((F.col("term") == term) & F.col("risk_band").isNotNull()).groupBy("plant_uid", "bucket").agg(F.min("risk_band").alias("risk_band"), F.max("capacity_mw").alias("capacity_mw"), F.count_distinct("risk_band").alias("_k"))
    sure = F.when(F.col("_k") > 1, F.raise_error(F.lit(f"{term} band differs between scenarios")).cast("string")).otherwise(F.col("risk_band"))
    return once.withColumn("risk_band", sure).groupBy("bucket", "risk_band").agg(F.count(F.lit(1)).alias("n"), F.sum("capacity_mw").alias("mw"))


def hazard_scores(samples: DataFrame) -> DataFrame:
    """Equal-weight score of water stress, heat and both variabilities for rows that know all four, with its fixed band.

    Terms are scaled to their range over those rows, by model; stress and heat
    after log1p.
    """
    keys = ("plant_uid", "country", "bucket", "water_scenario", "model", "capacity_mw")
    wide = grid.wide(samples.filter(F.col("term").isin(*EQUAL_TERMS)), *keys, terms=EQUAL_TERMS).na.drop(subset=list(EQUAL_TERMS))
    spans = wide.groupBy("model").agg(*(f(t).alias(f"_{n}_{t}") for t in EQUAL_TERMS for n, f in (("lo", F.min), ("hi", F.max))))
    scale = lambda t: (X.log1p_minmax if t in ("ws", "heat") else X.minmax)(F.col(t), F.col(f"_lo_{t}"), F.col(f"_hi_{t}"))
    score = sum((scale(t) * (1.0 / len(EQUAL_TERMS)) for t in EQUAL_TERMS[1:]), scale(EQUAL_TERMS[0]) * (1.0 / len(EQUAL_TERMS)))
    return wide.join(F.broadcast(spans), "model").select(*keys, *EQUAL_TERMS, score.alias("score")).withColumn("band", X.band("score", [F.lit(c) for c in SCORE_CUTS], C.LABELS_BY_BAND))


def heat_bands(scores: DataFrame) -> DataFrame:
    """Scored rows with the band of their heat between the quarters and the 95th percentile of its model."""
    at = {"_a": 0.25, "_b": 0.75, "_c": 0.95}
    cuts = ranks.percentiles(scores, "heat", at, "model").drop("n")
    return scores.join(F.broadcast(cuts), "model").withColumn("heat_band", X.band("heat", [F.col(c) for c in at], C.LABELS_BY_BAND)).drop(*at)


def water_heat_table(scores: DataFrame, water: DataFrame) -> DataFrame:
    """Capacity share of each water and heat band by country and model, scenarios pooled, with the joint shares high-high and top-top."""
    keys = ["plant_uid", "water_scenario", "model"]
    joined = heat_bands(scores).join(water.select(*keys, F.col("band").alias("water_band")), keys)
    own = joined.groupBy("country", "model", "water_band", "heat_band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("capacity_mw", F.lit(0.0))).alias("mw"))
    whole = Window.partitionBy("country", "model")
    share = F.try_divide("mw", F.sum("mw").over(whole))
    high = F.col("water_band").isin(*WATER_BANDS[3:]) & F.col("heat_band").isin("HIGH", "EXTREME")
    top = (F.col("water_band") == WATER_BANDS[4]) & (F.col("heat_band") == "EXTREME")
    out = own.withColumn("share", share)
    return out.withColumns({c: F.sum(F.when(x, F.col("share")).otherwise(0.0)).over(whole) for c, x in (("high_high", high), ("top_top", top))})


def matched_coverage(scores: DataFrame, plants: DataFrame, scenario: str = C.SCENARIOS[0][0]) -> DataFrame:
    """Declared and scored capacity by country and model; the scored set is taken from one scenario."""
    declared = plants.groupBy("country").agg(F.sum("capacity_mw").alias("declared_mw"))
    matched = scores.filter(F.col("water_scenario") == scenario).groupBy("country", "model").agg(F.sum("capacity_mw").alias("matched_mw"))
    return matched.join(declared, "country").withColumn("matched_share", F.try_divide("matched_mw", "declared_mw"))


def plant_against_grid(samples: DataFrame, cells: DataFrame, *by: str) -> DataFrame:
    """Percentiles of a layer at the plants beside those over all its cells, and the plants' match rate."""
    at = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    own = ranks.percentiles(samples, "value", at, *by).withColumnsRenamed({"n": "plants_known"} | {c: f"plants_{c}" for c in at})
    rows = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("plants"))
    grid = ranks.percentiles(cells, "value", at, *by).withColumnsRenamed({"n": "cells_known"} | {c: f"cells_{c}" for c in at})
    return own.join(rows, list(by)).join(grid, list(by), "left").withColumn("match_rate", F.col("plants_known") / F.col("plants"))


def water_thresholds(samples: DataFrame, *by: str) -> DataFrame:
    """Share of each water term's samples at or above the term's published cut, with percentiles: term, by, share, n, p90, p95, p99."""
    water = samples.filter(F.col("term").isin(*C.WATER_TAU))
    cut = F.create_map(*(F.lit(x) for kv in C.WATER_TAU.items() for x in kv))[F.col("term")]
    over = water.groupBy("term", *by).agg(F.avg(F.when(F.col("value").isNotNull(), (F.col("value") >= cut).cast("double"))).alias("share"))
    return over.join(ranks.percentiles(water, "value", {"p90": 0.9, "p95": 0.95, "p99": 0.99}, "term", *by), ["term", *by])


def map_layer(bands: DataFrame) -> DataFrame:
    """Bands with coordinates and a marker size against the largest plant."""
    most = bands.agg(F.max("capacity_mw").alias("_most"))
    return bands.crossJoin(F.broadcast(most)).select("plant_uid", "country", "bucket", "term", "water_scenario", "model", "risk_band", "lon", "lat", X.marker_size("capacity_mw", F.col("_most")).alias("marker_size"))


def screening_map(index: DataFrame, validated: DataFrame) -> DataFrame:
    """Index rows with a flag for each validator class that corroborates the plant."""
    flags = validated.groupBy("plant_uid").agg(*(F.bool_or((F.col("validator_class") == c) & (F.col("state") == "Corroborated")).alias(c) for c in ("broad_impact", "physical_occurrence")))
    no = F.lit(False)
    return index.join(flags, "plant_uid", "left").select("plant_uid", "bucket", "water_scenario", "model", "label", F.coalesce("broad_impact", no).alias("broad_impact"), F.coalesce("physical_occurrence", no).alias("physical_occurrence"))


def age_summary(ages: DataFrame) -> DataFrame:
    """Age factors by country and curve (bucket, and fuel where thermal), with missing years."""
    curve = F.when(F.col("bucket") == "thermal", F.concat_ws(":", "bucket", F.when(F.col("mixed_fuel_type"), F.lit("mixed")).otherwise(F.col("fuel_type")))).otherwise(F.col("bucket"))
    return ages.groupBy("country", curve.alias("curve")).agg(F.min("age_factor").alias("low"), F.avg("age_factor").alias("mean"), F.max("age_factor").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if("year_missing").alias("n_missing"))


def robust(values: DataFrame, *by: str) -> DataFrame:
    """Centred by median over the interquartile range, clipped to p1..p99 and rescaled; rank quantiles beside it."""
    at = {"p1": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}
    stats = ranks.percentiles(values, "value", {f"_{k}": p for k, p in at.items()}, *by).withColumnRenamed("n", "_n")
    width = F.when(F.col("_q3") > F.col("_q1"), F.col("_q3") - F.col("_q1")).otherwise(1.0)
    z = lambda x: (x - F.col("_med")) / width
    joined = ranks.with_average_ranks(values.filter("value is not null"), {"_rk": "value"}, *by).join(stats, list(by))
    return joined.withColumns({
        "robust": X.minmax(X.clip(z(F.col("value")), z(F.col("_p1")), z(F.col("_p99"))), z(F.col("_p1")), z(F.col("_p99"))),
        "rank_quantile": F.when(F.col("_n") > 1, (F.col("_rk") - 1.0) / (F.col("_n") - 1.0)),
    }).drop(*(f"_{k}" for k in at), "_n", "_rk")


def threshold_provenance(samples: DataFrame) -> DataFrame:
    """One row a (bucket, term): tier, kind and cuts or percentiles."""
    rows = [(b, t, 1 if k != "percentile" else 3, k, ", ".join(f"{x:g}" for x in ([c for c in cs if c is not None] if k != "percentile" else ps))) for b, t, k, *cs, ps in C.thresholds()]
    counted = samples.groupBy("bucket", "term").agg(F.count("value").alias("n"))
    return counted.join(F.broadcast(samples.sparkSession.createDataFrame(rows, "bucket string, term string, tier int, kind string, cuts string")), ["bucket", "term"])
