"""Percentiles over ranks, guards that raise, readers and reports."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskgrid.functions import exprs as X
from riskgrid.operators import assets, grid, quality, report, risk, sensitivity, spatial
from riskgrid.plans import ranks
from riskgrid.plans.sizes import checked_broadcast
from riskgrid.sources import sinks, tables


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.standard_normal(3001), "b": np.repeat([1.0, 2.0, 2.0, 5.0], 50), "c": np.array([7.5]), "d": np.array([])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(g, None) for g in groups]
    at = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0, "p0": 0.0}
    found = {r.g: r for r in ranks.percentiles(spark.createDataFrame(rows, "g string, value double"), "value", at, "g").collect()}
    for g, vs in groups.items():
        assert found[g].n == len(vs)
        for name, p in at.items():
            assert found[g][name] == (pytest.approx(np.quantile(vs, p), abs=1e-12) if len(vs) else None)
    whole = ranks.percentiles(spark.createDataFrame(rows, "g string, value double"), "value", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))
    assert ranks.percentiles(spark.createDataFrame([], "g string, value double"), "value", at, "g").collect() == []


def test_no_plan_pools_a_group_in_one_buffer(spark):
    samples = spark.createDataFrame([("ws", "m", 1.0)], "term string, model string, value double")
    plan = risk.percentile_cuts(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_display_exposure_never_scores(spark):
    plants = spark.createDataFrame([("p", 9.0), ("q", None), ("r", -3.0)], "plant_uid string, capacity_mw double")
    shown = risk.display_exposure(plants)
    assert [r[risk.DISPLAY] for r in shown.orderBy("plant_uid").collect()] == [1.0, None, 0.0]
    with pytest.raises(ValueError, match="display"):
        risk.risk_by_hazard(shown, shown)


def test_rank_across_buckets_raises(spark):
    rows = spark.createDataFrame([("p", "hydro", "opt", "m", 0.5), ("q", "wind", "opt", "m", 0.5)], "plant_uid string, bucket string, water_scenario string, model string, index_value double")
    assert risk.rank_within_bucket(rows, "hydro").count() == 1
    with pytest.raises(PySparkException, match="across buckets"):
        risk.rank_within_bucket(rows, "hydro", only=True).collect()


def test_basin_ceiling_and_layer(spark):
    ring = lambda x0, y0, x1, y1: [[{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}]]
    schema = "poly_id long, rings array<array<struct<x: double, y: double>>>, opt50_ws_x_r double, bau50_ws_x_r double, pes50_ws_x_r double"
    table = spark.createDataFrame([(1, ring(0.0, 0.0, 2.0, 4.0), 1.0, 9999.0, 0.5), (2, ring(2.0, 0.0, 3.0, 4.0), 3.0, None, 2.0), (3, None, 40.0, 40.0, 40.0)], schema)
    cells = {(r.scenario, r.row, r.col): (r.value, r.scaled) for r in spatial.basin_layer(table, (0.0, 4.0, 1.0), 4, 4).collect()}
    assert len(cells) == 48 and cells["opt", 0, 0] == (1.0, 0.2) and cells["bau", 3, 1] == (3.0, 1.0) and cells["bau", 0, 2] == (None, None) and cells["pes", 2, 2] == (2.0, 0.6) and cells["opt", 0, 3] == (None, None)
    with pytest.raises(PySparkException, match="ceiling"):
        spatial.read_basins(table.withColumn("opt50_ws_x_r", F.lit(50.5))).collect()


def test_named_transforms(spark):
    df = spark.createDataFrame([(0.5,)], "x double")
    one = F.lit(1.0)
    assert df.select(X.transform(F.lit("direct_minmax"), "x", F.lit(0.0), one)).first()[0] == 0.5
    with pytest.raises(PySparkException, match="unknown transform"):
        df.select(X.transform(F.lit("other"), "x", F.lit(0.0), one)).collect()


def test_long_form_needs_all_terms(spark):
    df = spark.createDataFrame([("p", 1.0, None)], "plant_uid string, ws double, heat double")
    assert {(r.term, r.value) for r in grid.long(df, "plant_uid", terms=("ws", "heat")).collect()} == {("ws", 1.0), ("heat", None)}
    with pytest.raises(ValueError, match="missing term"):
        grid.long(df, "plant_uid")


def test_read_plants_and_collisions(spark):
    row = ("Spain", "A", "1.0", "2.0", "n/a", "1990", "coal", None, "thermal")
    table = spark.createDataFrame([row, ("Spain", "A", "1.0", "2.5", "5", "", "coal", "true", "thermal")], [*assets.PLANT_COLUMNS])
    found = assets.read_plants(table).orderBy("lon").collect()
    assert [r.capacity_mw for r in found] == [None, 5.0] and [r.mixed_fuel_type for r in found] == [False, True] and found[0].plant_uid.startswith("SPA-") and found[0].plant_uid != found[1].plant_uid
    with pytest.raises(ValueError, match="missing plant columns"):
        assets.read_plants(table.drop("lat"))
    clash = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 1)], "id string, f int")
    assert [tuple(r) for r in quality.colliding_ids(clash, "id", "f").collect()] == [("x", 2)]


def test_usable_table(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert quality.usable_table(df, "a").collect() == []
    assert {r.problem for r in quality.usable_table(df.filter("false"), "a", "b").collect()} == {"no column b", "no row"}


def test_set_difference_counts_repeats(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("x",), ("z",), (None,)], "k string")
    assert sorted((str(r.k), r.side) for r in quality.set_difference(a, b).collect()) == [("None", "extra"), ("x", "missing"), ("y", "missing"), ("z", "extra")]


def test_series_of_many_files(spark):
    df = spark.createDataFrame([(2041 + k % 4, k, float(k)) for k in range(40)], "year int, cell long, tas double")
    path = sinks.write_partitioned(df, sinks.scratch(spark), "year")
    found = tables.read_series(spark, path, ("pr", "tas"), 2042, 2043)
    assert found.count() == 20 and set(found.columns) == {"cell", "year", "value"} and "PartitionFilters" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="no variable"):
        tables.read_series(spark, path, ("pr",), 2042, 2043)


def test_capacity_lookup_and_places(spark):
    result = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "plant_uid string, capacity_mw double")
    found = {r.plant_uid: r.capacity_mw for r in report.with_capacity(result, spark.createDataFrame([("p", 5.0), ("p", 5.0)], "plant_uid string, capacity_mw double")).collect()}
    assert found == {"p": 5.0, "q": None}
    places = spark.createDataFrame([("p", 1.0, 2.0), ("p", 1.0, 2.0), ("q", None, 1.0)], "plant_uid string, lon double, lat double")
    assert [tuple(r) for r in report.plant_places(places).collect()] == [("p", 1.0, 2.0)]


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(50)
    assert "ResolvedHint" in checked_broadcast(df, 50)._jdf.queryExecution().analyzed().toString()
    assert checked_broadcast(df, 49) is df


def test_strata_add_up_to_nothing_new(spark):
    """A stratum that holds all rows has the overall means."""
    rows = [(f"p{k}", "X", f"P{k}", "wind", float(k + 1), 1990.0, "wind", False, "wind", "opt", "gfdl_esm4", "wind", float(10 + k)) for k in range(6)]
    samples = spark.createDataFrame(rows, "plant_uid string, country string, plant_name string, bucket string, capacity_mw double, commissioning_year double, fuel_type string, mixed_fuel_type boolean, fuel_types_found string, water_scenario string, model string, term string, value double")
    draws, bounds = sensitivity.saltelli_draws(spark, 2), risk.global_bounds(samples)
    whole = {(r.draw, r.matrix): (r.risk_mean, r.index_mean) for r in sensitivity.recompute(samples, bounds, draws, ("draw", "matrix")).collect()}
    parts = {(r.draw, r.matrix): (r.risk_mean, r.index_mean) for r in sensitivity.recompute(samples, bounds, draws, ("draw", "matrix"), strata=("country", "bucket")).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 30 and all(whole[k] == pytest.approx(parts[k]) for k in whole)


def test_recomputed_means_of_continuous_values_equal_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    terms = {"hydro": ("ws", "spei", "precip", "sv", "iv"), "thermal": ("ws", "heat", "precip"), "wind": ("wind",), "solar": ("heat", "precip", "wind")}
    rows = []
    for k in range(120):
        bucket = list(terms)[k % 4]
        fuel = {"thermal": "coal"}.get(bucket, bucket)
        for t in terms[bucket]:
            value = None if rng.random() < 0.03 else float(rng.gamma(2.0, 3.0))
            rows.append((f"p{k}", "X", f"P{k}", bucket, float(rng.integers(1, 90)), float(1970 + k % 50), fuel, False, fuel, "opt", "gfdl_esm4", t, value))
    samples = spark.createDataFrame(rows, "plant_uid string, country string, plant_name string, bucket string, capacity_mw double, commissioning_year double, fuel_type string, mixed_fuel_type boolean, fuel_types_found string, water_scenario string, model string, term string, value double")
    draws, bounds = sensitivity.saltelli_draws(spark, 3), risk.global_bounds(samples)
    found = {(r.draw, r.matrix): (r.risk_mean, r.index_mean) for r in sensitivity.recompute(samples, bounds, draws, ("draw", "matrix")).collect()}
    span = {r.term: (r.lo, r.hi) for r in bounds.collect()}
    pool = {t: np.sort([r[-1] for r in rows if r[-2] == t and r[-1] is not None]) for t in span}
    gone = {r[0] for r in rows if r[-1] is None}
    for d in draws.collect():
        p, top, low = d.upper_tail_padding_fraction, 0.0, 0.0
        high = whole = 0.0
        for uid, _, _, bucket, mw, year, fuel, *_, term, v in rows:
            y = 2050 - year
            coal = 1 - np.floor(y / d.coal_overhaul_cycle_years) * (1 - d.coal_overhaul_recovery) * d.coal_decay_rate * d.coal_overhaul_cycle_years - d.coal_decay_rate * (y - np.floor(y / d.coal_overhaul_cycle_years) * d.coal_overhaul_cycle_years)
            kept = {"hydro": 1 - d.hydro_retention_rate * y, "wind": 1 - d.wind_relative_rate * y, "solar": (1 - d.solar_retention_rate) ** y, "thermal": coal}[bucket]
            if v is not None:
                lo, hi = span[term]
                h = -np.log(1 - (v - lo) / ((1 + p) * (hi - lo))) / np.log(1 + 1 / p) if term in ("ws", "heat", "wind") else (v - lo) / (hi - lo)
                top, low = top + mw * mw * h * (2 - min(max(kept, 0), 1)), low + mw
            if uid not in gone:
                size = len(terms[bucket])
                shift = None if term == "ws" or bucket == "wind" else min(getattr(d, f"{term}_percentile_shift"), 0.5) if term == "wind" else getattr(d, f"{term}_percentile_shift")
                cut = 0.4 if term == "ws" else 25.0 if shift is None else np.percentile(pool[term], (95 if term == "wind" else 90) + shift)
                whole, high = whole + 1 / size, high + (v >= cut) / size
        assert found[d.draw, d.matrix] == (pytest.approx(top / low, rel=1e-11), pytest.approx(high / whole, abs=1e-12))
