"""Registered queries against their DuckDB oracles on the smallest tables."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from riskgrid import queries as core
from riskgrid.operators import events, gate, grid, quality, report

NAMES = (
    "s2_plants", "j2_hazard_samples", "c7_age_factors", "c8_top_risk", "c9_risk_bands", "c10_screening_index", "c23_cuts_table", "f8_normalised_layer", "j13_regrid",
    "a1_units_to_plants", "c1_clean_assets", "c4_wet_day_exceedance", "c5_mean_annual_max", "c12_correlation_gate", "c19_gate_sweep", "j4_point_in_polygon", "j5_rasterise",
    "j7_radius_join", "a23_severity", "f31_event_codes", "c13_contextual_validation", "c17_recompute", "c18_hazard_removal", "a27_band_distribution", "t1_annual_max_stream", "q3_grid_mismatch", "q4_bounds_drift", "q5_null_hazards", "s7_partitioned_series", "f27_composite_score", "f32_jitter_draws",
    "a40_table_profile", "c6_basin_layer", "c25_water_heat_table", "c24_plant_against_grid", "c15_pooled", "q8_registry_conflicts", "f7_named_transforms", "w11_country_ranks",
    "j2_tiled_samples", "c2_heat_days_from_files", "c1_report", "q4_frozen_bounds", "q10_usable_tables", "o2_by_absolute", "f5_robust_transform", "c24_two_hazards", "a13_water_thresholds", "a16_rank_sum_test", "c14_zonal_validation", "a38_tracks_by_country", "j6_zonal_mean", "w3_average_rank",
    "c11_skewed_origins", "c12_gate_decisions", "c19_gate_flips", "a37_first_step", "a21_nation_coverage", "a23_nation_severity", "a24_nation_multipliers", "j10_region_multiplier",
)
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((x is not None, str(x) if isinstance(x, (bool, str, datetime.date)) else x) if x is not None else (False, 0) for x in row))


def both(spark, small, duck, name):
    """Rows of a query and of its oracle, columns by name."""
    df = core.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    ours = ordered([tuple(r) for r in df.select(*cols).collect()])
    answer = duck.execute(core.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    return ours, ordered([tuple(r[names.index(c)] for c in cols) for r in answer.fetchall()])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, small, duck, name):
    ours, theirs = both(spark, small, duck, name)
    assert ours == theirs


#: Queries, the operator they call, and what it does once broken.
BROKEN = {
    "q8_registry_conflicts": (quality, "registry_conflicts", lambda real, rules, applicable, *more: real(applicable, rules, *more)),
    "q10_usable_tables": (quality, "usable_table", lambda real, *of: real(*of).filter("problem <> 'no row'")),
    "f5_robust_transform": (report, "robust", lambda real, s, *by: real(s.filter("term = 'heat'"), *by)),
    "c24_plant_against_grid": (report, "plant_against_grid", lambda real, own, *more: real(own.filter("value > 1"), *more)),
    "c24_two_hazards": (gate, "run_gate", lambda real, s, **more: real(s.withColumn("value", F.col("value") * F.col("value")), **more)),
    "j2_tiled_samples": (grid, "sample_tiled", lambda real, plants, tiled, *more: real(plants, tiled.filter("tile_row > 0"), *more)),
    "a38_tracks_by_country": (events, "track_summary", lambda real, tracks, *more: real(tracks.dropDuplicates(["sid"]), *more)),
    "c14_zonal_validation": (events, "zonal_event_tests", lambda real, polygons, cells, *more: real(polygons, cells.withColumn("value", -F.col("value")), *more)),
    "o2_by_absolute": (report, "by_absolute", lambda real, table, value: real(table.withColumn(value, F.abs(value)), value)),
}


@pytest.mark.parametrize("name", BROKEN)
def test_oracle_notices_a_broken_operator(spark, small, duck, monkeypatch, name):
    module, operator, breaks = BROKEN[name]
    real = getattr(module, operator)
    monkeypatch.setattr(module, operator, lambda *a, **k: breaks(real, *a, **k))
    ours, theirs = both(spark, small, duck, name)
    assert ours != theirs


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(core.ORACLES) <= set(core.QUERIES)
