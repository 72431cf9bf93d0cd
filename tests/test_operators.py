"""Small fixtures with known answers, missing values and equivalence of plans."""

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.operators import assets, drought, events, gate, grid, quality, risk, sensitivity, spatial
from riskgrid.catalogue.base import samples

UNITS = "country string, plant_name string, capacity_mw double, commissioning_year double, fuel_type string, status string, lat double, lon double, seq long"


def units(spark):
    return spark.createDataFrame([
        ("Brazil", "A", 100.0, 2005.0, "coal", "operating", 10.0, 20.0, 1), ("Brazil", " a ", 50.0, 1990.0, "oil/gas", "Operating ", 10.00005, 20.0, 2),
        ("Brazil", "B", None, None, "wind", "operating", 11.0, 21.0, 3), ("Brazil", "C", 5.0, 2000.0, "coal", "construction", 1.0, 1.0, 4),
        ("Brazil", "D", 5.0, 2000.0, "coal", "retired", 1.0, 1.0, 5), ("Chile", "E", 5.0, 2000.0, "coal", "operating", 1.0, 1.0, 6),
    ], UNITS)


def test_units_merge_within_tolerance(spark):
    made = {r.plant_name: r for r in assets.to_plants(assets.with_status(assets.in_scope(units(spark), ["Brazil"])).filter("status_class = 'operating'")).collect()}
    assert set(made) == {"A", "B"}
    assert (made["A"].capacity_mw, made["A"].commissioning_year, made["A"].mixed_fuel_type, made["A"].fuel_types_found) == (150.0, 1990.0, True, "coal;oil/gas")
    assert made["B"].capacity_mw is None and made["B"].fuel_type == "wind"


def test_status_counts(spark):
    assert {r.status_class: r.units for r in assets.status_counts(units(spark)).collect()} == {"operating": 4, "planned": 1, "other": 1}


def test_mainland_box_excludes_with_a_reason(spark):
    plants = spark.createDataFrame([("P", 1.0, 1.0), ("P", 50.0, 1.0), ("Q", 50.0, 1.0), ("P", None, 1.0)], "country string, lon double, lat double")
    boxes = spark.createDataFrame([("P", 0.0, 0.0, 10.0, 10.0, True), ("Q", 0.0, 0.0, 10.0, 10.0, False)], "country string, xmin double, ymin double, xmax double, ymax double, mainland_only boolean")
    found = [(r.country, r.lon, r.stays) for r in assets.boxed(plants, boxes).collect()]
    assert sorted(found, key=str) == sorted([("P", 1.0, True), ("P", 50.0, False), ("Q", 50.0, True), ("P", None, False)], key=str)


def bands(spark, rows):
    return spark.createDataFrame([("u", "c", "n", b, 1.0, "bau", "m", t, x) for b, t, x in rows], "plant_uid string, country string, plant_name string, bucket string, capacity_mw double, water_scenario string, model string, term string, risk_band string")


@pytest.mark.parametrize("bucket", C.BUCKETS)
@pytest.mark.parametrize("label, want", [("Extreme", (1.0, "EXTREME")), ("Low", (0.0, "LOW"))])
def test_index_saturates(spark, bucket, label, want):
    r = risk.screening_index(bands(spark, [(bucket, t, label) for t in C.APPLICABLE[bucket]])).first()
    assert (r.index_value, r.label) == want


def test_two_of_three_is_high(spark):
    r = risk.screening_index(bands(spark, [("thermal", "ws", "High"), ("thermal", "heat", "Extreme"), ("thermal", "precip", "Medium")])).first()
    assert (r.index_value, r.label) == (pytest.approx(2 / 3), "HIGH")


def test_missing_band_leaves_the_index_missing(spark):
    r = risk.screening_index(bands(spark, [("thermal", "ws", "High"), ("thermal", "heat", "Extreme"), ("thermal", "precip", None)])).first()
    assert (r.index_value, r.label, r.set_size, r.missing_hazards) == (None, None, 3, ["precip"])


def test_gate_verdicts(spark):
    rows = []
    for k in range(30):
        for t, v in (("sv", k * 1.0), ("iv", k * 1.01 + k % 2), ("ws", float((k * 7) % 30)), ("spei", float(k)), ("precip", float((k * 11) % 30))):
            for m in C.MODELS:
                rows.append((f"p{k}", "X", "hydro", "bau", m, t, v))
    s = spark.createDataFrame(rows, "plant_uid string, country string, bucket string, water_scenario string, model string, term string, value double")
    found = {(r.term_a, r.term_b, r.country): r for r in gate.run_gate(s).filter("model in ('not_model_dependent', 'miroc6')").collect()}
    assert (found["sv", "iv", "X"].verdict, found["sv", "iv", "X"].retained, found["sv", "iv", "X"].excluded, found["sv", "iv", "X"].criterion) == ("fail", "iv", "sv", 3)
    assert found["sv", "ws", "X"].verdict == "pass"
    assert found["ws", "spei", "X"].verdict == "report_only"
    assert found["sv", "iv", "pooled"].verdict is None


def test_gate_without_pairs_is_insufficient(spark):
    rows = [(f"p{k}", "X", "hydro", "bau", C.MODELS[0], t, 1.0) for k in range(5) for t in ("sv", "ws")]
    s = spark.createDataFrame(rows, "plant_uid string, country string, bucket string, water_scenario string, model string, term string, value double")
    assert {r.verdict for r in gate.run_gate(s).filter("country = 'X'").collect()} == {"insufficient_data"}


def test_rolling_sums(spark):
    s = spark.createDataFrame([("c", 2000, m, float(m)) for m in range(1, 6)], "cell string, year int, month int, d double")
    assert [(r.month, r.acc) for r in drought.accumulated(s, 3).orderBy("month").collect()] == [(3, 6.0), (4, 9.0), (5, 12.0)]


def test_standard_index_keeps_order(spark):
    s = spark.createDataFrame([("c", 2000 + k, 1, v) for k, v in enumerate((-10.0, -2.0, 0.0, 1.0, 3.0, 8.0))], "cell string, year int, month int, acc double")
    spei = [r.spei for r in drought.standard_index(s, drought.fit(s)).orderBy("acc").collect()]
    assert spei == sorted(spei) and spei[0] < -1 < 1 < spei[-1]


def test_drought_months(spark):
    s = spark.createDataFrame([("c", x) for x in (-2.0, -1.0, -0.5, 0.0, 1.0, 2.0)], "cell string, spei double")
    assert drought.frequency(s).first().months_per_year == pytest.approx(4.0)


def test_short_series_are_reported(spark):
    s = spark.createDataFrame([("c", 2000, 1, 1.0), ("c", 2001, 1, 2.0)], "cell string, year int, month int, acc double")
    assert drought.too_short(s).count() == 1 and drought.fit(s).count() == 0


def test_monthly_units(spark):
    s = spark.createDataFrame([("c", 2000, 1, 1e-5, 293.15)] * 31, "cell string, year int, month int, pr double, tas double")
    r = drought.monthly(s).first()
    assert (r.pr_mm, r.tas_c, r.days) == (pytest.approx(26.784), pytest.approx(20.0), 31)


def boxes(spark):
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [(1, 1, "g1", 10.0, [ring((-1, -4), (1.5, -4), (1.5, 1), (-1, 1))]), (2, 2, "g2", 20.0, [ring((1.5, -4), (4, -4), (4, 1), (1.5, 1))])]
    return spark.createDataFrame(rows, "poly_id long, seq long, gid string, value double, rings array<array<struct<x:double,y:double>>>")


def test_shared_edges_count_once(spark):
    found = spatial.rasterise((0.0, 0.0, 1.0), 3, 4, boxes(spark)).collect()
    assert all(r.value is not None for r in found) and {r.value for r in found} == {10.0, 20.0}


def test_points_outside_stay_null(spark):
    p = spark.createDataFrame([("in", 0.0, 0.0), ("out", 9.0, 9.0), ("none", None, None)], "point_id string, x double, y double")
    assert {r.point_id: r.gid for r in spatial.first_polygon(p, boxes(spark)).collect()} == {"in": "g1", "out": None, "none": None}


def test_radius_across_the_date_line_and_poles(spark):
    p = spark.createDataFrame([("a", 0.0, 179.9), ("b", 88.0, 0.0), ("c", 0.0, 0.0), ("n", None, 0.0)], "point_id string, lat double, lon double")
    o = spark.createDataFrame([(0.0, -179.9), (88.0, 10.0), (0.0, 5.0)], "lat double, lon double")
    assert {r.point_id: r.n_near for r in spatial.within_radius(p, o).collect()} == {"a": 1, "b": 1, "c": 0, "n": 0}


def test_event_multipliers_golden(spark):
    rows = [(c,) for c, n in (("Brazil", 239), ("Portugal", 38), ("India", 622)) for _ in range(n)]
    found = {r.country: round(r.multiplier, 6) for r in events.multipliers(spark.createDataFrame(rows, "country string")).collect()}
    assert found == {"Brazil": 1.192122, "Portugal": 1.030547, "India": 1.5}


def test_tracks_drop_units_row_and_missing(spark):
    rows = [("s", "Year", "deg", "deg", "kts", "kts", "n", "t"), ("s", "2001", "1.0", "2.0", "45", " ", "n", "t"), ("s", "2001", "1.0", "2.0", "30", "60", "n", "t"), ("s", "2001", " ", "2.0", "30", "60", "n", "t")]
    raw = spark.createDataFrame(rows, "sid string, season string, lat string, lon string, wmo_wind string, usa_wind string, name string, iso_time string")
    assert sorted(r.wind_kt for r in events.read_tracks(raw).collect()) == [45.0, 60.0]


def test_rank_sum_small_group_has_a_reason(spark):
    s = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, False), (4.0, False)], "value double, flag boolean")
    r = events.rank_sum_test(s).first()
    assert r.u is None and r.reason == "group below 3"


def test_domain_ignores_the_sentinel(spark):
    cells = spark.createDataFrame([("c", 0.1), ("c", 2.0), ("c", 9999.0), ("c", None)], "country string, value double")
    d = grid.domain(cells, "country", sentinel=9999.0)
    assert tuple(d.first()) == ("c", 0.1, 2.0, 2)
    assert sorted(r.scaled for r in grid.normalise(cells, d, "country", sentinel=9999.0).collect() if r.scaled is not None) == [0.0, 1.0, 1.0]


def test_many_to_one_guards(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="repeated"):
        quality.many_to_one(left, spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "k int, v int"), "k").collect()
    with pytest.raises(Exception, match="no partner"):
        quality.many_to_one(left, spark.createDataFrame([(1, 1)], "k int, v int"), "k").collect()


def test_require_none(spark):
    with pytest.raises(ValueError, match="twice"):
        quality.require_none(quality.duplicate_keys(spark.createDataFrame([(1,), (1,)], "k int"), "k"), "twice")


def test_saltelli_size_and_columns(spark):
    d = sensitivity.saltelli_draws(spark, 4)
    assert d.count() == 4 * 15
    rows = {(r.draw, r.matrix): r for r in d.collect()}
    name = sensitivity.NAMES[3]
    assert rows[0, name][name] == rows[0, "B"][name] and rows[0, name][sensitivity.NAMES[0]] == rows[0, "A"][sensitivity.NAMES[0]]


def test_zero_shift_gives_the_base_cut(spark, small):
    s = samples(spark, small)
    draw = spark.range(1).withColumnRenamed("id", "draw").select("draw", *(F.lit(0.0).alias(n) for n in sensitivity.NAMES))
    cuts = {(r.term, r.model): r.cut for r in sensitivity.high_cuts(draw, sensitivity.rank_table(s), ("draw",)).collect()}
    for r in risk.percentile_cuts(s).filter("term <> 'ws'").collect():
        assert cuts[r.term, r.model] == pytest.approx(r.p95 if r.term == "wind" else r.p90)


def test_precipitation_keeps_every_cell(spark):
    from riskgrid.catalogue import places

    parts = spark.read.parquet("/root/testdata/sf0.1/part.parquet").count()
    assert places.precip_cells(spark, "/root/testdata/sf0.1").count() == parts


@pytest.mark.parametrize("name", ["c12_correlation_gate", "c19_gate_sweep"])
def test_gate_queries_rank_in_two_levels(spark, small, name, monkeypatch):
    from riskgrid import queries as core
    from riskgrid.plans import ranks

    def refuse(*_):
        raise AssertionError("a window holds a whole group")

    monkeypatch.setattr(ranks, "window_ranks", refuse)
    assert core.QUERIES[name](spark, small).count() > 0


def test_results_do_not_depend_on_partitions(spark, small):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in (1, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            s = samples(spark, small)
            found.append(sorted(tuple(r) for r in risk.screening_index(risk.risk_bands(s)).select("plant_uid", "water_scenario", "model", "index_value", "label").collect() if r.index_value is not None))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sobol_finds_the_only_parameter(spark):
    d = sensitivity.saltelli_draws(spark, 256).withColumn("y", F.col("coal_decay_rate"))
    found = {r.param: r for r in sensitivity.sobol_indices(d, "y", resamples=5).collect()}
    assert found["coal_decay_rate"].st == pytest.approx(1.0, abs=0.1)
    assert max(abs(r.st) for p, r in found.items() if p != "coal_decay_rate") < 1e-9


@pytest.mark.parametrize("rows_a_range", [1_000_000, 7, 3])
def test_ranks_in_ranges(spark, rows_a_range, monkeypatch):
    from riskgrid.plans import ranks

    monkeypatch.setattr(ranks, "RANGE_ROWS", rows_a_range)
    rows = [("a", float((k * 7) % 23)) for k in range(100)] + [("b", 1.0), ("b", None), ("b", 1.0), (None, 4.0), (None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r.g, r.v): (r.low, r.high, r.n) for r in ranks.value_ranks(df, "v", "g").collect()}
    for g in ("a", "b", None, "c"):
        own = sorted(v for x, v in rows if x == g and v is not None)
        assert {v: lh for (x, v), lh in found.items() if x == g} == {v: (own.index(v), own.index(v) + own.count(v), len(own)) for v in own}
    halves = {r.g: (r.m, r.n) for r in ranks.percentiles(df, "v", {"m": 0.5}, "g").collect()}
    assert halves == {"a": (pytest.approx(11.0), 100), "b": (1.0, 2), None: (3.0, 2), "c": (None, 0)}
    assert tuple(ranks.percentiles(df, "v", {"m": 0.0}).first()) == (0.0, 104)


def test_ranges_stay_bounded(spark, monkeypatch):
    """One group holds nearly all values; no range holds much more than its share."""
    from riskgrid.plans import ranks
    from riskgrid.sources import sinks

    monkeypatch.setattr(ranks, "RANGE_ROWS", 500)
    made, keep = [], sinks.kept
    monkeypatch.setattr(sinks, "kept", lambda df: made.append(keep(df)) or made[-1])
    df = spark.range(20_000).selectExpr("if(id < 10, 'small', 'large') as g", "cast(id * 7919 % 20011 as double) as v")
    got = ranks.value_ranks(df, "v", "g").collect()
    sizes = [r["count"] for r in made[-1].groupBy("_b").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 2_000
    large = sorted((r.v, r.low) for r in got if r.g == "large")
    assert [low for _, low in large] == list(range(19_990))


def test_both_rank_plans_agree(spark):
    from riskgrid.plans import ranks

    df = spark.createDataFrame([("ab"[k % 2], float((k * 7) % 11)) for k in range(60)], "g string, v double")
    a, b = (sorted((r.g, r.v, r.rk) for r in f(df, {"rk": "v"}, "g").collect()) for f in (ranks.window_ranks, ranks.with_average_ranks))
    assert a == b
