"""Cell-clipped polygons, scan lines, covering cells, counted U tests, stream deltas, per-file variables and tiled layers against plain versions."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from riskgrid.catalogue import base, chain, gates, reports, results, studies
from riskgrid.functions import config as C
from riskgrid.operators import assets, events, gate, grid, report, risk, sensitivity, spatial
from riskgrid.plans import carriers
from riskgrid.sources import sinks, tables
from riskgrid.streaming import annual_max

RINGS = "poly_id long, seq long, gid string, value double, rings array<array<struct<x:double,y:double>>>"


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            n += min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


def table(spark, polygons):
    return spark.createDataFrame([(k, k, f"g{k}", float(k), [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in enumerate(polygons)], RINGS)


def shapes(seed=11):
    """Stars, boxes and stairs on cell borders, with holes, islands and flat edges."""
    rng = random.Random(seed)
    out = [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]], [[(2, 2), (6, 2), (6, 6), (4, 6), (4, 4), (2, 4)]], [[(-3, -3), (-1, -3), (-1, -1)], [(5, -4), (7, -4), (6, -2)]]]
    for _ in range(5):
        n, cx, cy = rng.randint(3, 40), rng.uniform(-5, 5), rng.uniform(-5, 5)
        out.append([[(cx + rng.uniform(0.3, 4) * math.cos(2 * math.pi * k / n), cy + rng.uniform(0.3, 4) * math.sin(2 * math.pi * k / n)) for k in range(n)]])
    return out


@pytest.mark.parametrize("side", [None, 0.25, 1.0, 2.0, 16.0])
def test_points_meet_their_cells_edges(spark, side):
    rng, polygons = random.Random(5), shapes()
    points = [(f"r{k}", rng.uniform(-8, 8), rng.uniform(-8, 8)) for k in range(300)] + [(f"c{x},{y}", x / 2, y / 2) for x in range(-8, 16) for y in range(-8, 14)]
    got = {tuple(r) for r in spatial.containing(spark.createDataFrame(points, "point_id string, x double, y double"), table(spark, polygons), side=side).collect()}
    assert got == {(p, k) for p, x, y in points for k, rings in enumerate(polygons) if inside(x, y, rings)}


def test_a_polygon_of_many_edges(spark):
    """100,000 edges: no cell holds more than a few hundred, and cells are about as many as edges."""
    n = 100_000
    edge = lambda k: (30 + (20 + 2 * math.sin(40 * k)) * math.cos(2 * math.pi * k / n), (20 + 2 * math.sin(40 * k)) * math.sin(2 * math.pi * k / n))
    ring = [edge(k) for k in range(n)]
    polygons = table(spark, [[ring]])
    index, side = spatial.cell_index(polygons)
    most, cells = index.filter("x1 is not null").groupBy("cx", "cy").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert side == 2.0 ** round(math.log2(side)) and most < n / 20 and cells < 4 * n and index.filter("x1 is null").count() < 4 * n
    rng = random.Random(2)
    points = [(f"p{k}", 30 + rng.uniform(-23, 23), rng.uniform(-23, 23)) for k in range(60)]
    got = {r.point_id for r in spatial.containing(spark.createDataFrame(points, "point_id string, x double, y double"), polygons).collect()}
    assert got == {p for p, x, y in points if inside(x, y, [ring])}


@pytest.mark.parametrize("res, width, height", [(1.0, 16, 14), (0.3, 50, 47)])
def test_scan_lines_equal_points(spark, res, width, height):
    polygons = shapes(3)
    got = {(r.row, r.col): r.value for r in spatial.rasterise((-7.0, 7.0, res), width, height, table(spark, polygons)).collect()}
    assert len(got) == width * height
    for (row, col), value in got.items():
        x, y = -7.0 + (col + 0.5) * res, 7.0 - (row + 0.5) * res
        held = [k for k, rings in enumerate(polygons) if inside(x, y, rings)]
        assert value == (float(max(held)) if held else None)


@pytest.mark.parametrize("crowded", [-1, 4])
def test_radius_join_counts_whole_cells(spark, crowded, monkeypatch):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    rng = random.Random(4)

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for low, high, lon in ((-90, 90, 180), (88.5, 90, 180), (-1, 1, 1)):
        points = [(f"p{k}", rng.uniform(low, high), rng.uniform(-lon, lon)) for k in range(60)] + [("e", 0.0, 180.0), ("n", 90.0, 3.0), ("x", None, 1.0)]
        others = [(rng.uniform(low, high), rng.uniform(-lon, lon)) for _ in range(600)] + [(0.0, -179.95), (0.0, -180.0), (90.0, 7.0), (None, 1.0)]
        got = {r.point_id: r.n_near for r in spatial.within_radius(spark.createDataFrame(points, "point_id string, lat double, lon double"), spark.createDataFrame(others, "lat double, lon double")).collect()}
        assert got == {p: sum(km(a, b, c, d) <= 100 for c, d in others if None not in (a, b, c, d)) if a is not None else 0 for p, a, b in points}


def test_a_crowded_lane_costs_its_rim(spark, monkeypatch):
    """200 points beside 20,000 within a few kilometres: whole cells decide most pairs."""
    asked, haversine = [], spatial._reachable
    monkeypatch.setattr(spatial, "_reachable", lambda *a: asked.append(haversine(*a)) or asked[-1])
    lane = spark.range(20_000).selectExpr("10 + (id % 100) / 1000.0D as lat", "20 + (id div 100) / 2000.0D as lon")
    points = spark.range(200).selectExpr("cast(id as string) as point_id", "10 + id / 400.0D as lat", "20.0D as lon")
    found = spatial.within_radius(points, lane, 30.0)
    assert asked[0].count() < 200 * 20_000 / 20
    got = {int(r.point_id): r.n_near for r in found.collect()}
    direct = points.crossJoin(lane.withColumnsRenamed({"lat": "olat", "lon": "olon"})).filter(spatial.X.haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= 30).groupBy("point_id").count().collect()
    assert {int(r.point_id): r["count"] for r in direct} == {k: n for k, n in got.items() if n}


def test_counted_tails():
    for m, n in ((3, 3), (3, 5), (4, 4)):
        us = [sum(r for r in rows) - m * (m + 1) / 2 for rows in itertools.combinations(range(1, m + n + 1), m)]
        assert events.exact_tails(m, n) == pytest.approx([sum(u >= k for u in us) / len(us) for k in range(m * n + 1)])


def test_rank_sum_p_is_exact_for_small_groups(spark):
    rows = [("a", 1.0, True), ("a", 2.0, True), ("a", 3.0, True), ("a", 4.0, False), ("a", 5.0, False), ("a", 6.0, False), ("a", 7.0, False), *(("b", float(k // 2), k % 3 == 0) for k in range(12)), ("c", 1.0, True), ("c", None, False)]
    got = {r.g: r for r in events.rank_sum_test(spark.createDataFrame(rows, "g string, value double, flag boolean"), ("g",)).collect()}
    assert (got["a"].u, got["a"].method) == (0.0, "exact") and got["a"].p == pytest.approx(2 / 35)
    assert got["b"].method == "asymptotic" and 0 < got["b"].p <= 1 and got["c"].reason == "group below 3" and got["c"].p is None


def test_rank_sum_of_many_ties(spark):
    df = spark.range(10_000_000).selectExpr("cast(id % 2 as double) as value", "id % 3 = 0 as flag")
    r = events.rank_sum_test(df).first()
    assert (r.n1, r.n2) == (3_333_334, 6_666_666) and r.z is not None and r.p > 0.9


def test_deltas_hold_new_keys_only(spark, tmp_path):
    feed, sink, progress = (str(tmp_path / n) for n in ("feed", "state", "progress"))
    schema, want = "cell long, year long, value double", {}
    for k in range(7):
        rows = [(c, 2000, float((c * k) % 13)) for c in range(500 if k == 0 else 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        for c, y, v in rows:
            want[c, y] = max(v, want.get((c, y), v))
        got = annual_max.fold(spark, feed, schema, sink, progress, deltas=4)
        assert {(r.cell, r.year): r.top for r in got.collect()} == want
        names = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "state").iterdir()}
        assert len([n for n in names if n.startswith("delta")]) < 4 and len([n for n in names if n.startswith("base")]) <= 1
        if k in (1, 2):
            assert names[f"delta-{k:09d}"] == 3
    assert [n for n in names if n.startswith("base")] == ["base-000000003"]


def test_an_unfinished_compaction_does_no_harm(spark, tmp_path):
    sink = str(tmp_path / "state")
    for name, top in (("base-000000001", 5.0), ("delta-000000001", 4.0), ("delta-000000002", 7.0)):
        spark.createDataFrame([(1, 2000, top)], "cell long, year long, top double").write.parquet(f"{sink}/{name}")
    (tmp_path / "state" / "base-000000009").mkdir()
    assert [tuple(r) for r in annual_max.read(spark, sink).collect()] == [(1, 2000, 7.0)]
    annual_max.compact(spark, sink)
    assert [tuple(r) for r in annual_max.read(spark, sink).collect()] == [(1, 2000, 7.0)]


def series_folder(spark, path, names):
    for year, columns in names.items():
        made = {"pr": "id * 1.0 as pr", "tp": "if(id = 2, null, id * 10.0) as tp", "note": "'n' as note", "x": "1 as x"}
        spark.range(4).selectExpr("id as cell", *(made[c] for c in columns)).write.parquet(f"{path}/year={year}")
    return path


def test_each_file_gives_its_own_variable(spark, tmp_path):
    path = series_folder(spark, str(tmp_path / "s"), {2001: ["pr", "note"], 2002: ["tp"], 2003: ["tp", "pr"], 2009: ["x"]})
    got = {(r.year, r.cell): r.value for r in tables.read_series(spark, path, ("tp", "pr"), 2001, 2003).collect()}
    assert got == {(y, c): float(c) if y == 2001 else None if c == 2 else c * 10.0 for y in (2001, 2002, 2003) for c in range(4)}
    assert "note" in tables.read_series(spark, path, ("pr", "tp"), 2001, 2002).columns
    with pytest.raises(ValueError, match="2009"):
        tables.read_series(spark, path, ("pr", "tp"), 2001, 2009)
    with pytest.raises(ValueError, match="no file"):
        tables.read_series(spark, path, ("pr", "tp"), 1900, 1901)


def test_tiles_prune_the_layers(spark, small):
    cells, plants, keys = carriers.cells(spark, small), carriers.plants(spark, small).filter("lat > 37"), carriers.scenario_keys(spark)
    tiled = spark.read.parquet(sinks.write_tiled(cells, sinks.scratch(spark), 2))
    found = grid.sample_tiled(plants, tiled, keys, carriers.GRID, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    want = grid.sample_terms(plants, cells, keys, carriers.GRID)
    names = ("plant_uid", "water_scenario", "model", "term", "value")
    assert sorted(map(str, found.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


def test_complete_rows_are_counted_once(spark, small):
    drawn = sensitivity.saltelli_draws(spark, 1)
    samples = carriers.plants(spark, small).limit(40).crossJoin(F.broadcast(carriers.scenario_keys(spark))).withColumn("value", F.col("lon"))
    plan = sensitivity.index_means(samples, drawn, ("draw", "matrix"), strata=("country",))._jdf.queryExecution().optimizedPlan().toString()
    assert "_gone" not in plan


def test_folders_of_tiles_do_not_grow_with_the_layer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TILE_FOLDERS", 4)
    cells = spark.range(1600).selectExpr("'ws' as term", "'bau' as scenario", "'-' as model", "int(id div 40) as row", "int(id % 40) as col", "double(id) as value")
    path = sinks.write_tiled(cells, str(tmp_path / "t"), 2)
    files = [f for f in tmp_path.rglob("*.parquet") if f.is_file()]
    assert len(files) <= 4 and spark.read.parquet(path).select("tile_row", "tile_col").distinct().count() == 400
    plants = spark.createDataFrame([("a", 3.5, 38.5), ("b", 39.5, 0.5)], "plant_uid string, lon double, lat double")
    keys = spark.createDataFrame([("bau", "m", "ws", "bau", "-")], "water_scenario string, model string, term string, layer_scenario string, layer_model string")
    found = grid.sample_tiled(plants, spark.read.parquet(path), keys, carriers.GRID, 2)
    assert {r.plant_uid: r.value for r in found.collect()} == {"a": 43.0, "b": 1599.0}


def test_samples_are_spelled_out_in_dealt_tasks(spark, monkeypatch):
    monkeypatch.setattr(grid, "PLANTS_A_TASK", 10)
    monkeypatch.setattr(grid, "FEW_CELLS", 6)
    keys = spark.createDataFrame([("opt", "m", "ws", "opt", "-"), ("bau", "m", "ws", "bau", "-"), ("opt", "m", "wind", "-", "-")], "water_scenario string, model string, term string, layer_scenario string, layer_model string")
    cells = spark.createDataFrame([("ws", "opt", "-", 0, c, float(c)) for c in range(4)] + [("ws", "opt", "-", 0, 1, 9.0), ("wind", "-", "-", 0, 0, None), ("wind", "-", "-", 7, 7, 1.0)], "term string, scenario string, model string, row int, col int, value double")
    for columns in (4, 9):  # few cells and many
        rows = [(f"p{k}", k % columns + 0.5, 39.5) for k in range(95)] + [("off", 60.0, 39.5), ("none", None, None)]
        plants = spark.createDataFrame(rows, "plant_uid string, lon double, lat double").coalesce(1)
        found = grid.sample_terms(plants, cells, keys, carriers.GRID)
        if columns == 4:
            assert found.rdd.getNumPartitions() == 10
        got = sorted((r.plant_uid, r.water_scenario, r.term, str(r.value)) for r in found.collect())
        value = {0: ["0.0"], 1: ["1.0", "9.0"], 2: ["2.0"], 3: ["3.0"]}
        want = [(p, "opt", "ws", v) for p, x, _ in rows for v in value.get(int(x) if x is not None else -1, ["None"])] + [(p, s, t, "None") for p, *_ in rows for s, t in (("bau", "ws"), ("opt", "wind"))]
        assert got == sorted(want)


def test_layers_are_spelled_out_in_dealt_tasks(spark, small, monkeypatch):
    monkeypatch.setattr(carriers, "PARTS_A_TASK", 50)
    assert carriers.cells(spark, small).rdd.getNumPartitions() == 4


def test_wide_terms_shrink_before_the_shuffle(spark):
    rows = spark.createDataFrame([("p", "ws", 1.0), ("p", "ws", 3.0), ("p", "heat", None), ("q", "other", 1.0)], "plant_uid string, term string, value double")
    found = grid.wide(rows, "plant_uid", terms=("ws", "heat"))
    assert {tuple(r) for r in found.collect()} == {("p", 3.0, None), ("q", None, None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_unmapped_fuel_raises_when_strict(spark):
    plants = spark.createDataFrame([("A", "coal", False, "coal"), ("B", "peat", False, "peat")], "plant_name string, fuel_type string, mixed_fuel_type boolean, fuel_types_found string")
    assert [r.bucket for r in assets.with_bucket(plants).orderBy("plant_name").collect()] == ["thermal", None]
    with pytest.raises(Exception, match="no bucket for the fuels of B: peat"):
        assets.with_bucket(plants, strict=True).collect()


def test_places_by_absolute_value(spark):
    rows = spark.createDataFrame([("a", -5.0), ("b", 5.0), ("c", None), ("d", 1.0), ("e", -9.0), ("f", None)], "k string, v double")
    assert {r.k: r.place for r in report.by_absolute(rows, "v").collect()} == {"e": 1, "a": 2, "b": 2, "d": 4, "c": 5, "f": 5}


def test_tracks_of_a_country_without_a_basin(spark):
    tracks = spark.createDataFrame([("W", "s1", 1.0, 1.0), ("W", "s1", 2.0, 1.0), ("W", "s2", None, 1.0), ("E", "s3", 1.0, 1.0)], "basin string, sid string, lat double, lon double")
    countries = spark.createDataFrame([("P", "W"), ("Q", "W"), ("R", "N"), ("S", None)], "country string, basin string")
    assert {r.country: (r.points, r.storms) for r in events.track_summary(tracks, countries).collect()} == {"P": (2, 1), "Q": (2, 1), "R": (0, 0), "S": (0, 0)}


def refuse(*_):
    raise AssertionError("samples of every plant")


def test_bounds_come_from_cells(spark, small, monkeypatch):
    for module in (base, chain, reports):
        monkeypatch.setattr(module, "samples", refuse)
    for name in ("q4_frozen_bounds", "a11_global_bounds", "q4_bounds_drift", "s10_nested_round_trip"):
        base.QUERIES[name](spark, small).collect()


def test_one_plant_a_cell_stands_for_all(spark, small):
    own = carriers.plants(spark, small)
    twice = own.unionByName(own.withColumn("plant_uid", F.concat("plant_uid", F.lit("b"))))
    a, b = (grid.one_a_cell(x, carriers.GRID, "country", "bucket") for x in (own, twice))
    assert a.count() == b.count()
    assert 2 * a.agg(F.sum("plants")).first()[0] == b.agg(F.sum("plants")).first()[0] == 2 * own.count()
    keys = carriers.scenario_keys(spark)
    each, all_ = (grid.sample_terms(x, carriers.cells(spark, small), keys, carriers.GRID) for x in (a, own))
    by = ("country", "bucket", "water_scenario", "model", "term", "value")
    told = lambda df, n: sorted(map(str, df.groupBy(*by).agg(n.alias("n")).collect()))
    assert told(each, F.sum("plants")) == told(all_, F.count(F.lit(1)))


def test_cuts_come_from_cells(spark, small, monkeypatch):
    for module in (base, chain, reports):
        monkeypatch.setattr(module, "samples", refuse)
    monkeypatch.setattr(base, "_CUTS", {})
    for name in ("c23_cuts_table", "a12_percentile_cuts"):
        base.QUERIES[name](spark, small).collect()
    base.cuts(spark, small)


def test_the_index_comes_from_cells(spark, small, monkeypatch):
    want = risk.screening_index(base.bands(spark, small))
    monkeypatch.setattr(base, "samples", refuse)
    found = base.index(spark, small)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert studies.a29(spark, small).count() > 0


def test_shared_ids_have_their_index_from_all_rows(spark, small, monkeypatch):
    real = carriers.plants
    monkeypatch.setattr(carriers, "plants", lambda *a: real(*a).withColumn("plant_uid", F.substring("plant_uid", 1, 5)))
    for kept in ("_SAMPLES", "_ALIKE", "_CUTS", "_OWN"):
        monkeypatch.setattr(base, kept, {})
    assert not base.own_ids(spark, small)
    want = risk.screening_index(base.bands(spark, small))
    assert sorted(map(str, base.index(spark, small).select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_risks_and_bands_are_not_joined_by_plant(spark, small, monkeypatch):
    keys = ["plant_uid", "term", "water_scenario", "model"]
    want = base.risks(spark, small).join(base.bands(spark, small).select(*keys, "risk_band"), keys, "left").select(*keys, base.single("risk").alias("risk"), "risk_band")
    monkeypatch.setattr(reports, "samples", refuse)
    found = reports.j11(spark, small)
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert found.filter("risk_band is null").count() > 0


def test_shared_places_are_taken_once(spark, monkeypatch):
    spots = [(40.0 + i % 4 / 2, 1.0 + i % 3 / 2) for i in range(12)]
    points = spark.createDataFrame([(f"p{k}", *spots[k % 12]) for k in range(60)] + [("none", None, 1.0)], "point_id string, lat double, lon double")
    others = spark.createDataFrame([spots[k % 12] for k in range(240)] + [(None, 2.0)], "lat double, lon double")
    want = {f"p{k}": sum(20 for b, d in spots if _km(*spots[k % 12], b, d) <= 100) for k in range(60)} | {"none": 0}
    real, met = spatial._reachable, []
    monkeypatch.setattr(spatial, "_reachable", lambda *a: met.append((a[0].count(), a[1].count())) or real(*a))
    for crowded in (0, spatial.CROWDED):
        monkeypatch.setattr(spatial, "CROWDED", crowded)
        found = spatial.within_radius(points, others, 100.0)
        assert found.columns == ["point_id", "lat", "lon", "n_near"]
        assert {r.point_id: r.n_near for r in found.collect()} == want
    assert met == [(12, 12)] * 2


def _km(a, b, c, d):
    p = [math.radians(x) for x in (a, b, c, d)]
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((p[2] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(p[2]) * math.sin((p[3] - p[1]) / 2) ** 2))


def test_the_gate_counts_plants_by_cells(spark, small, monkeypatch):
    def told(df):
        return sorted(map(str, df.select(*("term_a", "term_b", "bucket", "country", "model", "n", "verdict"), *(F.round(c, 8) for c in ("pearson_r", "spearman_rho"))).collect()))

    want = {change: told(gate.run_gate(change(base.samples(spark, small)), small_groups=True)) for change in (lambda s: s, gates.mixed)}
    for module in (base, gates, results):
        monkeypatch.setattr(module, "samples", refuse)
    for change, rows in want.items():
        assert told(gates.gated(spark, small, change)) == rows
    assert results.c21g(spark, small).count() > 0


def test_a_gate_row_counts_as_often_as_its_weight(spark):
    keys = ("hydro", "bau", C.MODELS[0])
    values = [(f"p{k}", "X", *keys, t, v, k % 4 + 1) for k in range(9) for t, v in (("sv", 1e6 + k % 5), ("iv", float(k * k % 7)))]
    names = "plant_uid string, country string, bucket string, water_scenario string, model string, term string, value double"
    one = spark.createDataFrame(values, f"{names}, plants long")
    many = spark.createDataFrame([(f"{v[0]}-{i}", *v[1:-1]) for v in values for i in range(v[-1])], names)
    found = [sorted((r.country, r.n, r.pearson_r, r.spearman_rho) for r in df.collect()) for df in (gate.run_gate(one, weight=F.col("plants")), gate.run_gate(many), gate.run_gate(many, small_groups=True))]
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert [x[2:] for x in other] == [pytest.approx(x[2:], abs=1e-9) for x in found[0]]
