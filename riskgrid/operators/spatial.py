"""Spatial joins as equi-joins on coarse cells with exact residual tests."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.sources import sinks

from . import grid as layers

#: Side of index cells in degrees where polygons have no extent.
COARSE = 2.0


def edges(polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """One row an edge of every ring (rings: array<array<struct<x, y>>>, closed or not)."""
    ring = polygons.select(key, F.explode("rings").alias("r"))
    nxt = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    pair = ring.select(key, F.explode(F.arrays_zip(F.col("r").alias("a"), nxt.alias("b"))).alias("e"))
    return pair.select(key, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).filter("x1 <> x2 or y1 <> y2")


def _spans(crossings: DataFrame, *line: str) -> DataFrame:
    """Filled spans of each line: line, start, end (exclusive), from the places ``k`` where the filling changes.

    A place that an even number of edges share changes nothing.
    """
    odd = crossings.groupBy(*line, "k").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1")
    w = Window.partitionBy(*line).orderBy("k")
    return odd.withColumns({"_i": F.row_number().over(w), "end": F.lead("k").over(w)}).filter("_i % 2 = 1 and end is not null").select(*line, F.col("k").alias("start"), "end")


def _first_at_or_after(x: Column, place: Callable[[Column], Column], guess: Column) -> Column:
    """Smallest k with place(k) >= x, given a guess that rounding can put one off; places are compared as they are computed elsewhere."""
    return F.when(place(guess - 1) >= x, guess - 1).when(place(guess) >= x, guess).otherwise(guess + 1)


def _crossing(y: Column) -> Column:
    """Where an edge crosses the height y."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))


def _spanned(y: Column) -> Column:
    """Whether a height lies in an edge's half-open span, so that a shared corner counts once."""
    return (F.least("y1", "y2") <= y) & (y < F.greatest("y1", "y2"))


def fitting_side(e: DataFrame, key: str = "poly_id") -> float:
    """Side of index cells, a power of two: polygons have about as many cells as edges, so neither table outgrows the other."""
    boxes = e.groupBy(key).agg(*((F.max(F.greatest(f"{a}1", f"{a}2")) - F.min(F.least(f"{a}1", f"{a}2"))).alias(a) for a in "xy"), F.count(F.lit(1)).alias("n"))
    area, n = boxes.agg(F.sum(F.col("x") * F.col("y")), F.sum("n")).first()
    return 2.0 ** math.floor(math.log2(math.sqrt(area / n))) if area else COARSE


def cell_index(polygons: DataFrame, key: str = "poly_id", side: float | None = None) -> tuple[DataFrame, float]:
    """Index of polygons by cells (cx, cy), and the cells' side.

    One row for each cell whose lower right corner is inside (``x1`` null), and
    one for each edge that comes near a cell. Cells that no edge comes near and
    whose corner is outside have no row; those inside have just the one. A
    corner's state comes from a scan along the cell rows' lower lines.
    """
    e = edges(polygons, key)
    side = side or fitting_side(e, key)
    rows = F.sequence(F.ceil(F.least("y1", "y2") / side), F.ceil(F.greatest("y1", "y2") / side) - 1)
    lines = e.filter(F.ceil(F.least("y1", "y2") / side) < F.ceil(F.greatest("y1", "y2") / side)).withColumn("cy", F.explode(rows))
    met = lines.filter(_spanned(F.col("cy") * side)).withColumn("_x", _crossing(F.col("cy") * side))
    at = met.select(key, "cy", _first_at_or_after(F.col("_x"), lambda k: (k + 1) * F.lit(side), F.ceil(F.col("_x") / side) - 1).alias("k"))
    inside = _spans(at, key, "cy").select(key, F.explode(F.sequence("start", F.col("end") - 1)).alias("cx"), "cy")
    near = side * 1e-6
    tall = e.withColumn("cy", F.explode(F.sequence(F.floor((F.least("y1", "y2") - near) / side), F.floor((F.greatest("y1", "y2") + near) / side))))
    low, high = (F.greatest(F.least("y1", "y2"), F.col("cy") * side - near), F.least(F.greatest("y1", "y2"), (F.col("cy") + 1) * side + near))
    flat = F.col("y1") == F.col("y2")
    ends = [F.when(flat, F.col(x)).otherwise(_crossing(y)) for x, y in (("x1", low), ("x2", high))]
    wide = tall.withColumn("cx", F.explode(F.sequence(F.floor((F.least(*ends) - near) / side), F.floor((F.greatest(*ends) + near) / side))))
    return inside.select(key, "cx", "cy", *(F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).unionByName(wide.select(key, "cx", "cy", "x1", "y1", "x2", "y2")), side


def containing(points: DataFrame, polygons: DataFrame, point: str = "point_id", key: str = "poly_id", side: float | None = None) -> DataFrame:
    """Pairs (point, polygon) where the point (x, y) lies inside by ray crossing.

    A point meets only the edges of its own cell: its state differs from that
    of the cell's lower right corner by the edges crossed on the way there.
    Edges elsewhere in the cell's row are crossed as often from both, but for
    those that end between the two heights right of the cell; they end in pairs,
    and where one of a pair is the cell's own, it says so. Crossings use
    half-open spans, so a shared edge counts once; holes and parts follow from
    parity.
    """
    index, side = cell_index(polygons, key, side)
    placed = points.filter("x is not null and y is not null").select(point, "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    right, base = (F.col("cx") + 1) * side, F.col("cy") * side
    hit = lambda x, y: (_spanned(y) & (x < _crossing(y))).cast("int")
    ends = sum((((F.col(f"x{k}") > right) & (base < F.col(f"y{k}")) & (F.col(f"y{k}") <= F.col("y"))).cast("int") for k in (1, 2)), F.lit(0))
    level = F.col("y1") == F.col("y2")
    own = F.when(F.col("x1").isNull(), 1).when(level, ends).otherwise(ends + hit(F.col("x"), F.col("y")) + hit(right, base))
    return placed.join(index, ["cx", "cy"]).groupBy(point, key).agg(F.sum(own).alias("n")).filter(F.col("n") % 2 == 1).select(point, key)


def first_polygon(points: DataFrame, polygons: DataFrame, point: str = "point_id", attribute: str = "gid") -> DataFrame:
    """Every point with the attribute of the first polygon (by seq) that holds it; null where none does."""
    hit = containing(points, polygons, point).join(polygons.select("poly_id", "seq", attribute), "poly_id")
    return points.join(hit.groupBy(point).agg(F.min_by(attribute, "seq").alias(attribute)), point, "left")


def filled_spans(grid: tuple[float, float, float], polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """Columns whose centres each polygon holds, row by row of a grid: key, row, start, end (exclusive), on a grid without bounds.

    A scan line through the centres of each row: an edge is met by the rows it
    crosses only, and a row's sorted crossings are the ends of its spans.
    """
    xmin, ymax, res = grid
    e = edges(polygons, key).filter("y1 <> y2")
    row_of = lambda y: F.floor((F.lit(ymax) - y) / res - 0.5)
    centre = F.lit(ymax) - (F.col("row") + 0.5) * res
    rows = e.withColumn("row", F.explode(F.sequence(row_of(F.greatest("y1", "y2")), row_of(F.least("y1", "y2")) + 1))).filter(_spanned(centre)).withColumn("_x", _crossing(centre))
    guess = F.ceil((F.col("_x") - xmin) / res - 0.5)
    k = _first_at_or_after(F.col("_x"), lambda c: F.lit(xmin) + (c + 0.5) * res, guess)
    return _spans(rows.select(key, "row", k.alias("k")), key, "row")


def burned(grid: tuple[float, float, float], width: int, height: int, polygons: DataFrame, value: str = "value") -> DataFrame:
    """Filled cells of a grid (row, col) with the value of the last polygon (by seq) that holds their centre."""
    spans = filled_spans(grid, polygons).filter(F.col("row").between(0, height - 1)).withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", F.lit(width))}).filter("start < end")
    cells = spans.join(polygons.select("poly_id", "seq", value), "poly_id").select(F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("start").cast("int"), (F.col("end") - 1).cast("int"))).alias("col"), "seq", value)
    return cells.groupBy("row", "col").agg(F.max_by(value, "seq").alias(value))


def rasterise(grid: tuple[float, float, float], width: int, height: int, polygons: DataFrame, value: str = "value") -> DataFrame:
    """All cells of a grid with the value of the last polygon (by seq) that holds their centre; null outside. The work before the last join follows edges and filled cells."""
    cells = polygons.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return cells.join(burned(grid, width, height, polygons, value), ["row", "col"], "left")


def zonal_mean(cells: DataFrame, grid: tuple[float, float, float], polygons: DataFrame, by: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """Mean of a layer's known cells whose centres each polygon holds; null where there is none.

    ``by`` names columns that tell layers apart, ``groups`` (a few rows) lists
    their values. Filled spans become cells only within the layers' own rows and
    columns.
    """
    known = cells.filter("value is not null").select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    box = F.broadcast(known.agg(*(f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("least", F.min), ("most", F.max)))))
    spans = filled_spans(grid, polygons).crossJoin(box).filter("row between least_row and most_row").withColumns({"start": F.greatest("start", "least_col"), "end": F.least("end", F.col("most_col") + 1)}).filter("start < end")
    filled = spans.select("poly_id", "row", F.explode(F.sequence("start", F.col("end") - 1)).alias("col"))
    inside = filled.join(known, ["row", "col"])
    every = polygons.select("poly_id") if groups is None else polygons.select("poly_id").crossJoin(F.broadcast(groups))
    return every.join(inside.groupBy("poly_id", *by).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("cells")), ["poly_id", *by], "left")


def _reachable(points: DataFrame, others: DataFrame, km: float, keep: list[str]) -> DataFrame:
    """Pairs of points (lat, lon and others) and others (olat, olon and ``keep``) among which are all within ``km``.

    Others go to the latitude bands and longitude cells that their circle can
    reach; the cell width follows the band's widest circle, and where circles
    come near a pole the whole band is one cell.
    """
    deg = km / 111.0

    def spread(band: Column) -> Column:
        top = F.greatest(F.abs(band * deg), F.abs((band + 1) * deg))
        return F.when(top + 2 * deg < 90, deg / F.cos(F.radians(top + deg))).otherwise(360.0)

    placed = points.withColumn("band", F.floor(F.col("lat") / deg)).withColumn("cell", F.floor((F.col("lon") + 180.0) / spread(F.col("band"))))
    near = others.select("olat", "olon", *keep).withColumn("band", F.explode(F.sequence(F.floor(F.col("olat") / deg) - 1, F.floor(F.col("olat") / deg) + 1)))
    at = F.floor((F.col("olon") + 180.0) / spread(F.col("band")))
    last = F.floor(F.lit(360.0) / spread(F.col("band")))
    wrapped = F.array_distinct(F.transform(F.sequence(at - 1, at + 1), lambda c: F.when(c < 0, last + c + 1).when(c > last, c - last - 1).otherwise(c)))
    near = near.withColumn("cell", F.explode(F.array_union(wrapped, F.when(at <= 1, F.array(last, last - 1)).when(at >= last - 1, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.array().cast("array<bigint>")))))
    return placed.join(near, ["band", "cell"]).drop("band", "cell")


#: Fine cells along a radius: the share of a circle that its rim takes is about six times the inverse.
FINE = 32
#: Points of a fine cell, on the average of all points, from which cells are worth their joins.
CROWDED = 4


def _fine_cells(points: DataFrame, km: float, names: tuple[str, str]) -> DataFrame:
    """``points`` with their fine cell: _band and _cell, its centre (``names``) and _reach, the kilometres from it to any point of the cell."""
    deg = km / 111.0 / FINE
    band = F.floor(F.col("lat") / deg)
    top = F.least(F.lit(89.5), F.greatest(F.abs(band * deg), F.abs((band + 1) * deg)))
    width = deg / F.cos(F.radians(top))
    placed = points.withColumns({"_band": band, "_width": width}).withColumn("_cell", F.floor((F.col("lon") + 180.0) / F.col("_width")))
    lat, lon = (F.col("_band") + 0.5) * deg, (F.col("_cell") + 0.5) * F.col("_width") - 180.0
    corner = lambda up: X.haversine_km(lat, lon, F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (F.col("_band") + up) * deg)), lon + F.col("_width") / 2)
    return placed.withColumns({names[0]: lat, names[1]: lon, "_reach": F.greatest(corner(0), corner(1)) + 1e-6}).drop("_width")


def within_radius(points: DataFrame, others: DataFrame, km: float = C.RADIUS_KM, point: str = "point_id") -> DataFrame:
    """Number of other points (lat, lon) within a great-circle radius of each point (lat, lon).

    Places that several points share are taken once on both sides, so work
    follows places. Other places are counted by fine cells first. Where they
    crowd (an average one shares its cell with CROWDED others), both sides are
    gathered in cells:
    two cells that lie wholly within the radius of each other add the other
    cell's count to all points of the first, and only cells on the rim meet
    point by point, so crowded places cost as much as their rim. Elsewhere points
    meet directly. Points without a near one get 0.
    """
    here = ("lat", "lon")
    known = sinks.kept(points.filter("lat is not null and lon is not null").select(*here).distinct())
    near = sinks.kept(others.filter("lat is not null and lon is not null").groupBy(*here).agg(F.count(F.lit(1)).alias("_times")))
    theirs = _fine_cells(near, km, ("olat", "olon"))
    cells = sinks.kept(theirs.groupBy(F.col("_band").alias("oband"), F.col("_cell").alias("ocell"), "olat", "olon", F.col("_reach").alias("oreach")).agg(F.sum("_times").alias("_n"), F.count(F.lit(1)).alias("_places")))
    crowd = cells.agg(F.sum(F.col("_places").cast("double") * F.col("_places")) / F.sum("_places")).first()[0] or 0.0
    cells = cells.drop("_places")
    if crowd <= CROWDED:
        met = _reachable(known, near.select(F.col("lat").alias("olat"), F.col("lon").alias("olon"), "_times"), km, ["_times"]).filter(X.haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= km)
        return _with_counts(points, met.groupBy(*here).agg(F.sum("_times").alias("n_near")))
    mine = _fine_cells(known, km, ("clat", "clon"))
    own = mine.groupBy("_band", "_cell", F.col("clat").alias("lat"), F.col("clon").alias("lon"), "_reach").agg(F.count(F.lit(1)).alias("_points"))
    far = km * (1.0 + 4.0 / FINE)  # two cells reach less than that beyond the radius; wide ones near the poles lie within it anyway
    pairs = _reachable(own, cells, far, ["oband", "ocell", "oreach", "_n"])
    apart, slack = X.haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")), F.col("_reach") + F.col("oreach")
    met = pairs.withColumn("_whole", apart + slack <= km).filter(apart - slack <= km).select("_band", "_cell", "oband", "ocell", "_n", "_whole")
    whole = met.filter("_whole").groupBy("_band", "_cell").agg(F.sum("_n").alias("_inner"))
    rim = met.filter("not _whole").select("_band", "_cell", "oband", "ocell")
    there = theirs.select(F.col("_band").alias("oband"), F.col("_cell").alias("ocell"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), "_times")
    tested = mine.select(*here, "_band", "_cell").join(rim, ["_band", "_cell"]).join(there, ["oband", "ocell"])
    edge = tested.filter(X.haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= km).groupBy(*here).agg(F.sum("_times").alias("_part"))
    inner = mine.select(*here, "_band", "_cell").join(whole, ["_band", "_cell"]).select(*here, F.col("_inner").alias("_part"))
    return _with_counts(points, inner.unionByName(edge).groupBy(*here).agg(F.sum("_part").alias("n_near")))


def _with_counts(points: DataFrame, counts: DataFrame) -> DataFrame:
    """``points`` with n_near, the count of their place (lat, lon); 0 where it has none."""
    return points.join(counts, ["lat", "lon"], "left").select(*points.columns, F.coalesce("n_near", F.lit(0)).alias("n_near"))


def largest_part(polygons: DataFrame) -> DataFrame:
    """Each polygon's ring of the largest area, as its only ring."""
    ring = polygons.select("*", F.posexplode("rings").alias("_k", "_r"))
    nxt = F.concat(F.slice("_r", 2, F.size("_r") - 1), F.slice("_r", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("_r", nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2.0
    ranked = ring.withColumn("area", area).withColumn("_n", F.row_number().over(Window.partitionBy("poly_id").orderBy(F.col("area").desc(), "_k")))
    return ranked.filter("_n = 1").withColumn("rings", F.array("_r")).drop("_k", "_r", "_n")


def inside_largest_part(areas: DataFrame, countries: DataFrame) -> DataFrame:
    """Areas (poly_id, country_id, rings) whose vertices' mean lies in the largest part of their country (poly_id, rings)."""
    main = largest_part(countries).select(F.col("poly_id").alias("country_id"), "rings")
    ring = F.flatten("rings")
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, x: s + x) / F.size(ring)
    points = areas.select(F.col("poly_id").alias("point_id"), F.col("country_id").alias("own"), mean("x").alias("x"), mean("y").alias("y"))
    hit = containing(points, main.withColumnRenamed("country_id", "poly_id")).join(points.select("point_id", "own"), "point_id").filter("poly_id = own")
    return areas.join(hit.select(F.col("point_id").alias("poly_id")), "poly_id", "left_semi")


def basin_layer(table: DataFrame, grid: tuple[float, float, float], width: int, height: int, indicator: str = "ws", scenarios: tuple[str, ...] = ("opt", "bau", "pes"), ceiling: float | None = 50.0, sentinel: float = 9999.0) -> DataFrame:
    """Grid layers of a basin indicator: scenario, row, col, value (raw, the sentinel at the largest real value), scaled; cells outside are null.

    The domain is pooled over all basins and scenarios without the sentinel, so
    layers of all scenarios compare; each basin is burned into the grid once and
    its values join the burned cells.
    """
    basins = read_basins(table, indicator, scenarios, ceiling)
    values = basins.select("poly_id", *scenarios).unpivot(["poly_id"], list(scenarios), "scenario", "value").filter("value is not null")
    span = layers.domain(values, sentinel=sentinel)
    real = F.when(F.col("value") == sentinel, F.col("hi")).otherwise(F.col("value"))
    scaled = values.crossJoin(F.broadcast(span)).select("poly_id", "scenario", real.alias("value"), X.minmax(real, F.col("lo"), F.col("hi")).alias("scaled"))
    owned = rasterise(grid, width, height, basins.withColumns({"seq": F.col("poly_id"), "value": F.col("poly_id")})).withColumnRenamed("value", "poly_id")
    every = owned.crossJoin(F.broadcast(table.sparkSession.createDataFrame([(s,) for s in scenarios], "scenario string")))
    return every.join(scaled, ["poly_id", "scenario"], "left").select("scenario", "row", "col", "value", "scaled")


def read_basins(table: DataFrame, indicator: str = "ws", scenarios: tuple[str, ...] = ("opt", "bau", "pes"), ceiling: float | None = 50.0) -> DataFrame:
    """Wide basin columns {scenario}50_{indicator}_x_r to named ones; rows without geometry or any value drop out.

    A value beyond the ceiling raises, unless it is the sentinel 9999.
    """
    names = {f"{s}50_{indicator}_x_r": s for s in scenarios}
    lacking = [c for c in (*names, "poly_id", "rings") if c not in table.columns]
    if lacking:
        raise ValueError(f"missing basin columns: {lacking}")
    value = lambda c: F.when((F.abs(F.col(c)) > ceiling) & (F.col(c) != 9999), F.raise_error(F.lit(f"{c} beyond the ceiling")).cast("double")).otherwise(F.col(c)) if ceiling else F.col(c)
    return table.filter(F.col("rings").isNotNull() & F.coalesce(*names).isNotNull()).select("poly_id", "rings", *(value(c).alias(s) for c, s in names.items()))
