"""Grid layers: sampling, regridding, reductions of daily series, domains and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.plans import ranks
from riskgrid.plans.sizes import checked_broadcast, dealt
from riskgrid.sources import sinks, tables

#: Plants, about, that one task spells out by scenario, model and term.
PLANTS_A_TASK = 10_000
#: Cells up to which their spelled-out values (some kilobytes each) are handed to every task.
FEW_CELLS = 5_000
#: Lists of a cell's results (below a kilobyte each) up to which they are handed to every task.
FEW_LISTS = 20_000


def cell_of(lon: Column | str, lat: Column | str, xmin: float, ymax: float, res: float) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point."""
    return F.floor((F.lit(ymax) - X.col(lat)) / res).cast("int"), F.floor((X.col(lon) - F.lit(xmin)) / res).cast("int")


def sample_points(points: DataFrame, cells: DataFrame, grid: tuple[float, float, float], on: tuple[str, ...] = ()) -> DataFrame:
    """Value of the cell under each point (lon, lat); off the grid or missing there: null."""
    row, column = cell_of("lon", "lat", *grid)
    return points.withColumns({"row": row, "col": column}).join(cells, [*on, "row", "col"], "left").drop("row", "col")


def sample_terms(plants: DataFrame, cells: DataFrame, keys: DataFrame, grid: tuple[float, float, float]) -> DataFrame:
    """Long samples: every plant, scenario, model and term with its layer's value.

    Values are looked up once a cell that holds a plant, as a list over the
    keys; plants meet their cell's list and are spelled out where they are, so
    only narrow rows are shuffled and a plant's samples stay together. Plants
    are dealt to tasks first: few tasks may read them.
    """
    row, column = cell_of("lon", "lat", *grid)
    wanted = plants.withColumns({"row": row, "col": column})
    here = wanted.select("row", "col").distinct()
    few = here.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    handed = F.broadcast if few else lambda df: df
    found = cells.join(handed(here), ["row", "col"], "left_semi").withColumnsRenamed({"scenario": "layer_scenario", "model": "layer_model"})
    on = ["term", "layer_scenario", "layer_model", "row", "col"]
    each = here.crossJoin(F.broadcast(keys)).join(found, on, "left")
    values = each.groupBy("row", "col").agg(F.collect_list(F.struct(*(c for c in each.columns if c not in on[1:]))).alias("_v")).withColumnsRenamed({"row": "_row", "col": "_col"})
    met = F.col("row").eqNullSafe(F.col("_row")) & F.col("col").eqNullSafe(F.col("_col"))
    return dealt(wanted, PLANTS_A_TASK).join(handed(values), met).drop("row", "col", "_row", "_col").select("*", F.explode("_v").alias("_s")).select("*", "_s.*").drop("_v", "_s")


def one_a_cell(plants: DataFrame, grid: tuple[float, float, float], *by: str) -> DataFrame:
    """One plant for all that stand on a cell and agree in ``by``, and how many they are: by, row, col, plant_uid (the smallest), lon and lat (in the cell), plants.

    Values follow from the cell, so its samples are those of all ``plants``; the
    table grows with the cells that hold plants, not with the plants.
    """
    row, column = cell_of("lon", "lat", *grid)
    placed = plants.withColumns({"row": row, "col": column})
    return sinks.kept(placed.groupBy(*by, "row", "col").agg(*(F.min(c).alias(c) for c in ("plant_uid", "lon", "lat")), F.count(F.lit(1)).alias("plants")))


def for_all(plants: DataFrame, alike: DataFrame, found: DataFrame, grid: tuple[float, float, float], *by: str) -> DataFrame:
    """Rows that were found (by plant_uid) for the plants of :func:`one_a_cell`, for every plant that one of them stands for.

    Plants are dealt to tasks and meet a list a cell; they aren't shuffled
    unless very many cells are held.
    """
    row, column = cell_of("lon", "lat", *grid)
    rest = [c for c in found.columns if c not in (*plants.columns, *by)]
    lists = found.groupBy("plant_uid").agg(F.collect_list(F.struct(*rest)).alias("_v")).join(alike.select("plant_uid", *by, "row", "col"), "plant_uid").drop("plant_uid")
    keys = (*by, "row", "col")
    handed = checked_broadcast(sinks.kept(lists.withColumnsRenamed({c: f"_{c}" for c in keys})), FEW_LISTS)
    met = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    wanted = dealt(plants, PLANTS_A_TASK).withColumns({"row": row, "col": column})
    return wanted.join(handed, met).select(*plants.columns, F.explode("_v").alias("_s")).select(*plants.columns, "_s.*")


def sample_tiled(plants: DataFrame, tiled: DataFrame, keys: DataFrame, grid: tuple[float, float, float], tile: int = 256) -> DataFrame:
    """The same samples from layers written by :func:`sinks.write_tiled`.

    The folders of tiles that hold plants, and the layers that keys name, prune
    the files before they are read; only cells that a plant stands on go on.
    """
    row, column = cell_of("lon", "lat", *grid)
    here = plants.select(F.floor(row / tile).cast("int").alias("tile_row"), F.floor(column / tile).cast("int").alias("tile_col")).filter("tile_row >= 0 and tile_col >= 0").distinct()
    tiles = here.withColumn("tile_folder", sinks.tile_folder())
    wanted = F.broadcast(keys.select("term", F.col("layer_scenario").alias("scenario"), F.col("layer_model").alias("model")).filter("term <> ''").distinct())
    near = tiled.join(wanted, ["term", "scenario", "model"], "left_semi").join(checked_broadcast(tiles), ["tile_folder", "tile_row", "tile_col"], "left_semi")
    return sample_terms(plants, near.select("term", "scenario", "model", "row", "col", "value"), keys, grid)


def wide(samples: DataFrame, *keys: str, terms: tuple[str, ...] = C.TERMS) -> DataFrame:
    """One column a term; where rows of equal keys disagree the largest value stands. One aggregation by the keys, so a plant's rows shrink before they are shuffled."""
    return samples.groupBy(*keys).agg(*(F.max(F.when(F.col("term") == t, F.col("value"))).alias(t) for t in terms))


def long(table: DataFrame, *keys: str, terms: tuple[str, ...] = C.TERMS) -> DataFrame:
    """One row a term column: keys, term, value, missing values included; other columns are left out, an absent term raises."""
    lacking = [t for t in terms if t not in table.columns]
    if lacking:
        raise ValueError(f"missing term columns: {lacking}")
    return table.select(*keys, *(F.col(t).cast("double").alias(t) for t in terms)).unpivot(list(keys), list(terms), "term", "value")


def regrid(cells: DataFrame, source: tuple[float, float, float], target: tuple[float, float, float], extent: tuple[float, float]) -> DataFrame:
    """Nearest-neighbour values on a finer or coarser grid that spans ``extent`` (width, height in degrees)."""
    (xmin, ymax, res), (txmin, tymax, tres) = source, target
    import math

    width, height = math.ceil(extent[0] / tres), math.ceil(extent[1] / tres)
    spark = cells.sparkSession
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("target_row"), (F.col("id") % width).cast("int").alias("target_col"))
    row, column = cell_of(F.lit(txmin) + (F.col("target_col") + 0.5) * tres, F.lit(tymax) - (F.col("target_row") + 0.5) * tres, xmin, ymax, res)
    return grid.withColumns({"row": row, "col": column}).join(cells, ["row", "col"], "left").drop("row", "col")


def normalise_longitude(series: DataFrame, lon: str = "lon") -> DataFrame:
    """Longitudes to -180..180, only where the series goes beyond 180."""
    most = series.agg(F.max(lon).alias("_most"))
    return series.crossJoin(F.broadcast(most)).withColumn(lon, F.when(F.col("_most") > 180, F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0).otherwise(F.col(lon))).drop("_most")


def exceedance_days(daily: DataFrame, threshold: float = C.HOT_K, years: float = C.YEARS, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Days a year above a threshold: count over a fixed number of years."""
    return daily.groupBy(*cell).agg((F.count_if(F.col("value") > threshold) / F.lit(float(years))).alias("days_per_year"))


def regridded_heat_days(
    spark: SparkSession, path: str, source: tuple[float, float, float], target: tuple[float, float, float], extent: tuple[float, float],
    variables: tuple[str, ...] = ("tasmax",), first_year: int = 2041, last_year: int = 2070, threshold: float = C.HOT_K,
) -> DataFrame:
    """Days a year above a threshold on a target grid (target_row, target_col, value), from files of daily values by year.

    Files give their own variable (lon, lat, year and one of ``variables``);
    longitudes from 0 to 360 are brought to -180 to 180, days are counted on the
    series' own grid ``source`` over all years of the window, and the target
    grid takes the value of the cell under its centres (null off the source).
    """
    series = normalise_longitude(tables.read_series(spark, path, variables, first_year, last_year))
    row, column = cell_of("lon", "lat", *source)
    days = exceedance_days(series.withColumns({"row": row, "col": column}), threshold, last_year - first_year + 1, ("row", "col"))
    return regrid(days.withColumnRenamed("days_per_year", "value"), source, target, extent)


def wet_day_exceedance(daily: DataFrame, wet: float = C.WET_MM, percentile: float = 0.95, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Days a year above a cell's own percentile of wet days; null where no day is wet."""
    limits = daily.groupBy(*cell).agg(F.percentile(F.when(F.col("value") >= wet, F.col("value")), F.lit(percentile)).alias("limit"))
    counted = daily.join(limits, list(cell)).groupBy(*cell).agg(
        F.max("limit").alias("limit"), F.count_if(F.col("value") > F.col("limit")).alias("days"), F.count_distinct(F.col("year")).alias("years")
    )
    return counted.select(*cell, "limit", F.when(F.col("limit").isNotNull(), F.col("days") / F.col("years")).alias("days_per_year"))


def mean_annual_max(series: DataFrame, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Mean over years of each cell's yearly maximum."""
    return series.groupBy(*cell, "year").agg(F.max("value").alias("top")).groupBy(*cell).agg(F.avg("top").alias("mean_annual_max"), F.count(F.lit(1)).alias("years"))


def period_mean(series: DataFrame, scale: float = 1.0, offset: float = 0.0, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    return series.groupBy(*cell).agg((F.avg("value") * scale + offset).alias("mean"))


def domain(cells: DataFrame, *by: str, sentinel: float | None = None) -> DataFrame:
    """Pooled minimum, maximum and count by group; a sentinel value doesn't count."""
    value = F.col("value") if sentinel is None else F.when(F.col("value") != sentinel, F.col("value"))
    return cells.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))


def normalise(cells: DataFrame, domains: DataFrame, *by: str, sentinel: float | None = None) -> DataFrame:
    """Values scaled to their group's domain; a sentinel stands for the group's real maximum."""
    value = F.col("value") if sentinel is None else F.when(F.col("value") == sentinel, F.col("hi")).otherwise(F.col("value"))
    return cells.join(domains, list(by)).withColumn("scaled", X.minmax(value, F.col("lo"), F.col("hi"))).drop("lo", "hi", "n")


def threshold_summary(values: DataFrame, cut: float, percentiles: tuple[float, ...] = (0.9, 0.95, 0.99), by: tuple[str, ...] = ()) -> DataFrame:
    """Share at or above a cut with the valid count, and percentile cuts."""
    share = values.groupBy(*by).agg(F.avg(F.when(F.col("value").isNotNull(), (F.col("value") >= cut).cast("double"))).alias("share"))
    at = {f"p{round(p * 100)}": p for p in percentiles}
    found = ranks.percentiles(values, "value", at, *by)
    return (share.join(found, list(by)) if by else share.crossJoin(found)).select(*by, "share", "n", *at)
