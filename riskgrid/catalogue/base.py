"""Registration of queries and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskgrid.operators import grid, risk
from riskgrid.plans import carriers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, *needs: str):
    """Register a query with its oracle: ``body`` after the common table expressions it needs."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = carriers.with_sql(body, *needs) if needs else body
        return f

    return keep


def r(c, digits: int = 6):
    """Rounded, so that sums in another order give the same value."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def single(c: str):
    """In single precision: unlike decimal rounding it has no boundaries among products of short decimals."""
    return F.col(c).cast("float").cast("double")


_SAMPLES: dict[tuple[str, str], DataFrame] = {}


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The long samples of a folder, kept for the session: bounds, risk, bands and draws all read them.

    They spill to disk where memory is short, and are computed again if the
    cache is cleared or an executor is lost.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SAMPLES:
        _SAMPLES[key] = sampled(spark, folder).persist(StorageLevel.MEMORY_AND_DISK)
    return _SAMPLES[key]


def sampled(spark: SparkSession, folder: str) -> DataFrame:
    return grid.sample_terms(carriers.plants(spark, folder), carriers.cells(spark, folder), carriers.scenario_keys(spark), carriers.GRID)


_ALIKE: dict[tuple, DataFrame] = {}


def alike(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """One plant for all that agree in ``by`` and stand on its cell: taken once a session."""
    key = (spark.sparkContext.applicationId, folder, by)
    if key not in _ALIKE:
        _ALIKE[key] = grid.one_a_cell(carriers.plants(spark, folder), carriers.GRID, *by)
    return _ALIKE[key]


def counted(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """The samples of the plants of :func:`alike`, with the number that each stands for (``plants``)."""
    return grid.sample_terms(alike(spark, folder, *by).drop("row", "col"), carriers.cells(spark, folder), carriers.scenario_keys(spark), carriers.GRID)


_OWN: dict[tuple[str, str], bool] = {}


def own_ids(spark: SparkSession, folder: str) -> bool:
    """Whether every plant has an id and none shares it, so that what joins or groups by ids stays within a plant."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OWN:
        _OWN[key] = carriers.plants(spark, folder).groupBy("plant_uid").count().filter("count > 1 or plant_uid is null").isEmpty()
    return _OWN[key]


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    return risk.global_bounds(counted(spark, folder, "bucket"))


def risks(spark: SparkSession, folder: str) -> DataFrame:
    return risk.risk_by_hazard(samples(spark, folder), bounds(spark, folder))


_CUTS: dict[tuple[str, str], tuple[list, StructType]] = {}


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The band cuts of a folder, a row for each (bucket, term) of the registry and model: taken once a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _CUTS:
        made = risk.band_cuts(counted(spark, folder, "bucket"), F.col("plants"))
        _CUTS[key] = made.collect(), made.schema
    return spark.createDataFrame(*_CUTS[key])


def bands(spark: SparkSession, folder: str) -> DataFrame:
    return risk.risk_bands(samples(spark, folder), cuts(spark, folder))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of every plant: of one a bucket and cell, for all that it stands for; by all plants' bands where ids are shared."""
    if not own_ids(spark, folder):
        return risk.screening_index(bands(spark, folder))
    one = risk.screening_index(risk.risk_bands(counted(spark, folder, "bucket"), cuts(spark, folder)))
    plants = carriers.plants(spark, folder).select(*risk.PLANT, "lon", "lat")
    return grid.for_all(plants, alike(spark, folder, "bucket"), one, carriers.GRID, "bucket").drop("lon", "lat")
