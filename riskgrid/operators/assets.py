"""Asset records: reading, status, scope and box filters, aggregation of units to plants, fuel buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.plans.sizes import checked_broadcast

# Source columns by internal name, and the statuses that count.
SOURCE_COLUMNS = {
    "Plant / Project name": "plant_name", "Latitude": "lat", "Longitude": "lon", "Capacity (MW)": "capacity_mw", "Type": "fuel_type",
    "Start year": "commissioning_year", "Country/area": "country", "Status": "status",
}
PLANT_COLUMNS = ("country", "plant_name", "lat", "lon", "capacity_mw", "commissioning_year", "fuel_type", "mixed_fuel_type", "bucket")
OPERATING = ("operating",)
PLANNED = ("construction", "pre-construction", "announced")
TOLERANCE = 0.0009


def read_assets(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Unit table with internal names and types; a missing source column raises."""
    raw = spark.read.option("header", True).csv(path) if form == "csv" else spark.read.format(form).load(path)
    lacking = [c for c in SOURCE_COLUMNS if c not in raw.columns]
    if lacking:
        raise ValueError(f"missing source columns: {lacking}")
    number = lambda c: X.finite(F.expr(f"try_cast(`{c}` as double)"))
    named = raw.select(*(F.col(f"`{k}`").alias(v) for k, v in SOURCE_COLUMNS.items()))
    return named.withColumns({c: number(c) for c in ("lat", "lon", "capacity_mw", "commissioning_year")})


def with_status(units: DataFrame) -> DataFrame:
    """Class of each unit from its trimmed lower-case status: operating, planned or other."""
    s = F.lower(F.trim("status"))
    return units.withColumn("status_class", F.when(s.isin(*OPERATING), "operating").when(s.isin(*PLANNED), "planned").otherwise("other"))


def status_counts(units: DataFrame) -> DataFrame:
    return with_status(units).groupBy("status_class").agg(F.count(F.lit(1)).alias("units"), F.concat_ws(",", F.array_sort(F.collect_set(F.lower(F.trim("status"))))).alias("statuses"))


def read_plants(table: DataFrame) -> DataFrame:
    """Validated plants: numbers coerced (bad ones null), a missing mixed flag false, and an id of the country's code and the raw name and place.

    :func:`quality.colliding_ids` tells ids that two different plants share.
    """
    lacking = [c for c in PLANT_COLUMNS if c not in table.columns]
    if lacking:
        raise ValueError(f"missing plant columns: {lacking}")
    number = lambda c: X.finite(F.expr(f"try_cast(`{c}` as double)"))
    code = F.upper(F.substring(F.trim("country"), 1, 3))
    id = X.content_id(code, F.col("plant_name"), F.col("lat").cast("string"), F.col("lon").cast("string"))
    numbers = {c: number(c) for c in ("lat", "lon", "capacity_mw", "commissioning_year")}
    return table.withColumn("plant_uid", id).withColumns(numbers | {"mixed_fuel_type": F.coalesce(F.expr("try_cast(mixed_fuel_type as boolean)"), F.lit(False))})


def disputed(areas: DataFrame) -> DataFrame:
    """Countries with whether one of their first-level areas (country, gid) has a code that begins with Z."""
    return areas.groupBy("country").agg(F.coalesce(F.bool_or(F.col("gid").startswith("Z")), F.lit(False)).alias("disputed"))


def in_scope(units: DataFrame, countries: list[str]) -> DataFrame:
    return units.filter(F.trim("country").isin(*countries))


def boxed(plants: DataFrame, boxes: DataFrame) -> DataFrame:
    """Whether each plant lies in its country's box (missing coordinates: outside), and whether it stays.

    ``boxes`` has country, xmin, ymin, xmax, ymax, mainland_only; only where
    that is set do plants outside leave, with a reason.
    """
    inside = F.coalesce(F.col("lon").between(F.col("xmin"), F.col("xmax")) & F.col("lat").between(F.col("ymin"), F.col("ymax")), F.lit(False))
    out = plants.join(checked_broadcast(boxes), "country", "left").withColumn("inside", inside)
    stays = F.col("inside") | ~F.coalesce("mainland_only", F.lit(False))
    return out.withColumns({"stays": stays, "reason": F.when(~stays, "outside the mainland box")}).drop("xmin", "ymin", "xmax", "ymax", "mainland_only")


def box_union(a: DataFrame, b: DataFrame, on: str = "country") -> DataFrame:
    """Smallest box around two boxes."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in ("xmin", "ymin", "xmax", "ymax")})
    return a.join(other, on).select(on, *(F.least(c, f"_{c}").alias(c) for c in ("xmin", "ymin")), *(F.greatest(c, f"_{c}").alias(c) for c in ("xmax", "ymax")))


def to_plants(units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Units to plants by country, trimmed lower-case name and rounded coordinates; missing groups are kept.

    A sum over missing capacities only is missing; the first name is that of
    the smallest ``seq``. Partial aggregation keeps the shuffle to plants.
    """
    fuels = F.array_sort(F.collect_set("fuel_type"))
    return (
        units.groupBy(F.col("country"), F.lower(F.trim("plant_name")).alias("_name"), X.round_to("lat", tolerance).alias("_lat"), X.round_to("lon", tolerance).alias("_lon"))
        .agg(F.min_by("plant_name", "seq").alias("plant_name"), F.sum("capacity_mw").alias("capacity_mw"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
             F.min("commissioning_year").alias("commissioning_year"), F.concat_ws(";", fuels).alias("fuel_types_found"),
             (F.size(fuels) > 1).alias("mixed_fuel_type"), F.count(F.lit(1)).alias("units"), F.when(F.size(fuels) == 1, fuels[0]).alias("fuel_type"))
        .drop("_name", "_lat", "_lon")
    )


def with_bucket(plants: DataFrame, overrides: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Bucket of each plant's fuel; a mixed plant takes its name's override, or its fuels' common bucket; else null.

    With ``strict`` a plant without a bucket raises when it is met, and names
    its fuels; :func:`unmapped` lists them otherwise.
    """
    spark = plants.sparkSession
    fuels = F.broadcast(spark.createDataFrame(list(C.FUEL_BUCKETS.items()), "_fuel string, _bucket string"))
    common = F.create_map(*(F.lit(x) for kv in C.FUEL_BUCKETS.items() for x in kv))
    kinds = F.array_distinct(F.transform(F.split("fuel_types_found", ";"), lambda f: F.try_element_at(common, f)))
    named = F.create_map(*(F.lit(x) for kv in (overrides or {"": ""}).items() for x in kv))
    mixed = F.coalesce(F.try_element_at(named, F.col("plant_name")), F.when(F.size(kinds) == 1, kinds[0]))
    bucket = F.when(F.col("mixed_fuel_type"), mixed).otherwise(F.col("_bucket"))
    if strict:
        bucket = F.coalesce(bucket, F.raise_error(F.concat(F.lit("no bucket for the fuels of "), F.coalesce("plant_name", F.lit("?")), F.lit(": "), F.coalesce("fuel_types_found", F.lit("none")))).cast("string"))
    return plants.join(fuels, F.col("fuel_type") == F.col("_fuel"), "left").withColumn("bucket", bucket).drop("_fuel", "_bucket")


def unmapped(plants: DataFrame) -> DataFrame:
    """Plants without a bucket."""
    return plants.filter(F.col("bucket").isNull())


def bucket_distribution(plants: DataFrame) -> DataFrame:
    return plants.groupBy("country", "bucket").agg(F.count(F.lit(1)).alias("plants"), F.round(F.sum("capacity_mw"), 1).alias("capacity_mw")).orderBy("country", "bucket")


def valid_share(plants: DataFrame) -> DataFrame:
    """Share of capacity whose coordinates are valid: in range and not both zero."""
    good = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)), F.lit(False))
    return plants.groupBy("country").agg(F.sum(F.when(good, F.col("capacity_mw"))).alias("valid_mw"), F.sum("capacity_mw").alias("total_mw"), F.count_if(good).alias("valid")).withColumn("share", F.try_divide("valid_mw", "total_mw"))


def clean_assets(units: DataFrame, boxes: DataFrame, countries: list[str], overrides: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Plants, planned units and excluded plants from a unit table."""
    classed = with_status(in_scope(units, countries))
    plants = with_bucket(boxed(to_plants(classed.filter("status_class = 'operating'")), boxes), overrides)
    return {"plants": plants.filter("stays").drop("reason", "stays"), "planned": classed.filter("status_class = 'planned'"), "excluded": plants.filter("not stays")}


def asset_report(units: DataFrame, boxes: DataFrame, countries: list[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """What the cleaning did, one row for each of ``countries``: units before and plants after it, and plants by reason and bucket.

    Plants outside their country's box are counted whether or not they leave for
    it, and not at all (null) where the country has no box; the counts of
    capacity, mixed fuels and buckets are of the plants that stay. A country
    without a plant has a note.
    """
    name = F.trim("country").alias("country")
    operating = with_status(in_scope(units, countries)).filter("status_class = 'operating'")
    before = operating.groupBy(name).agg(F.count(F.lit(1)).alias("units_before"))
    plants, stays = with_bucket(boxed(to_plants(operating), boxes), overrides), F.col("stays")
    counted = plants.groupBy(name).agg(
        F.count_if(stays).alias("plants_after"), F.count_if(stays & F.coalesce(F.col("capacity_mw") == 0, F.lit(True))).alias("missing_or_zero_capacity"), F.count_if(~F.col("inside")).alias("outside_box"),
        F.count_if(~stays).alias("excluded"), F.count_if(stays & F.col("mixed_fuel_type")).alias("mixed_fuel"), *(F.count_if(stays & (F.col("bucket") == b)).alias(f"n_{b}") for b in C.BUCKETS),
        F.count_if(stays & F.col("bucket").isNull()).alias("n_unmapped"),
    )
    listed = units.sparkSession.createDataFrame([(c,) for c in countries], "country string")
    joined = listed.join(before, "country", "left").join(counted, "country", "left").join(boxes.select("country", F.lit(True).alias("_box")).distinct(), "country", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("units_before", *counted.columns[1:])}
    return joined.withColumns(zero | {"outside_box": F.when(F.col("_box"), F.coalesce("outside_box", F.lit(0))), "note": F.when(F.coalesce("plants_after", F.lit(0)) == 0, "no operating plants")}).drop("_box")
