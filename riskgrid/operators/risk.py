"""Risk by hazard, risk bands and the screening index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.plans import ranks

#: Name of the exposure that only maps use.
DISPLAY = "exposure_log10_display"
PLANT = ("plant_uid", "country", "plant_name", "bucket", "capacity_mw")


def bound_model(term="term", model="model"):
    """The model whose bounds a term uses: ``-`` where bounds are flat."""
    return F.when(F.col(term).isin(*C.MODEL_TERMS), F.col(model)).otherwise("-")


def global_bounds(samples: DataFrame) -> DataFrame:
    """Smallest and largest value of each term over plants of known buckets; by model where the term has models."""
    known = samples.filter(F.col("bucket").isin(*C.BUCKETS) & F.col("value").isNotNull())
    return known.groupBy("term", bound_model().alias("bound_model")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def age_factors(plants: DataFrame) -> DataFrame:
    """Each plant's age multiplier and whether its year was missing."""
    return plants.withColumns({"age_factor": X.age_factor(), "year_missing": F.col("commissioning_year").isNull()})


def display_exposure(plants: DataFrame) -> DataFrame:
    """log10(MW + 1) for maps, in a column of its own name; a missing capacity stays missing."""
    return plants.withColumn(DISPLAY, F.log10(X.at_least(F.col("capacity_mw"), 0.0) + 1.0))


def risk_by_hazard(samples: DataFrame, bounds: DataFrame, pad: float = C.UPPER_PAD, keep: tuple[str, ...] = ()) -> DataFrame:
    """hazard x capacity x age factor for every plant, scenario, model and term; a missing value stays missing.

    Rows that carry the display exposure are refused: it never enters scoring.

    Bounds are a table of at most ten rows; the samples are read once and not
    shuffled again. ``keep`` names further columns of theirs.
    """
    if DISPLAY in samples.columns:
        raise ValueError(f"{DISPLAY} is for display and can't enter scoring")
    bounds = F.broadcast(bounds.withColumnsRenamed({"term": "_term"}))
    joined = samples.join(bounds, (F.col("term") == F.col("_term")) & (bound_model() == F.col("bound_model")))
    hazard = X.hazard("term", "value", F.col("lo"), F.col("hi"), pad)
    return joined.withColumns({"hazard": hazard, "age_factor": X.age_factor()}).select(
        *PLANT, "water_scenario", "model", "term", "hazard", "age_factor", (F.col("hazard") * F.col("capacity_mw") * F.col("age_factor")).alias("risk"), *keep
    )


def top_risk(risk: DataFrame, n: int = 10, by: tuple[str, ...] = ("country", "term", "water_scenario", "model")) -> DataFrame:
    """The n largest risks of each group with their rank, ties by plant; missing risks don't count."""
    w = Window.partitionBy(*by).orderBy(F.col("risk").desc(), "plant_uid")
    return risk.filter(F.col("risk").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def percentile_cuts(samples: DataFrame, weight: Column | None = None) -> DataFrame:
    """Percentile cuts of each term's pooled sample, by model; exact, over ranks counted in two levels. ``weight`` counts a row so often."""
    return ranks.percentiles(samples, "value", {f"p{round(100 * p)}": p for p in (0.5, 0.75, 0.9, 0.95, 0.99)}, "term", "model", weight=weight)


def band_cuts(samples: DataFrame, weight: Column | None = None) -> DataFrame:
    """Cuts of every applicable (bucket, term) and model: fixed ones, or percentiles of the pool over all buckets.

    The lowest percentile is diagnostic, the other three are the cuts; a binary
    cut leaves the middle bands empty.
    """
    spark = samples.sparkSession
    rules = spark.createDataFrame(C.thresholds(), "bucket string, term string, kind string, c1 double, c2 double, c3 double, percentiles array<double>")
    pool = percentile_cuts(samples, weight)
    gust = F.col("percentiles")[0] == 75.0
    pick = lambda generic, gusty: F.when(gust, F.col(gusty)).otherwise(F.col(generic))
    return F.broadcast(rules).join(pool, "term").select(
        "bucket", "term", "model", "kind", "n",
        F.when(F.col("kind") == "percentile", pick("p50", "p75")).alias("diagnostic"),
        F.when(F.col("kind") == "percentile", pick("p75", "p90")).otherwise(F.col("c1")).alias("cut_1"),
        F.when(F.col("kind") == "percentile", pick("p90", "p95")).otherwise(F.col("c2")).alias("cut_2"),
        F.when(F.col("kind") == "percentile", pick("p95", "p99")).otherwise(F.col("c3")).alias("cut_3"),
    )


def risk_bands(samples: DataFrame, cuts: DataFrame | None = None, others: bool = False) -> DataFrame:
    """Band of every applicable plant, scenario, model and term; cuts are at most 24 rows. With ``others`` rows of other terms stay, without a band."""
    cuts = F.broadcast((band_cuts(samples) if cuts is None else cuts).select("bucket", "term", "model", "kind", "cut_1", "cut_2", "cut_3"))
    graded = F.when(F.col("kind") == "binary", X.band("value", [F.col("cut_1")], ("Low", "Extreme"))).otherwise(X.band("value", [F.col("cut_1"), F.col("cut_2"), F.col("cut_3")]))
    return samples.join(cuts, ["bucket", "term", "model"], "left" if others else "inner").withColumn("risk_band", F.when(F.col("value").isNotNull() & F.col("cut_1").isNotNull(), graded)).drop("kind", "cut_1", "cut_2", "cut_3")


def screening_index(bands: DataFrame, applicable: DataFrame | None = None, cut: float = 0.5, by: tuple[str, ...] = ("plant_uid", "water_scenario", "model")) -> DataFrame:
    """Share of High or Extreme bands in the bucket's hazard set; one missing band makes the index missing and is named.

    One aggregation by plant, scenario and model, no pivot. Plant columns are
    those of the plant; where rows disagree the smallest value stands.
    """
    spark = bands.sparkSession
    sets = applicable if applicable is not None else spark.createDataFrame(C.applicability(), "bucket string, term string, pos int, size int")
    joined = bands.join(F.broadcast(sets), ["bucket", "term"])
    named = F.array_sort(F.collect_list(F.when(F.col("risk_band").isNull(), F.struct("pos", "term"))))
    out = joined.groupBy(*by).agg(
        *(F.min(c).alias(c) for c in PLANT[1:] if c in bands.columns and c not in by), F.max("size").alias("set_size"),
        F.count_if(F.col("risk_band").isNull()).alias("n_missing"), F.count_if(F.col("risk_band").isin("High", "Extreme")).alias("n_high"), named.alias("_named"),
    )
    value = F.when(F.col("n_missing") == 0, F.col("n_high") / F.col("set_size"))
    return out.withColumn("index_value", value).withColumns({"label": X.index_label("index_value", cut), "missing_hazards": F.col("_named.term")}).drop("_named")


def index_coverage(index: DataFrame, *by: str) -> DataFrame:
    return index.groupBy(*by).agg(F.count_if(F.col("index_value").isNull()).alias("incomplete"), F.count(F.lit(1)).alias("total")).withColumn("share", F.col("incomplete") / F.col("total"))


def rank_within_bucket(index: DataFrame, bucket: str, ascending: bool = False, only: bool = False) -> DataFrame:
    """Rank by index within one bucket, missing last.

    With ``only`` the rows must be that bucket's: any other raises when it is
    met, since index values of different buckets don't compare.
    """
    if only:
        wrong = F.raise_error(F.concat(F.lit("rank across buckets: "), F.coalesce("bucket", F.lit("null")))).cast("string")
        index = index.withColumn("bucket", F.when(F.col("bucket") == bucket, F.col("bucket")).otherwise(wrong))
    order = F.col("index_value").asc_nulls_last() if ascending else F.col("index_value").desc_nulls_last()
    return index.filter(F.col("bucket") == bucket).withColumn("rank", F.rank().over(Window.partitionBy("bucket", "water_scenario", "model").orderBy(order)))


def scenario_invariance(bands: DataFrame, risk: DataFrame, term: str = "wind", tolerance: float = 1e-9) -> DataFrame:
    """Plants whose band or risk in a term differs between scenarios or models."""
    a = bands.filter(F.col("term") == term).groupBy("plant_uid").agg(F.count_distinct("risk_band").alias("bands"))
    b = risk.filter(F.col("term") == term).groupBy("plant_uid").agg((F.max("risk") - F.min("risk")).alias("spread"))
    return a.join(b, "plant_uid").filter((F.col("bands") > 1) | (F.col("spread") > tolerance))
