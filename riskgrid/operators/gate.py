"""Normalisation origin and the correlation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.plans import ranks
from riskgrid.sources import sinks


def skewness(value: str) -> Column:
    """Population skewness; null below three values or without spread."""
    v = F.col(value)
    return F.when((F.count(v) >= 3) & (F.min(v) < F.max(v)), F.skewness(v))


def correlation(a: str, b: str, weight: str = "_w") -> Column:
    """Pearson correlation of paired columns that have mean 0, rows counted ``weight`` times; null below three pairs or where a side is constant."""
    moment = lambda x, y: F.sum(F.col(weight) * F.col(x) * F.col(y))
    r = F.try_divide(moment(a, b), F.sqrt(moment(a, a)) * F.sqrt(moment(b, b)))
    return F.when((F.sum(weight) >= 3) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), r)


def normalisation_origin(samples: DataFrame) -> DataFrame:
    """Bounds, skewness and chosen transform of each term; terms below three values are left out."""
    bound = F.when(F.col("term").isin(*C.MODEL_TERMS), F.col("model")).otherwise("-")
    once = samples.filter(F.col("value").isNotNull() & (F.col("term").isin(*C.MODEL_TERMS) | (F.col("model") == C.MODELS[0])))
    stats = once.groupBy("term", bound.alias("bound_model")).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), skewness("value").alias("skewness"))
    return stats.filter("n >= 3").withColumn("transform", F.when(F.abs("skewness") > C.SKEWED, "neg_log_minmax").otherwise("direct_minmax"))


def pair_table(samples: DataFrame, pairs: tuple = C.PAIRS, weight: Column | None = None) -> DataFrame:
    """Rows of every candidate pair: pair, bucket, country (and pooled), model, x, y and _w (how many plants the row stands for); both values known.

    Pooled rows are made by exploding the country, since ranks are taken anew
    in each group.
    """
    spark = samples.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(a, b, g, k, a in C.MODEL_TERMS or b in C.MODEL_TERMS) for a, b, g, ks in pairs for k in ks], "term_a string, term_b string, gated boolean, bucket string, by_model boolean"))
    one = samples.filter(F.col("value").isNotNull()).groupBy("plant_uid", "country", "bucket", "water_scenario", "model").agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias("v"), F.max(F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    both = one.join(pairs, "bucket").filter(F.col("by_model") | (F.col("model") == C.MODELS[0]))
    found = both.withColumns({"x": F.try_element_at("v", F.col("term_a")), "y": F.try_element_at("v", F.col("term_b"))}).filter("x is not null and y is not null")
    return found.select("term_a", "term_b", "gated", "bucket", F.when(F.col("by_model"), F.col("model")).otherwise("not_model_dependent").alias("model"), F.explode(F.array("country", F.lit("pooled"))).alias("country"), "x", "y", "_w")


def run_gate(samples: DataFrame, threshold: float = C.GATE, small_groups: bool = False, pairs: tuple = C.PAIRS, weight: Column | None = None) -> DataFrame:
    """Correlations and verdict of each pair, bucket, country and model; pooled rows have no verdict.

    Equal pairs of values are counted first. Ranks are taken over ranges of
    values, since pooled groups grow with the plants; ``small_groups=True``
    ranks a group in one task by windows. ``weight`` tells how many plants a
    plant of ``samples`` stands for.
    """
    keys = ("term_a", "term_b", "gated", "bucket", "country", "model")
    found, names = pair_table(samples, pairs, weight), {"rx": "x", "ry": "y"}
    if small_groups and weight is None:
        ranked = ranks.window_ranks(sinks.kept(found), names, *keys)
    else:
        rows = sinks.kept(found.groupBy(*keys, "x", "y").agg(F.sum("_w").alias("_w")))  # read by the ranks of both sides, the means and the correlations
        ranked = ranks.with_average_ranks(rows, names, *keys, weight=F.col("_w"))
    ranked = sinks.kept(ranked)
    both = ("x", "y", "rx", "ry")
    means = ranked.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col("_w") * F.col(c)), F.sum("_w")).alias(f"_{c}") for c in both))
    met = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
    centred = ranked.alias("r").join(F.broadcast(means).alias("m"), met).select("r.*", *(f"m._{c}" for c in both)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in both})
    stats = centred.groupBy(*keys).agg(F.sum("_w").alias("n"), correlation("x", "y").alias("pearson_r"), correlation("rx", "ry").alias("spearman_rho"))
    return verdicts(stats, F.lit(threshold))


def verdicts(stats: DataFrame, threshold: Column) -> DataFrame:
    """Decision statistic, verdict and tie-breaker for correlation rows."""
    rules = F.broadcast(stats.sparkSession.createDataFrame(C.tie_breakers(), "term_a string, term_b string, bucket string, retained string, criterion int"))
    nonlinear = F.coalesce(F.abs("spearman_rho") - F.abs("pearson_r") > C.NONLINEAR, F.lit(False))
    decided = stats.withColumn("nonlinear", nonlinear).withColumn("decision_r", F.when(F.col("nonlinear"), F.col("spearman_rho")).otherwise(F.col("pearson_r")))
    verdict = (
        F.when(F.col("country") == "pooled", None).when(~F.col("gated"), "report_only").when(F.col("decision_r").isNull(), "insufficient_data")
        .when(F.abs("decision_r") >= threshold, "fail").otherwise("pass")
    )
    failed = F.col("verdict") == "fail"
    return decided.withColumn("verdict", verdict).join(rules, ["term_a", "term_b", "bucket"], "left").withColumns({
        "criterion": F.when(failed, F.col("criterion")),
        "excluded": F.when(failed, F.when(F.col("retained") == F.col("term_a"), F.col("term_b")).otherwise(F.col("term_a"))),
        "retained": F.when(failed, F.col("retained")),
    })


def sweep(gate: DataFrame, thresholds: tuple[float, ...] = C.SWEPT) -> DataFrame:
    """Verdicts of the gated country rows at other thresholds, and whether they flip."""
    spark = gate.sparkSession
    base = gate.filter(F.col("gated") & (F.col("country") != "pooled")).select("term_a", "term_b", "gated", "bucket", "country", "model", "n", "pearson_r", "spearman_rho", F.col("verdict").alias("base_verdict"))
    crossed = base.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "threshold double")))
    return verdicts(crossed, F.col("threshold")).withColumn("flipped", F.col("verdict") != F.col("base_verdict"))
