"""Monte Carlo, variance-based and one-at-a-time sensitivity: draws are rows, and recomputation is one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.functions import config as C
from riskgrid.functions import exprs as X
from riskgrid.plans import ranks
from riskgrid.plans.sizes import checked_broadcast
from riskgrid.sources import sinks

from . import risk

NAMES = tuple(n for n, *_ in C.PARAMETERS)
#: Ranks of a pooled sample that share a block of the rank table.
RANK_BLOCK = 4096
#: Ranks, at least, that share a block of weights.
LOOKUP_RANKS = 256
#: Chebyshev points of the padding at which sums over rows are taken.
NODES = 14


def draw_columns(seed: Column | int, *keys: Column | str) -> list[Column]:
    """The 13 parameters as columns, uniform in their ranges and keyed by ``keys``."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return [X.between(X.uniform(seed, *keys, F.lit(n)), lo, hi).alias(n) for n, lo, hi in C.PARAMETERS]


def stream_draws(spark: SparkSession, streams: DataFrame, n: int, seed: int = 20_260_915, purpose: str = "general_mc") -> DataFrame:
    """n draws for every stream (country, water_scenario): draw, parameters."""
    return streams.crossJoin(spark.range(n).withColumnRenamed("id", "draw")).select("country", "water_scenario", "draw", *draw_columns(seed, "country", "water_scenario", F.lit(purpose), F.col("draw").cast("string")))


def saltelli_draws(spark: SparkSession, n0: int, seed: int = 20_260_915) -> DataFrame:
    """Evaluations (draw, matrix, parameters) of matrices A, B and AB_p, which is A with B's column p: n0 x (D + 2) rows."""
    base = spark.range(n0).withColumnRenamed("id", "draw")
    value = lambda m, n, lo, hi: X.between(X.uniform(F.lit(str(seed)), F.lit(m), F.col("draw").cast("string"), F.lit(n)), lo, hi)
    both = base.select("draw", *(value(m, *p).alias(f"{m}_{p[0]}") for m in "AB" for p in C.PARAMETERS))
    crossed = both.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in ("A", "B", *NAMES)], "matrix string")))
    return crossed.select("draw", "matrix", *(F.when((F.col("matrix") == "B") | (F.col("matrix") == n), F.col(f"B_{n}")).otherwise(F.col(f"A_{n}")).alias(n) for n in NAMES))


def jitter_draws(draws: DataFrame, seed: int = 1) -> DataFrame:
    """Rates within 10 % of their values and one common percentile shift within 5, for each row of ``draws`` (draw long)."""
    base = {"coal_decay_rate": C.COAL_DECAY, "wind_relative_rate": C.WIND_RATE, "hydro_retention_rate": C.HYDRO_RATE, "solar_retention_rate": C.SOLAR_RATE}
    u = lambda name: X.uniform(F.lit(str(seed)), F.col("draw").cast("string"), F.lit(name))
    return draws.select("draw", *((F.lit(v) * X.between(u(k), 0.9, 1.1)).alias(k) for k, v in base.items()), X.between(u("shift"), -5.0, 5.0).alias("percentile_shift"))


def rank_table(samples: DataFrame) -> DataFrame:
    """Distinct values of each pooled (term, model) with the ranks they hold: term, model, value, low, high, n, block.

    Built once for all draws; a block of ranks keys the equi-join with draws.
    """
    ranked = ranks.value_ranks(samples, "value", "term", "model")
    return ranked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / RANK_BLOCK), F.floor((F.col("high") - 1) / RANK_BLOCK))))


def _around_cuts(draws: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each draw, percentile term and model the rows of the rank table around the point where "High" begins: keys, term, model, n, at, value, low.

    A percentile p is the point between the ranks around p / 100 * (n - 1). For
    wind the positive shift keeps the top percentile below its ceiling.
    """
    spark = draws.sparkSession
    rows = [(t, C.GUST_PERCENTILES if t == "wind" else C.GENERIC_PERCENTILES) for t in ("spei", "precip", "heat", "sv", "iv", "wind")]
    rules = spark.createDataFrame([(t, float(p[2]), float(max(p)) if t == "wind" else None) for t, p in rows], "term string, base double, top double")
    shift = F.coalesce(*(F.when(F.col("term") == t, F.col(f"{t}_percentile_shift")) for t, _ in rows))
    moved = F.when(F.col("top").isNotNull(), X.shifted(F.col("base"), shift, F.col("top"))).otherwise(X.shifted(F.col("base"), shift))
    sizes = table.groupBy("term", "model").agg(F.max("n").alias("n"))
    wanted = draws.crossJoin(F.broadcast(rules)).join(F.broadcast(sizes), "term").withColumn("at", moved / 100.0 * (F.col("n") - 1))
    both = wanted.select(*keys, "term", "model", "n", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).withColumn("block", F.floor(F.col("rank") / RANK_BLOCK))
    return both.join(table.drop("n"), ["term", "model", "block"]).filter("rank >= low and rank < high")


def high_cuts(draws: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each draw, percentile term and model the cut where "High" begins, a value: keys, term, model, cut."""
    cut = F.min("value") + (F.max("at") - F.floor(F.max("at"))) * (F.max("value") - F.min("value"))
    return _around_cuts(draws, table, keys).groupBy(*keys, "term", "model").agg(cut.alias("cut"))


def high_ranks(draws: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each draw, percentile term and model the first rank that is "High": keys, term, model, n, start.

    No value of the pooled sample lies strictly between neighbouring ranks, so
    the cut falls on a rank: that of its lower value if the point is a whole
    rank or both values are equal, else that of its upper one.
    """
    start = F.when(F.max("at") == F.floor(F.max("at")), F.min("low")).otherwise(F.max("low"))
    return _around_cuts(draws, table, keys).groupBy(*keys, "term", "model").agg(F.max("n").alias("n"), start.alias("start"))


def index_means(samples: DataFrame, draws: DataFrame, keys: tuple[str, ...] = ("draw",), by: tuple[str, ...] = (), strata: tuple[str, ...] = ()) -> DataFrame:
    """Mean screening index of each draw and model: keys, model, index_mean.

    Completeness doesn't depend on the draw, and the mean index is the sum over
    buckets of counts of high rows over the set's size, divided by all complete
    rows; so rows are counted once by value. A draw's cut falls on a rank, and
    what lies above it is a sum over whole blocks of ranks, taken once for all
    draws, and a part of one block: a draw meets one row and one block a term.
    ``by`` names columns that draws and samples share (their stream), ``strata``
    those of the samples that the means are split by.
    """
    spark = samples.sparkSession
    sets = F.broadcast(spark.createDataFrame(C.applicability(), "bucket string, term string, pos int, size int").drop("pos"))
    rows = samples.join(sets, ["bucket", "term"])
    whole = Window.partitionBy("plant_uid", "water_scenario", "model")
    complete = rows.withColumn("_gone", F.max(F.col("value").isNull()).over(whole)).filter("not _gone")
    part = tuple(c for c in dict.fromkeys((*by, *strata)) if c != "bucket")
    split = (*part, *(("bucket",) if "bucket" in strata else ()))
    counted = sinks.kept(complete.groupBy(*part, "bucket", "term", "model", "size", "value").agg(F.count(F.lit(1)).alias("c")))  # read by four sums
    total = counted.groupBy(*split, "model").agg(F.sum(F.col("c") / F.col("size")).alias("complete"))
    fixed = F.when(F.col("term") == "ws", C.WATER_CUTS[1]).when((F.col("term") == "wind") & (F.col("bucket") == "wind"), C.WIND_CUT)
    still = counted.filter(fixed.isNotNull()).groupBy(*split, "model").agg(F.sum(F.when(F.col("value") >= fixed, F.col("c") / F.col("size")).otherwise(0.0)).alias("fixed"))
    table = rank_table(samples)
    step = F.greatest(F.lit(LOOKUP_RANKS), F.floor(F.sqrt("n")))
    own = table.filter(F.floor(F.col("low") / RANK_BLOCK) == F.col("block")).select("term", "model", "value", "low", "n")
    moving = (
        counted.filter(fixed.isNull()).join(own, ["term", "model", "value"]).groupBy(*split, "term", "model", "low", F.floor(F.col("low") / step).alias("block"))
        .agg(F.sum(F.col("c") / F.col("size")).alias("w"))
    )
    blocks = moving.groupBy(*split, "term", "model", "block").agg(F.sum("w").alias("w"))
    line = Window.partitionBy(*split, "term", "model").orderBy("block")
    after = F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    last = F.coalesce(F.lag("block").over(line), F.lit(0))
    suffix = blocks.withColumns({"w": after, "_from": last}).filter("_from < block").withColumn("block", F.explode(F.sequence("_from", F.col("block") - 1))).drop("_from")
    on = list(dict.fromkeys((*split, *keys)))
    wanted = high_ranks(draws, table, tuple(dict.fromkeys((*by, *keys)))).withColumn("block", F.floor(F.col("start") / step)).drop("n")
    inside = wanted.join(moving, [*by, "term", "model", "block"]).filter(F.col("low") >= F.col("start")).select(*on, "model", "w")
    beyond = wanted.join(suffix, [*by, "term", "model", "block"]).select(*on, "model", "w")
    high = inside.unionByName(beyond).groupBy(*on, "model").agg(F.sum("w").alias("moving"))
    drawn = draws.select(*dict.fromkeys((*by, *keys)))
    every = drawn.join(total, list(by)) if by else drawn.crossJoin(checked_broadcast(total))
    joined = every.join(high, [*on, "model"], "left").join(still, [*split, "model"], "left")
    return joined.select(*on, "model", ((F.coalesce("moving", F.lit(0.0)) + F.coalesce("fixed", F.lit(0.0))) / F.col("complete")).alias("index_mean"))


RATES = {"coal": "coal_decay_rate", "wind": "wind_relative_rate", "hydro": "hydro_retention_rate", "solar": "solar_retention_rate", "cycle": "coal_overhaul_cycle_years", "recovery": "coal_overhaul_recovery"}
CURVE = ("bucket", "fuel_type", "mixed_fuel_type", "fuel_types_found", "commissioning_year")


def risk_means(samples: DataFrame, bounds: DataFrame, draws: DataFrame, keys: tuple[str, ...] = ("draw",), by: tuple[str, ...] = (), strata: tuple[str, ...] = ()) -> DataFrame:
    """Capacity-weighted mean risk of each draw and model: keys, model, risk_mean.

    The mean is sum(MW^2 * hazard * age) / sum(MW). Rows are summed by age curve
    before draws join. Of the other parameters only the padding p moves a
    hazard, that of log-scaled terms: -ln(1 - x / (1 + p)) / ln(1 + 1 / p). The
    sum of these logarithms over a curve's rows is analytic in p (its nearest
    singularity is p = 0, five half-widths from the range 0.04..0.06), so sums
    at NODES Chebyshev points give it for every draw with an error below 1e-13
    of its size, and the cost is rows x NODES + curves x draws.
    """
    b = F.broadcast(bounds.withColumnRenamed("term", "_t"))
    rows = samples.filter("value is not null and capacity_mw is not null").join(b, (F.col("term") == F.col("_t")) & (risk.bound_model() == F.col("bound_model")))
    share = X.clip(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), 0.0, 1.0)
    share = F.when(F.col("hi") <= F.col("lo"), 0.0).otherwise(share)
    square = F.col("capacity_mw") * F.col("capacity_mw")
    part = tuple(c for c in dict.fromkeys((*by, *strata)) if c not in CURVE)
    low, high = draws.agg(F.min("upper_tail_padding_fraction"), F.max("upper_tail_padding_fraction")).first()
    middle, half = ((low or 0.0) + (high or 0.0)) / 2, max(((high or 0.0) - (low or 0.0)) / 2, 1e-6)
    angles = [math.pi * (2 * k + 1) / (2 * NODES) for k in range(NODES)]
    log = F.col("term").isin(*C.LOG_TERMS)
    grouped = rows.withColumn("x", share).groupBy(*part, "model", *CURVE).agg(
        F.sum(F.when(~log, square * F.col("x"))).alias("linear"), F.sum("capacity_mw").alias("w"),
        *(F.sum(F.when(log, -square * F.log1p(-F.col("x") / F.lit(1.0 + middle + half * math.cos(t))))).alias(f"f{k}") for k, t in enumerate(angles)),
    )
    terms = [sum((F.coalesce(f"f{k}", F.lit(0.0)) * (2.0 / NODES * math.cos(j * t)) for k, t in enumerate(angles)), F.lit(0.0)) for j in range(NODES)]
    grouped = grouped.select(*part, "model", *CURVE, F.coalesce("linear", F.lit(0.0)).alias("linear"), "w", *(t.alias(f"c{j}") for j, t in enumerate(terms)))
    pad = F.col("upper_tail_padding_fraction")
    angle = F.acos(X.clip((pad - middle) / half, -1.0, 1.0))
    drawn = draws.withColumns({f"t{j}": F.cos(F.lit(float(j)) * angle) for j in range(1, NODES)})
    joined = grouped.join(drawn, list(by)) if by else grouped.crossJoin(checked_broadcast(drawn))
    logs = sum((F.col(f"c{j}") * F.col(f"t{j}") for j in range(1, NODES)), F.col("c0") / 2.0) / F.log1p(F.lit(1.0) / pad)
    age = X.age_factor(rates={k: F.col(v) for k, v in RATES.items()})
    return joined.groupBy(*dict.fromkeys((*by, *strata, *keys)), "model").agg((F.sum((F.col("linear") + logs) * age) / F.sum("w")).alias("risk_mean"))


def recompute(samples: DataFrame, bounds: DataFrame, draws: DataFrame, keys: tuple[str, ...] = ("draw",), by: tuple[str, ...] = (), strata: tuple[str, ...] = ()) -> DataFrame:
    """Risk and index mean of each draw and model, overall or by strata (country, bucket)."""
    on = [*dict.fromkeys((*by, *strata, *keys)), "model"]
    return risk_means(samples, bounds, draws, keys, by, strata).join(index_means(samples, draws, keys, by, strata), on)


def summaries(results: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, 95 % interval, half-width and Monte Carlo standard error of each group, with the verdict at 5 %."""
    ci = [F.percentile(value, F.lit(p)) for p in (0.025, 0.975)]
    se = F.stddev_samp(value) / F.sqrt(F.count(value))
    out = results.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), ci[0].alias("ci_low"), ci[1].alias("ci_high"), se.alias("mcse"))
    pct = F.abs(F.try_divide(F.col("mcse"), F.col("mean"))) * 100.0
    return out.withColumns({"half_width": (F.col("ci_high") - F.col("ci_low")) / 2.0, "mcse_pct": pct, "converged": F.coalesce(pct < 5.0, F.lit(False))})


def convergence(results: DataFrame, value: str, sizes: tuple[int, ...], *streams: str) -> DataFrame:
    """Summaries over the first n draws for each n, the change against the step before, and first and last converged step."""
    steps = F.broadcast(results.sparkSession.createDataFrame([(int(n),) for n in sizes], "step int"))
    nested = results.crossJoin(steps).filter(F.col("draw") < F.col("step"))
    found = summaries(nested, value, *streams, "step")
    w = Window.partitionBy(*streams).orderBy("step")
    whole = Window.partitionBy(*streams)
    return found.withColumn("change", F.abs(F.try_divide(F.col("mean") - F.lag("mean").over(w), F.lag("mean").over(w)))).withColumns({
        "first_converged": F.min(F.when(F.col("converged"), F.col("step"))).over(whole), "last_step": F.max("step").over(whole),
    })


def sobol_indices(results: DataFrame, value: str, by: tuple[str, ...] = (), resamples: int = 50, seed: int = 7) -> DataFrame:
    """First and total order index of every parameter with confidence half-widths: param, s1, s1_conf, st, st_conf.

    Saltelli's and Jansen's estimators on standardised outputs; half-widths are
    1.96 standard deviations over bootstrap replicates, which weight a draw by
    hashed Poisson counts so no row is copied. Strata with a missing output are
    left out.
    """
    results = sinks.kept(results.select(*by, "draw", "matrix", value))  # read by three steps
    ab = results.filter(F.col("matrix").isin("A", "B")).groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count_if(F.col(value).isNull()).alias("_bad")).filter("_bad = 0")
    scaled = (results.join(F.broadcast(ab), list(by)) if by else results.crossJoin(F.broadcast(ab))).withColumn("y", F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    base = scaled.groupBy(*by, "draw").agg(F.max(F.when(F.col("matrix") == "A", F.col("y"))).alias("a"), F.max(F.when(F.col("matrix") == "B", F.col("y"))).alias("b"))
    each = scaled.filter(F.col("matrix").isin(*NAMES)).select(*by, "draw", F.col("matrix").alias("param"), F.col("y").alias("ab")).join(base, [*by, "draw"])
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    u = X.uniform(F.lit(str(seed)), F.col("copy").cast("string"), F.col("draw").cast("string"))
    poisson = sum((F.when(u > p, 1.0).otherwise(0.0) for p in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317)), F.lit(0.0))
    weighted = copies.withColumn("k", F.when(F.col("copy") == 0, 1.0).otherwise(poisson))
    k = F.col("k")
    mean = F.try_divide(F.sum(k * (F.col("a") + F.col("b"))), 2 * F.sum(k))
    var = F.try_divide(F.sum(k * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))), 2 * F.sum(k)) - mean * mean
    first = F.try_divide(F.try_divide(F.sum(k * F.col("b") * (F.col("ab") - F.col("a"))), F.sum(k)), var)
    total = F.try_divide(0.5 * F.try_divide(F.sum(k * (F.col("a") - F.col("ab")) * (F.col("a") - F.col("ab"))), F.sum(k)), var)
    reps = weighted.groupBy(*by, "param", "copy").agg(first.alias("s1"), total.alias("st"))
    pick, spread = (lambda c: F.max(F.when(F.col("copy") == 0, F.col(c)))), (lambda c: 1.96 * F.stddev_samp(F.when(F.col("copy") > 0, F.col(c))))
    return reps.groupBy(*by, "param").agg(pick("s1").alias("s1"), spread("s1").alias("s1_conf"), pick("st").alias("st"), spread("st").alias("st_conf"))


def hazard_removal(bands: DataFrame) -> DataFrame:
    """Shift of each label's capacity share when one hazard leaves a bucket's set: bucket, country, removed, label, share, shift.

    Each plant's bands become two masks of terms in one aggregation; a removal
    is arithmetic on them, and every variant is one row of a table of sets.
    """
    spark = bands.sparkSession
    sets = F.broadcast(spark.createDataFrame(C.applicability(), "bucket string, term string, pos int, size int"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("pos"))
    masked = lambda c: F.bit_or(F.when(c, bit).otherwise(0))
    one = bands.join(sets, ["bucket", "term"]).groupBy("plant_uid", "water_scenario", "model").agg(
        *(F.min(c).alias(c) for c in ("country", "bucket", "capacity_mw")), F.max("size").alias("size"), masked(F.lit(True)).alias("seen"),
        masked(F.coalesce(F.col("risk_band").isin("High", "Extreme"), F.lit(False))).alias("high"), masked(F.col("risk_band").isNull()).alias("gone"),
    )
    variants = [(b, gone or "none", 1 << ts.index(gone) if gone else 0) for b, ts in C.APPLICABLE.items() if len(ts) > 1 for gone in (None, *ts)]
    left = one.join(F.broadcast(spark.createDataFrame(variants, "bucket string, removed string, bit int")), "bucket")
    rest = lambda c: F.col(c).bitwiseAND(F.bitwise_not("bit"))
    value = F.when(rest("gone") == 0, F.bit_count(rest("high")) / (F.col("size") - F.when(F.col("bit") > 0, 1).otherwise(0)))
    index = left.filter(rest("seen") != 0).withColumn("index_value", value).withColumn("label", X.index_label("index_value"))
    shares = label_shares(index, "bucket", "country", "water_scenario", "model", "removed")
    base = shares.filter("removed = 'none'").drop("removed").withColumnRenamed("share", "base_share")
    on = ["bucket", "country", "water_scenario", "model", "label"]
    return shares.filter("removed <> 'none'").join(base, on).withColumn("shift", F.col("share") - F.col("base_share"))


def label_shares(index: DataFrame, *by: str) -> DataFrame:
    """Capacity share of each label among complete rows; labels without a row have 0."""
    full = index.filter("index_value is not null")
    labels = F.broadcast(index.sparkSession.createDataFrame([(x,) for x in C.LABELS], "label string"))
    own = sinks.kept(full.groupBy(*by, "label").agg(F.sum("capacity_mw").alias("_c")))  # so that the rows are read once
    total = own.groupBy(*by).agg(F.sum("_c").alias("_t"))
    return total.crossJoin(labels).join(own, [*by, "label"], "left").withColumn("share", F.try_divide(F.coalesce("_c", F.lit(0.0)), F.col("_t"))).drop("_t", "_c")


def cut_points(index: DataFrame, cuts: tuple[float, ...] = C.SHIFTED_CUTS) -> DataFrame:
    """Label of every index value that occurs in a bucket at other cut points."""
    seen = index.filter("index_value is not null").select("bucket", "index_value").distinct()
    crossed = seen.crossJoin(F.broadcast(index.sparkSession.createDataFrame([(c,) for c in cuts], "cut double")))
    return crossed.withColumns({"label": X.index_label("index_value", F.col("cut")), "base_label": X.index_label("index_value")}).withColumn("flipped", F.col("label") != F.col("base_label"))
