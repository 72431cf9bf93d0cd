"""Closed-form and golden values of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import exprs as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clip_keeps_missing(spark):
    assert value(spark, X.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert value(spark, X.clip(F.lit(2.0), 0, 1)) == 1.0


def test_log1p_keeps_missing(spark):
    assert value(spark, X.log1p_minmax(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) is None


@pytest.mark.parametrize("kind", ["ws", "sv"])
def test_degenerate_domain_is_zero(spark, kind):
    assert value(spark, X.hazard(F.lit(kind), F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0


def test_unknown_term_raises(spark):
    with pytest.raises(Exception, match="unknown term"):
        value(spark, X.hazard(F.lit("xx"), F.lit(3.0), F.lit(0.0), F.lit(3.0)))


def test_neg_log_top_is_one(spark):
    assert value(spark, X.neg_log_minmax(F.lit(1.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(1.0)


@pytest.mark.parametrize("years, want", [(0, 1.0), (4, 1 - 0.0025 * 4), (5, 1 - 0.3 * 0.0025 * 5), (12, 1 - 2 * 0.3 * 0.0025 * 5 - 0.0025 * 2)])
def test_coal_sawtooth(spark, years, want):
    assert value(spark, X.coal_retention(F.lit(float(years)))) == pytest.approx(want)


def test_mixed_fuel_is_the_mean(spark):
    f = lambda fuel, mixed, found: value(spark, X.age_factor(F.lit("thermal"), F.lit(2000.0), F.lit(fuel).cast("string"), F.lit(mixed), F.lit(found)))
    assert f(None, True, "coal;oil/gas") == pytest.approx((f("coal", False, "coal") + 1.0) / 2)


def test_missing_year_is_neutral(spark):
    assert value(spark, X.age_factor(F.lit("hydro"), F.lit(None).cast("double"), F.lit("x"), F.lit(False), F.lit("x"))) == 1.0


def test_fuel_without_curve_raises(spark):
    with pytest.raises(Exception, match="no age curve"):
        value(spark, X.age_factor(F.lit("thermal"), F.lit(2000.0), F.lit("geothermal"), F.lit(False), F.lit("geothermal")))


@pytest.mark.parametrize("x, want", [(0.0, "LOW"), (1 / 3, "MEDIUM"), (0.5, "HIGH"), (2 / 3, "HIGH"), (1.0, "EXTREME"), (None, None)])
def test_index_label(spark, x, want):
    assert value(spark, X.index_label(F.lit(x).cast("double"))) == want


def test_bands_are_left_closed(spark):
    cuts = [F.lit(c) for c in (0.1, 0.4, 0.8)]
    assert [value(spark, X.band(F.lit(x).cast("double"), cuts)) for x in (0.0999, 0.1, 0.4, 0.8, None)] == ["Low", "Medium", "High", "Extreme", None]


def test_lisbon_to_porto(spark):
    assert value(spark, X.haversine_km(F.lit(38.7223), F.lit(-9.1393), F.lit(41.1579), F.lit(-8.6291))) == pytest.approx(274, abs=3)


def test_admin_codes_of_mixed_levels(spark):
    cell = '[{"gid_2": "BRA.5.3_1"}, 1, {"gid_1": "BRA.19_1"}, {"gid_0": "BRA"}]'
    assert sorted(value(spark, X.admin_codes(F.lit(cell)))) == ["BRA.19_1", "BRA.5_1"]
    for bad in ("not json", None, "[]"):
        assert not value(spark, X.admin_codes(F.lit(bad).cast("string")))


def test_constant_warmth_at_the_equator(spark):
    heat = 12 * (20 / 5) ** 1.514
    a = 6.75e-7 * heat**3 - 7.71e-5 * heat**2 + 1.792e-2 * heat + 0.49239
    want = 16 * (10 * 20 / heat) ** a * (12 / 12) * (31 / 30)
    got = value(spark, X.evapotranspiration(F.lit(20.0), F.lit(heat), X.day_length(F.lit(0.0), F.lit(15)), F.lit(31)))
    assert got == pytest.approx(want)


def test_normal_round_trip(spark):
    for p in (0.01, 0.3, 0.5, 0.9):
        assert value(spark, X.normal_cdf(X.normal_quantile(F.lit(p)))) == pytest.approx(p, abs=5e-4)


def test_uniform_depends_on_keys_only(spark):
    draw = lambda parts: sorted(r.u for r in spark.range(100).repartition(parts).select(X.uniform(F.lit("s"), F.col("id").cast("string")).alias("u")).collect())
    assert draw(1) == draw(8)
    assert 0.4 < sum(draw(1)) / 100 < 0.6


def test_wind_shift_stays_below_the_ceiling(spark):
    assert value(spark, X.shifted(F.lit(99.0), F.lit(5.0), F.lit(99.0))) == 99.5
    assert value(spark, X.shifted(F.lit(97.0), F.lit(5.0))) == 100.0


def test_rounding_is_half_even(spark):
    assert value(spark, X.round_to(F.lit(0.5), 1.0)) == 0.0
    assert value(spark, X.round_to(F.lit(1.5), 1.0)) == 2.0


def test_content_id_shape(spark):
    made = value(spark, X.content_id(F.lit("BRA"), F.lit("a"), F.lit("1.0"), F.lit("2.0")))
    assert made.startswith("BRA-") and len(made) == 16 and math.isfinite(int(made[4:], 16))
