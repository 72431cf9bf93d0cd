"""Column expressions. Null is the only missing value and stays null through every expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import config as C


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column | str) -> Column:
    """NaN and infinities as null."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """Null-safe clipping: ``greatest`` and ``least`` would skip a null."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, lit(low)), lit(high)))


def at_least(x: Column, low: Column | float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, lit(low)))


def minmax(x: Column | str, low: Column, high: Column) -> Column:
    """Linear scaling to 0..1; a domain without width gives 0."""
    x = col(x)
    return F.when(x.isNull(), None).when(high <= low, 0.0).otherwise(clip((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0))


def neg_log_minmax(x: Column | str, low: Column, high: Column, pad: Column | float = C.UPPER_PAD) -> Column:
    """-ln(1 - x) on a domain padded above, scaled to 0..1."""
    x, pad = col(x), lit(pad)
    share = clip((x - low) / F.nullif(high + pad * (high - low) - low, F.lit(0.0)), 0.0, 1.0 - 1e-9)
    return F.when(x.isNull(), None).when(high <= low, 0.0).otherwise(clip(-F.log1p(-share) / F.log1p(F.lit(1.0) / pad), 0.0, 1.0))


def transform(name: Column | str, x: Column | str, low: Column, high: Column, pad: Column | float = C.UPPER_PAD) -> Column:
    """The transform of a name, as the normalisation origin gives it; an unknown name raises."""
    name = col(name)
    known = F.when(name == "neg_log_minmax", neg_log_minmax(x, low, high, pad)).when(name == "direct_minmax", minmax(x, low, high)).when(name == "log1p_minmax", log1p_minmax(x, low, high))
    return known.otherwise(F.when(name.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("unknown transform "), name)).cast("double")))


def log1p_minmax(x: Column | str, low: Column, high: Column) -> Column:
    """log1p, then linear scaling."""
    return minmax(F.log1p(at_least(col(x), 0.0)), F.log1p(at_least(low, 0.0)), F.log1p(at_least(high, 0.0)))


def hazard(term: Column | str, x: Column | str, low: Column, high: Column, pad: Column | float = C.UPPER_PAD) -> Column:
    """The transform a term's registry names; an unknown term raises."""
    term = col(term)
    known = F.when(term.isin(*C.LOG_TERMS), neg_log_minmax(x, low, high, pad)).when(term.isin(*C.TERMS), minmax(x, low, high))
    return known.otherwise(F.when(term.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("unknown term "), term)).cast("double")))


def age(year: Column | str) -> Column:
    return F.lit(float(C.REFERENCE_YEAR)) - col(year).cast("double")


def coal_retention(years: Column, decay=C.COAL_DECAY, cycle=C.COAL_CYCLE, recovery=C.COAL_RECOVERY) -> Column:
    """Sawtooth: decay within a cycle, part of a cycle's loss recovered at its end."""
    decay, cycle, recovery = lit(decay), lit(cycle), lit(recovery)
    cycles = F.floor(years / cycle).cast("double")
    return F.when(years <= 0, 1.0).otherwise(1.0 - cycles * (1.0 - recovery) * decay * cycle - decay * (years - cycles * cycle))


def fuel_retention(fuel: Column, years: Column, **rates) -> Column:
    """Retention of one thermal fuel; a fuel without a curve raises."""
    return (
        F.when(fuel == "coal", coal_retention(years, **rates)).when(fuel.isin(*C.NEUTRAL_FUELS), 1.0)
        .otherwise(F.raise_error(F.concat(F.lit("no age curve for fuel "), F.coalesce(fuel, F.lit("null")))).cast("double"))
    )


def multiplier(retention: Column) -> Column:
    return 2.0 - clip(retention, 0.0, 1.0)


def age_factor(bucket="bucket", year="commissioning_year", fuel="fuel_type", mixed="mixed_fuel_type", found="fuel_types_found", rates: dict | None = None) -> Column:
    """Age multiplier from 1 to 2; a missing year is neutral, a mixed plant takes the mean over its fuels.

    ``rates`` may hold columns, so a table of draws can supply them.
    """
    r = {"coal": C.COAL_DECAY, "wind": C.WIND_RATE, "hydro": C.HYDRO_RATE, "solar": C.SOLAR_RATE, "cycle": C.COAL_CYCLE, "recovery": C.COAL_RECOVERY} | (rates or {})
    bucket, years, coal = col(bucket), age(year), {"decay": r["coal"], "cycle": r["cycle"], "recovery": r["recovery"]}
    fuels = F.transform(F.split(col(found), ";"), F.trim)
    mean = F.aggregate(F.transform(fuels, lambda f: multiplier(fuel_retention(f, years, **coal))), F.lit(0.0), lambda a, x: a + x) / F.size(fuels)
    return (
        F.when(years.isNull(), 1.0).when(bucket == "hydro", multiplier(1.0 - lit(r["hydro"]) * years)).when(bucket == "wind", multiplier(1.0 - lit(r["wind"]) * years))
        .when(bucket == "solar", multiplier(F.pow(1.0 - lit(r["solar"]), years)))
        .when((bucket == "thermal") & F.coalesce(col(mixed), F.lit(False)), mean).when(bucket == "thermal", multiplier(fuel_retention(col(fuel), years, **coal)))
    )


def band(x: Column | str, cuts: list[Column], labels=C.BANDS) -> Column:
    """Left-closed bands: label i from cut i on; null stays null."""
    x = col(x)
    out = F.when(x.isNull(), None)
    for cut, label in reversed(list(zip(cuts, labels[1:]))):
        out = out.when(x >= cut, label)
    return out.otherwise(labels[0])


def index_label(x: Column | str, cut: Column | float = 0.5) -> Column:
    x = col(x)
    return F.when(x.isNull(), None).when(x >= 1.0, "EXTREME").when(x >= lit(cut), "HIGH").when(x > 0.0, "MEDIUM").otherwise("LOW")


def day_length(latitude: Column | str, day: Column | str) -> Column:
    """Hours of daylight from latitude in degrees and day of the year."""
    declination = F.lit(0.4093) * F.sin(F.lit(2 * 3.141592653589793 / 365) * col(day) - 1.405)
    return F.lit(24 / 3.141592653589793) * F.acos(clip(-F.tan(F.radians(col(latitude))) * F.tan(declination), -1.0, 1.0))


def evapotranspiration(celsius: Column, heat: Column, hours: Column, days: Column) -> Column:
    """Thornthwaite's monthly potential evapotranspiration in mm; none at or below zero degrees."""
    a = 6.75e-7 * F.pow(heat, F.lit(3.0)) - 7.71e-5 * F.pow(heat, F.lit(2.0)) + 1.792e-2 * heat + 0.49239
    return F.when(celsius.isNull() | heat.isNull(), None).when((celsius <= 0) | (heat <= 0), 0.0).otherwise(
        16.0 * F.pow(10.0 * celsius / F.nullif(heat, F.lit(0.0)), a) * (hours / 12.0) * (days / 30.0)
    )


def normal_quantile(p: Column) -> Column:
    """Abramowitz and Stegun 26.2.23."""
    t = F.sqrt(-2.0 * F.log(F.when(p <= 0.5, p).otherwise(1.0 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p.isNull(), None).when(p <= 0.5, -z).otherwise(z)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-x * x / 2.0) * poly
    return F.when(x.isNull(), None).when(x >= 0, 1.0 - upper).otherwise(upper)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0), 2)
    return F.lit(2.0 * C.EARTH_KM) * F.asin(F.sqrt(clip(h, 0.0, 1.0)))


def admin_codes(cell: Column | str) -> Column:
    """First-level admin codes in a JSON list cell; a bad cell gives none, and a bad entry is skipped."""
    entries = F.from_json(col(cell), "array<string>")
    pairs = F.flatten(F.transform(entries, lambda e: F.map_entries(F.coalesce(F.from_json(e, "map<string,string>"), F.create_map().cast("map<string,string>")))))
    codes = F.transform(F.filter(pairs, lambda p: p["key"].rlike("^gid_[0-9]+$")), lambda p: admin_code(p["value"], F.regexp_extract(p["key"], "[0-9]+", 0).cast("int")))
    return F.array_distinct(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def admin_code(code: Column, level: Column) -> Column:
    """A code cut back to the first level: none above it, deeper ones lose their further parts."""
    parts = F.split(F.regexp_replace(code, "_[0-9]+$", ""), r"\.")
    return F.when(code.isNull() | (level < 1) | (F.size(parts) < 2), None).otherwise(F.concat(F.concat_ws(".", F.slice(parts, 1, 2)), F.lit("_1")))


def content_id(prefix: Column | str, *fields: Column | str) -> Column:
    """Prefix and twelve hex digits of the fields' hash."""
    return F.concat(col(prefix), F.lit("-"), F.substring(F.sha2(F.concat_ws("\u001f", *map(col, fields)), 256), 1, 12))


def round_to(x: Column | str, tolerance: float) -> Column:
    """Nearest multiple of a tolerance, ties to even."""
    return F.rint(col(x) / F.lit(tolerance)) * F.lit(tolerance)


def uniform(*keys: Column | str) -> Column:
    """A draw from [0, 1) that depends on its keys only: the same at any partitioning."""
    digits = F.substring(F.md5(F.concat_ws("|", *(k if isinstance(k, Column) else F.col(k) for k in keys))), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(4503599627370496.0)


def between(u: Column, low: Column | float, high: Column | float) -> Column:
    return lit(low) + u * (lit(high) - lit(low))


def shifted(percentile: Column, shift: Column, top: Column | None = None) -> Column:
    """A percentile after a shift, within 0..100; with ``top`` (the set's largest) a positive shift keeps it below the ceiling."""
    if top is not None:
        shift = F.when(shift > 0, F.least(shift, F.lit(C.WIND_CEILING) - top)).otherwise(shift)
    return clip(percentile + shift, 0.0, 100.0)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean by weight; a missing value drops its weight."""
    value, weight = col(value), col(weight)
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def marker_size(capacity: Column | str, most: Column, low: float = 6.0, high: float = 168.0) -> Column:
    share = F.sqrt(clip(F.try_divide(F.greatest(F.coalesce(col(capacity), F.lit(0.0)), F.lit(0.0)), most), 0.0, 1.0))
    return low + (high - low) * F.coalesce(share, F.lit(0.0))
