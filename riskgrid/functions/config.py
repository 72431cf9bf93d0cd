"""Registry tables: hazards, thresholds, bounds, rules and parameters as data that operators join."""

from __future__ import annotations

# Fixed values of the method: terms, applicability, thresholds, bounds, rules and parameter ranges.
TERMS = ("ws", "heat", "sv", "iv", "spei", "precip", "wind")
LOG_TERMS = ("ws", "heat", "wind")
MODEL_TERMS = ("heat", "spei", "precip")
BUCKETS = ("hydro", "thermal", "wind", "solar")
MODELS = ("gfdl_esm4", "miroc6")
SCENARIOS = (("opt", "ssp126"), ("bau", "ssp370"), ("pes", "ssp585"))
APPLICABLE = {"hydro": ("ws", "spei", "precip", "sv", "iv"), "thermal": ("ws", "heat", "precip"), "wind": ("wind",), "solar": ("heat", "precip", "wind")}
BANDS = ("Low", "Medium", "High", "Extreme")
WATER_CUTS = (0.1, 0.4, 0.8)
WIND_CUT = 25.0
GENERIC_PERCENTILES = (50.0, 75.0, 90.0, 95.0)
GUST_PERCENTILES = (75.0, 90.0, 95.0, 99.0)
FROZEN_BOUNDS = {
    ("ws", None): (3.3699998880365456e-07, 29.883182525634766), ("sv", None): (0.060949064791202545, 1.6313080787658691),
    ("iv", None): (0.1379709094762802, 2.4342257976531982), ("heat", "gfdl_esm4"): (0.0, 159.89999389648438),
    ("heat", "miroc6"): (0.0, 274.20001220703125), ("spei", "gfdl_esm4"): (1.4441261291503906, 4.022922515869141),
    ("spei", "miroc6"): (1.2722063064575195, 4.160458564758301), ("precip", "gfdl_esm4"): (0.36666667461395264, 13.800000190734863),
    ("precip", "miroc6"): (0.7666666507720947, 12.566666603088379), ("wind", None): (9.123578071594238, 31.070894241333008),
}
UPPER_PAD = 0.05
REFERENCE_YEAR = 2050
COAL_DECAY, COAL_CYCLE, COAL_RECOVERY = 0.0025, 5.0, 0.70
WIND_RATE, HYDRO_RATE, SOLAR_RATE = 0.004, 0.0055, 0.007
NEUTRAL_FUELS = ("oil/gas", "nuclear", "bioenergy")
FUEL_BUCKETS = {
    "hydropower": "hydro", "wind": "wind", "utility-scale solar": "solar", "coal": "thermal", "oil/gas": "thermal", "nuclear": "thermal",
    "bioenergy": "thermal", "geothermal": "thermal",
}
PAIRS = (
    ("precip", "ws", True, ("hydro", "thermal")), ("precip", "spei", True, ("hydro",)), ("sv", "ws", True, ("hydro", "thermal")),
    ("iv", "ws", True, ("hydro", "thermal")), ("sv", "iv", True, ("hydro", "thermal")), ("ws", "spei", False, ("hydro",)),
)
PRIMACY = {("precip", "ws", "hydro"): "precip", ("precip", "ws", "thermal"): "ws", ("precip", "spei", "hydro"): "spei"}
DATA_TIER = {"ws": 1, "spei": 3, "precip": 3, "sv": 4, "iv": 4}
GATE, NONLINEAR, SKEWED = 0.80, 0.10, 0.5
SWEPT = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
LABELS = LABELS_BY_BAND = ("LOW", "MEDIUM", "HIGH", "EXTREME")
EXCLUDED_TERMS = ("wildfire", "slr")
SHIFTED_CUTS = (0.4, 0.5, 0.6)
PARAMETERS = (
    ("coal_decay_rate", 0.0019, 0.0044), ("wind_relative_rate", 0.0030, 0.0050), ("hydro_retention_rate", 0.0050, 0.0060),
    ("solar_retention_rate", 0.0056, 0.0084), ("coal_overhaul_cycle_years", 4.0, 6.0), ("coal_overhaul_recovery", 0.56, 0.84),
    ("upper_tail_padding_fraction", 0.04, 0.06), ("spei_percentile_shift", -5.0, 5.0), ("precip_percentile_shift", -5.0, 5.0),
    ("heat_percentile_shift", -5.0, 5.0), ("sv_percentile_shift", -5.0, 5.0), ("iv_percentile_shift", -5.0, 5.0), ("wind_percentile_shift", -5.0, 5.0),
)
WIND_CEILING = 99.5
EVENT_TERMS = {"Extreme temperature": "heat", "Drought": "spei", "Flood": "precip", "Storm": "wind"}
ZONAL_TERMS = {"Extreme temperature": "heat", "Drought": "spei", "Flood": "ws"}
EVENT_WEIGHT, EVENT_YEARS = 0.5, 124
FIRST_YEAR, GALE_KT, RADIUS_KM, EARTH_KM = 2000, 34.0, 100.0, 6371.0088
KELVIN, HOT_K, WET_MM, YEARS = 273.15, 313.15, 1.0, 30
WATER_TAU = {"ws": 0.4, "iv": 0.665, "sv": 0.5}


def applicability() -> list[tuple[str, str, int, int]]:
    """Rows (bucket, term, position in the bucket's set, size of the set)."""
    return [(b, t, k, len(ts)) for b, ts in APPLICABLE.items() for k, t in enumerate(ts)]


def thresholds() -> list[tuple[str, str, str, float | None, float | None, float | None, list[float] | None]]:
    """Rows (bucket, term, kind, fixed cuts 1-3, percentiles): a binary cut has one, and goes from Low to Extreme."""
    rows = []
    for b, ts in APPLICABLE.items():
        for t in ts:
            if t == "ws":
                rows.append((b, t, "absolute", *WATER_CUTS, None))
            elif (b, t) == ("wind", "wind"):
                rows.append((b, t, "binary", WIND_CUT, None, None, None))
            else:
                rows.append((b, t, "percentile", None, None, None, list(GUST_PERCENTILES if t == "wind" else GENERIC_PERCENTILES)))
    return rows


def tie_breakers() -> list[tuple[str, str, str, str, int]]:
    """Rows (term_a, term_b, bucket, retained term, criterion) for every gated pair."""
    rows = []
    for a, b, gated, buckets in PAIRS:
        for bucket in buckets if gated else ():
            if (a, b, bucket) in PRIMACY:
                rows.append((a, b, bucket, PRIMACY[a, b, bucket], 1))
            elif DATA_TIER[a] != DATA_TIER[b]:
                rows.append((a, b, bucket, min(a, b, key=DATA_TIER.get), 2))
            else:
                rows.append((a, b, bucket, "iv", 3))
    return rows
