"""Column functions: phases, geometry, limb darkening, labels, injection shapes, parsing.

Periodic remainders are written ``x - p * floor(x / p)``: the result is never negative, and the
last digit does not depend on how an engine rounds ``%``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Robust scale of the median absolute deviation, gravity constant (SI), seconds per day.
MAD_TO_SIGMA = 1.4826
GRAVITY = 6.674e-11
DAY_SECONDS = 86400.0


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def floor_mod(x: Column, p: Column) -> Column:
    return x - p * F.floor(x / p)


def clip(x: Column, low, high) -> Column:
    """Limit to [low, high]; NULL stays NULL, which ``greatest`` and ``least`` alone would lose."""
    return F.when(x.isNotNull(), F.greatest(lit(low), F.least(x, lit(high))))


def at_least(x: Column, floor) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, lit(floor)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def centred_phase(t: Column, t0: Column, period: Column) -> Column:
    """Phase in [-0.5, 0.5), transit at 0."""
    return floor_mod((t - t0) / period + F.lit(0.5), F.lit(1.0)) - F.lit(0.5)


def centred_phase_days(t: Column, t0: Column, period: Column) -> Column:
    """Days from the nearest transit, in [-P/2, P/2)."""
    half = F.lit(0.5) * period
    return floor_mod(t - t0 + half, period) - half


def phase_bin(t: Column, period: Column, n: int) -> Column:
    turn = floor_mod(t / period, F.lit(1.0))
    return F.greatest(F.lit(0), F.least(F.floor(turn * F.lit(float(n))), F.lit(n - 1))).cast("int")


def grid_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """0-based equal-width bin; outside [low, high) - the right edge included - is NULL."""
    i = F.floor((x - low) * F.lit(float(n)) / (high - low))
    return F.when((high > low) & (i >= 0) & (i < n), i.cast("int"))


def histogram_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """0-based equal-width bin with the right edge inside the last bin."""
    i = F.when(x == high, F.lit(n - 1)).otherwise(F.floor((x - low) * F.lit(float(n)) / (high - low)))
    return F.when((x >= low) & (x <= high), F.when(high > low, i).otherwise(F.lit(n // 2)).cast("int"))


def transit_duration(period: Column, rp: Column, ar: Column, b: Column) -> Column:
    """Total duration in days; grazing geometry gives 0."""
    chord = F.sqrt(at_least((F.lit(1.0) + rp) * (F.lit(1.0) + rp) - b * b, 0.0))
    sin_i = F.sqrt(clip(F.lit(1.0) - (b / ar) * (b / ar), 1e-8, 1.0))
    return period / F.lit(math.pi) * F.asin(clip(chord / (ar * sin_i), 0.0, 1.0))


def kipping_to_quadratic(q1: Column, q2: Column) -> tuple[Column, Column]:
    root, q2 = F.sqrt(clip(q1, 0, 1)), clip(q2, 0, 1)
    return F.lit(2.0) * root * q2, root * (F.lit(1.0) - F.lit(2.0) * q2)


def quadratic_to_kipping(u1: Column, u2: Column) -> tuple[Column, Column]:
    total = u1 + u2
    q2 = F.when(total > 0, u1 / (F.lit(2.0) * total)).otherwise(F.lit(0.0))
    return clip(total * total, 0, 1), clip(q2, 0, 1)


def scaled_axis_from_density(density: Column, period: Column, low: float, high: float) -> Column:
    """Semi-major axis over stellar radius from mean density (kg/m3) and period (days)."""
    seconds = period * F.lit(DAY_SECONDS)
    cube = F.lit(GRAVITY) * density * seconds * seconds / F.lit(3.0 * math.pi)
    return clip(F.pow(cube, F.lit(1.0 / 3.0)), low, high)


def stratum(value: Column, edges: tuple[float, float], names: Sequence[str]) -> Column:
    low, mid, high = names
    return (
        F.when(~is_finite(value) | value.isNull(), F.lit("unknown"))
        .when(value < F.lit(edges[0]), F.lit(low))
        .when(value < F.lit(edges[1]), F.lit(mid))
        .otherwise(F.lit(high))
    )


# Stratum edges and names of the stratified reports.
STRATA = {
    "impact": ((0.35, 0.70), ("low_b", "mid_b", "high_b")),
    "rprs": ((0.04, 0.09), ("shallow", "medium", "deep")),
    "a_rs": ((10.0, 25.0), ("compact", "mid", "wide")),
    "snr": ((25.0, 75.0), ("low_snr", "mid_snr", "high_snr")),
    "n_transits": ((3.0, 6.0), ("few", "several", "many")),
}


def transits_in(baseline: float, period: Column) -> Column:
    return F.floor(F.lit(float(baseline)) / at_least(period, 1e-9)) + F.lit(1)


def expected_points_in_transit(duration: Column, cadence_days: float, n_transits: Column) -> Column:
    per_transit = at_least(duration / F.lit(max(cadence_days, 1e-9)), 1.0)
    return per_transit * n_transits


def expected_snr(rp: Column, sigma: Column, n_in: Column, floor: float = 1e-12) -> Column:
    return rp * rp / at_least(sigma, floor) * F.sqrt(n_in)


def noise_feature(sigma: Column, log_low: float, log_high: float) -> Column:
    mid, half = 0.5 * (log_low + log_high), 0.5 * (log_high - log_low)
    return (F.log10(sigma) - F.lit(mid)) / F.lit(half)


def dilute(flux: Column, dilution) -> Column:
    return F.lit(1.0) + (flux - F.lit(1.0)) * lit(dilution)


def v_shaped_eclipse(t: Column, period: Column, t0: Column, depth: Column, duration: Column) -> Column:
    away = F.abs(centred_phase(t, t0, period)) * period
    return F.lit(1.0) - depth * clip(F.lit(1.0) - away / (F.lit(0.5) * duration), 0.0, 1.0)


def single_dip(t: Column, centre: Column, depth: Column, duration: Column) -> Column:
    u = (t - centre) / (F.lit(0.5) * duration)
    return F.lit(1.0) - depth * F.exp(F.lit(-0.5) * u * u)


def sinusoid(t: Column, amplitude, period, phase) -> Column:
    return F.lit(1.0) + lit(amplitude) * F.sin(F.lit(2.0 * math.pi) * t / lit(period) + lit(phase))


def parse_value(cell: Column) -> Column:
    """Number at the start of a text cell, with any unit dropped; NULL when there is none."""
    number = F.regexp_extract(cell, r"^\s*([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?)", 1)
    return number.try_cast("double")


def json_number(document: Column, path: str, default: float) -> Column:
    return F.coalesce(F.get_json_object(document, path).try_cast("double"), F.lit(float(default)))
