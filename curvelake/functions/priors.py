"""Box priors over named parameters: u-space, standardised space, densities."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEG_INF = float("-inf")


@dataclass(frozen=True)
class Range:
    """Support of one parameter; ``log`` means uniform in the logarithm."""

    param: str
    low: float
    high: float
    log: bool = False


def transit_ranges(period_high: float = 13.0) -> tuple[Range, ...]:
    """Prior support of the seven transit parameters (13 d or 50 d period limit)."""
    return (
        Range("P", 0.5, period_high, True),
        Range("t0_phase", 0.0, 1.0),
        Range("RpRs", 0.01, 0.15, True),
        Range("aRs", 3.0, 50.0, True),
        Range("b", 0.0, 1.1),
        Range("q1", 0.0, 1.0),
        Range("q2", 0.0, 1.0),
    )


def prior_table(spark: SparkSession, ranges) -> DataFrame:
    """One row per parameter; a handful of rows by construction, so safe to broadcast.

    Derived columns use the same expressions as the samples, so a sample on the edge of the support
    lands on the edge in u-space and in standardised space too.
    """
    rows = [(r.param, float(r.low), float(r.high), r.log) for r in ranges]
    table = spark.createDataFrame(rows, "param string, low double, high double, is_log boolean")
    return table.withColumns(_derived(F.col("low"), F.col("high"), F.col("is_log")))


def constants(r: Range) -> dict[str, Column]:
    """The columns of ``prior_table`` for one parameter as expressions, where its values stand in a column of their own."""
    low, high, is_log = F.lit(float(r.low)), F.lit(float(r.high)), F.lit(r.log)
    return {"low": low, "high": high, "is_log": is_log, **_derived(low, high, is_log)}


def _derived(low: Column, high: Column, is_log: Column) -> dict[str, Column]:
    u_low, u_high = physical_to_u(low, is_log), physical_to_u(high, is_log)
    mean, std = F.lit(0.5) * (u_low + u_high), (u_high - u_low) / F.sqrt(F.lit(12.0))
    return {"u_low": u_low, "u_high": u_high, "u_mean": mean, "u_std": std, "z_low": (u_low - mean) / std, "z_high": (u_high - mean) / std}


def with_prior(samples: DataFrame, ranges) -> DataFrame:
    """Long samples with their parameter's prior constants."""
    return samples.join(F.broadcast(prior_table(samples.sparkSession, ranges)), "param")


def physical_to_u(value: Column, is_log: Column) -> Column:
    return F.when(is_log, F.ln(F.greatest(value, F.lit(1e-12)))).otherwise(value)


def u_to_physical(u: Column, is_log: Column) -> Column:
    return F.when(is_log, F.exp(u)).otherwise(u)


def _given(prior: Mapping[str, Column] | None) -> Mapping[str, Column]:
    return prior or {c: F.col(c) for c in ("is_log", "u_low", "u_high", "u_mean", "u_std")}


def physical_to_std(value: Column, prior: Mapping[str, Column] | None = None) -> Column:
    """Standardised value; expects the ``with_prior`` columns, or ``constants``."""
    p = _given(prior)
    return (physical_to_u(value, p["is_log"]) - p["u_mean"]) / p["u_std"]


def std_to_physical(z: Column, clip: bool = True, prior: Mapping[str, Column] | None = None) -> Column:
    p = _given(prior)
    u = z * p["u_std"] + p["u_mean"]
    if clip:
        u = F.greatest(p["u_low"], F.least(u, p["u_high"]))
    return u_to_physical(u, p["is_log"])


def in_support(value: Column) -> Column:
    u = physical_to_u(value, F.col("is_log"))
    return F.coalesce((u >= F.col("u_low")) & (u <= F.col("u_high")), F.lit(False))


def log_density_physical(samples: DataFrame, ids: list[str], ranges, value: str = "value") -> DataFrame:
    """Joint log prior per id in physical space, -inf outside the box."""
    v = F.col(value)
    one = -F.ln(F.col("u_high") - F.col("u_low")) - F.when(
        F.col("is_log"), F.ln(F.greatest(v, F.lit(1e-300)))
    ).otherwise(F.lit(0.0))
    grouped = with_prior(samples, ranges).groupBy(*ids).agg(
        F.sum(one).alias("_lp"), F.bool_and(in_support(v)).alias("inside")
    )
    return grouped.select(
        *ids, "inside", F.when(F.col("inside"), F.col("_lp")).otherwise(F.lit(NEG_INF)).alias("log_prior")
    )


def log_density_std(samples: DataFrame, ids: list[str], ranges, z: str = "z") -> DataFrame:
    """Joint log prior per id in standardised space: constant in the box, -inf outside."""
    inside = (F.col(z) >= F.col("z_low")) & (F.col(z) <= F.col("z_high"))
    grouped = with_prior(samples, ranges).groupBy(*ids).agg(
        F.sum(-F.ln(F.col("z_high") - F.col("z_low"))).alias("_lp"), F.bool_and(inside).alias("inside")
    )
    return grouped.select(
        *ids, "inside", F.when(F.col("inside"), F.col("_lp")).otherwise(F.lit(NEG_INF)).alias("log_prior_std")
    )
