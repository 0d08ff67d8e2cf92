"""Model flux, likelihoods, importance weights and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g

DRAW = ["object_id", "draw"]
#: Width of a class of log weights that are summed together.
LOG_STEP = 100.0


def transit_flux(t: Column, p: dict[str, Column], n_radial: int) -> Column:
    """Normalised flux of a limb-darkened star with a planet in front, circular orbit.

    ``p``: P, t0, RpRs, aRs, b, u1, u2. The ring sum runs inside one row expression and only where the
    disks can overlap, so no rows are multiplied and no Python is involved.
    """
    angle = s.lit(2 * math.pi) * (t - p["t0"]) / p["P"]
    cos_i = p["b"] / p["aRs"]
    side, up = F.sin(angle), cos_i * F.cos(angle)
    z = p["aRs"] * F.sqrt(side * side + up * up)
    k = p["RpRs"]
    overlap = (F.cos(angle) > 0) & (z < s.lit(1.0) + k)

    def ring(i: Column) -> Column:
        r = (i + s.lit(0.5)) / s.lit(n_radial)
        dark = s.lit(1.0) - F.sqrt(s.lit(1.0) - r * r)
        light = (s.lit(1.0) - p["u1"] * dark - p["u2"] * dark * dark) * r
        edge = (r * r + z * z - k * k) / (s.lit(2.0) * r * z + s.lit(1e-12))
        arc = (
            F.when(z < 1e-12, F.when(r <= k, s.lit(1.0)).otherwise(s.lit(0.0)))
            .when(edge <= -1, s.lit(1.0))
            .when(edge >= 1, s.lit(0.0))
            .otherwise(F.acos(s.clip(edge, -1, 1)) / s.lit(math.pi))
        )
        return F.struct(light.alias("all"), (light * arc).alias("hidden"))

    rings = F.transform(F.sequence(F.lit(0), F.lit(n_radial - 1)), ring)
    zero = F.struct(s.lit(0.0).alias("all"), s.lit(0.0).alias("hidden"))
    hidden = F.aggregate(
        rings, zero,
        lambda acc, x: F.struct((acc["all"] + x["all"]).alias("all"), (acc["hidden"] + x["hidden"]).alias("hidden")),
        lambda acc: acc["hidden"] / acc["all"],
    )
    return F.when(overlap, s.lit(1.0) - hidden).otherwise(s.lit(1.0))


def exposure_flux(t: Column, p: dict[str, Column], n_radial: int, exposure_days: float, n_points: int) -> Column:
    """Mean of the model at evenly spaced times across the exposure; one point is instantaneous."""
    if n_points <= 1 or exposure_days <= 0:
        return transit_flux(t, p, n_radial)
    offsets = [(-0.5 + i / (n_points - 1)) * exposure_days for i in range(n_points)]
    total = sum((transit_flux(t + s.lit(o), p, n_radial) for o in offsets[1:]), transit_flux(t + s.lit(offsets[0]), p, n_radial))
    return total / s.lit(n_points)


def log_likelihood(predicted: DataFrame) -> DataFrame:
    """-0.5 * sum of squared scaled residuals. ``predicted``: (object_id, draw, flux, model, sigma)."""
    u = (F.col("flux") - F.col("model")) / F.col("sigma")
    observed = s.is_finite(F.col("flux"))
    return predicted.filter(observed).groupBy(*DRAW).agg(
        (s.lit(-0.5) * F.sum(u * u)).alias("loglik"), F.count(F.lit(1)).alias("n")
    )


def dilution_grid(fraction: float, low: float, high: float, n: int) -> list[tuple[float, float]]:
    """(dilution, weight) pairs: the undiluted branch and an even grid."""
    if fraction <= 0 or n <= 1:
        return [(1.0, 1.0)]
    low, high = min(low, high), max(low, high)
    grid = [(low + (high - low) * i / (n - 1), fraction / n) for i in range(n)]
    return ([(1.0, 1.0 - fraction)] if fraction < 1 else []) + grid


def marginal_log_likelihood(predicted: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """Log likelihood averaged over dilution.

    A diluted model is linear in the dilution, so the residual sum for any dilution follows from three
    sums per draw. Cadences are read once, however long the grid; the stable log-sum-exp then runs on
    one row per draw.
    """
    rest, dip = F.col("flux") - s.lit(1.0), F.col("model") - s.lit(1.0)
    v = F.col("sigma") * F.col("sigma")
    sums = predicted.filter(s.is_finite(F.col("flux"))).groupBy(*DRAW).agg(
        F.sum(rest * rest / v).alias("_rr"), F.sum(rest * dip / v).alias("_rm"), F.sum(dip * dip / v).alias("_mm")
    )

    def term(d, w):
        chi = F.col("_rr") - s.lit(2 * d) * F.col("_rm") + s.lit(d * d) * F.col("_mm")
        return s.lit(-0.5) * chi + s.lit(math.log(w))

    rows = sums.withColumn("_l", F.array(*[term(d, w) for d, w in grid])).withColumn("_top", F.array_max("_l"))
    spread = F.aggregate("_l", s.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top")))
    return rows.select(*DRAW, (F.col("_top") + F.ln(spread)).alias("loglik"))


def importance_weights(draws: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Normalised weights from ``loglik + logprior - logq`` per object.

    Non-finite terms weigh 0; an object without any finite term gets equal weights.
    """
    logw = s.finite_or_null(F.col("loglik") + F.col("logprior") - F.col("logq"))
    rows = draws.withColumn("logw", logw)
    own = F.coalesce(F.exp(F.col("logw") - F.col("_top")), s.lit(0.0))
    w = F.when(F.col("_s") > 0, own / F.col("_s")).otherwise(s.lit(1.0) / F.col("_n"))
    if bounded:
        rows = g.attach_stats(rows, ["object_id"], aggs={"_top": F.max("logw"), "_n": F.count(F.lit(1))}, bounded=True)
        rows = g.attach_stats(rows, ["object_id"], aggs={"_s": F.sum(own)}, bounded=True)
        return rows.withColumn("w", w).drop("_top", "_n", "_s")
    # Terms of a class are summed relative to it: the largest term and the sum of an object come from one pass over its draws.
    level = F.floor(F.col("logw") / LOG_STEP)
    parts = rows.groupBy("object_id", level.alias("_d")).agg(
        F.sum(F.exp(F.col("logw") - level * LOG_STEP)).alias("_e"), F.max("logw").alias("_m"), F.count(F.lit(1)).alias("_k"),
    )
    tops = parts.groupBy("object_id").agg(F.max("_m").alias("_top"))
    scaled = F.coalesce(F.col("_e") * F.exp(F.col("_d") * LOG_STEP - F.col("_top")), s.lit(0.0))
    sums = g.join_groups(parts, tops, ["object_id"]).groupBy("object_id").agg(F.first("_top").alias("_top"), F.sum("_k").alias("_n"), F.sum(scaled).alias("_s"))
    rows = g.join_groups(rows, sums, ["object_id"])
    return rows.withColumn("w", w).drop("_top", "_n", "_s")


def effective_fraction(weighted: DataFrame, weight: str = "w") -> DataFrame:
    """(sum w)^2 / sum w^2 / N; 0 when every weight is 0."""
    w = F.col(weight)
    return weighted.groupBy("object_id").agg(
        F.coalesce(
            F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w) * F.count(F.lit(1)).cast("double")), s.lit(0.0)
        ).alias("ess_fraction"),
        F.sum(w).alias("total"),
    )


def resample(weighted: DataFrame, n_out: int, order: list[Column], *, digits: int = 9) -> DataFrame:
    """Systematic resampling: n_out evenly spaced points on the cumulative weight.

    Each draw writes out its own copies, so the result is deterministic and needs no join.
    """
    rows = g.running(weighted, ["object_id"], order, {"_c": F.col("w")})
    upper = F.floor(F.round(s.lit(n_out) * F.col("_c"), digits) + s.lit(0.5))
    lower = F.floor(F.round(s.lit(n_out) * (F.col("_c") - F.col("w")), digits) + s.lit(0.5))
    copies = F.greatest(upper - lower, F.lit(0)).cast("int")
    return (
        rows.withColumn("copies", copies).filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_c")
    )


def correct_posterior(
    cadence: DataFrame, draws: DataFrame, params: dict[str, Column], *, n_radial: int, grid: Sequence[tuple[float, float]], n_out: int, digits: int = 9,
) -> DataFrame:
    """Draws with their model likelihood, weight and number of copies in a sample of ``n_out``, per object.

    ``cadence``: (object_id, t, flux, sigma) and what ``params`` reads; ``draws``: (object_id, draw, logprior, logq) and the same. The
    flux of every draw is computed at every cadence of its object inside one expression pipeline: the draws of an object travel as one
    list to its cadences, which are dealt over many tasks, and each task hands on three sums for each draw. An object has
    as many draws as the sampler gave it, some thousand at most.
    """
    packed = draws.groupBy("object_id").agg(F.collect_list(F.struct(*[c for c in draws.columns if c != "object_id"])).alias("_draws"))
    predicted = g.join_groups(cadence, packed, ["object_id"]).select(*cadence.columns, F.inline("_draws"))
    predicted = predicted.withColumn("model", transit_flux(F.col("t"), params, n_radial))
    likely = marginal_log_likelihood(predicted, grid)
    # One row for each draw on both sides.
    weighted = importance_weights(g.safe_join(draws, likely, DRAW, "left"))
    upto = g.running(weighted, ["object_id"], [F.col("draw").asc()], {"_c": F.col("w")})
    place = lambda c: F.floor(F.round(s.lit(n_out) * c, digits) + s.lit(0.5))
    return upto.withColumn("copies", (place(F.col("_c")) - place(F.col("_c") - F.col("w"))).cast("int")).drop("_c", "logw")
