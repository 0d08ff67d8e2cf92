"""Posterior-sample calibration: ranks, uniformity, coverage, contraction, summaries, strata.

Samples are long, ``(object_id, draw, param, value)``; truths are ``(object_id, param, truth)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g

PAIR = ["object_id", "param"]
LEVELS = tuple(round(0.05 * i, 2) for i in range(1, 20))


# Interpolated interval ends carry noise in the last digit; a truth equal to an end must count as inside.
EDGE_DIGITS = 9


def within(x: Column, low: Column, high: Column) -> Column:
    return (x >= F.round(low, EDGE_DIGITS)) & (x <= F.round(high, EDGE_DIGITS))


def select_planets(df: DataFrame, label: str = "d") -> DataFrame:
    return df.filter(F.col(label) == 1)


def slice_parameters(samples: DataFrame, params: Sequence[str]) -> DataFrame:
    return samples.filter(F.col("param").isin(*params))


def expand_conditioned(samples: DataFrame, ephemeris: DataFrame, given: Sequence[str]) -> DataFrame:
    """Add the conditioning parameters to every draw. ``ephemeris``: (object_id, param, value)."""
    known = ephemeris.filter(F.col("param").isin(*given))
    draws = samples.select("object_id", "draw").distinct()
    added = draws.join(known, "object_id").select("object_id", "draw", "param", "value")
    return samples.select("object_id", "draw", "param", "value").unionByName(added)


def pair_truth(samples: DataFrame, truth: DataFrame) -> DataFrame:
    return samples.join(truth, PAIR)


def pair_wide(draws: DataFrame, truth: DataFrame, params: Sequence[str]) -> DataFrame:
    """Long (object_id, draw, param, value, truth) from wide draws and wide truths.

    One join on the object, a fourth of the rows of a long join for four parameters; when both sides
    come from one table partitioned by object it needs no further exchange, and neither does a later
    aggregate on (object_id, param).
    """
    known = truth.select("object_id", *[F.col(p).alias(f"_t_{p}") for p in params])
    return long_pairs(draws.join(known, "object_id"), params)


def long_pairs(lines: DataFrame, params: Sequence[str], *keep: str) -> DataFrame:
    """Long (object_id, draw, param, value, truth) from wide draws that carry the truth of ``p`` as ``_t_p``."""
    each = F.array(*[
        F.struct(F.lit(p).alias("param"), F.col(p).alias("value"), F.col(f"_t_{p}").alias("truth")) for p in params
    ])
    return lines.select("object_id", "draw", *keep, F.inline(each))


def sbc_ranks(pairs: DataFrame) -> DataFrame:
    """Samples strictly below the truth, and the number of samples."""
    return pairs.groupBy(*PAIR).agg(
        F.count_if(F.col("value") < F.col("truth")).alias("rank"), F.count(F.lit(1)).alias("n_draws")
    )


def sbc_uniformity(ranks: DataFrame, n_bins: int = 20, by: Sequence[str] = ("param",), scope: Sequence[str] = ()) -> DataFrame:
    """Chi-square of the rank histogram against uniform, per parameter.

    The range is the largest rank over all parameters (within ``scope``). A bin without ranks
    contributes the expected count itself, so empty bins need no rows.
    """
    by, scope = list(by), list(scope)
    # One row per distinct rank; its top is the largest rank of the scope.
    folded = ranks.groupBy(*dict.fromkeys([*scope, *by]), "rank").agg(F.count(F.lit(1)).alias("_k"))
    top = ranks.groupBy(*scope).agg(F.max("rank").alias("_top"))
    rows = g.safe_join(folded, top, scope) if scope else folded.crossJoin(F.broadcast(top))
    x = F.col("rank").cast("double")
    b = s.histogram_bin(x, s.lit(-0.5), F.col("_top") + s.lit(0.5), n_bins)
    counts = rows.groupBy(*by, b.alias("_bin")).agg(F.sum("_k").alias("_c"))
    expected = F.sum("_c") / s.lit(n_bins)
    # Sum of (c - e)^2 over all bins is sum(c^2) - n^2 / bins.
    return counts.groupBy(*by).agg(
        F.sum("_c").alias("n"),
        ((F.sum(F.col("_c") * F.col("_c")) - expected * F.sum("_c")) / F.greatest(expected, s.lit(1e-9))).alias("chi2"),
    )


def _erfc_root(y: Column) -> Column:
    """erfc of the root of ``y`` >= 0: the power series of erf up to 4, the continued fraction beyond, both of fixed length."""
    root, steps = F.sqrt(y), F.sequence(F.lit(1), F.lit(60))
    start = F.struct(s.lit(1.0).alias("term"), s.lit(1.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * y / (i + s.lit(0.5))
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    series = s.lit(1.0) - s.lit(2.0 / math.sqrt(math.pi)) * root * F.exp(-y) * F.aggregate(steps, start, add, lambda a: a["total"])
    tail = F.aggregate(F.reverse(steps), s.lit(0.0), lambda a, i: i / s.lit(2.0) / (root + a))
    return F.when(y < 4, series).otherwise(F.exp(-y) / s.lit(math.sqrt(math.pi)) / (root + tail))


def chi2_survival(x: Column, df: int) -> Column:
    """Upper tail of chi-square with whole degrees of freedom, as its finite series."""
    y = s.lit(0.5) * x
    half, shift = df // 2, (df % 2) * 0.5
    first = s.lit(1.0) if df % 2 == 0 else F.sqrt(y) / s.lit(math.gamma(1.5))
    # Terms y^(i + shift) / Gamma(i + 1 + shift) for i below half.
    start = F.struct(first.alias("term"), s.lit(0.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        return F.struct((a["term"] * y / (i + s.lit(shift))).alias("term"), (a["total"] + a["term"]).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(half)), start, add, lambda a: a["total"]) if half else s.lit(0.0)
    tail = F.exp(-y) * total + (_erfc_root(y) if df % 2 else s.lit(0.0))
    return F.when(y <= 0, s.lit(1.0)).otherwise(tail)


def with_pvalue(uniformity: DataFrame, n_bins: int = 20) -> DataFrame:
    """Adds ``pvalue``."""
    return uniformity.withColumn("pvalue", chi2_survival(F.col("chi2"), n_bins - 1))


def rank_histogram(ranks: DataFrame, n_bins: int = 10, by: Sequence[str] = ("param",)) -> DataFrame:
    """Relative rank counts, 1 = uniform, last bin closed."""
    share = F.col("rank") / F.col("n_draws").cast("double")
    rows = ranks.withColumn("bin", s.histogram_bin(share, s.lit(0.0), s.lit(1.0), n_bins))
    counts = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(share).alias("rank_mean"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    joined = grid.join(counts, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return joined.withColumn("density", F.bround(F.col("count") / (F.col("n") / s.lit(n_bins)), 3))


def covered(pairs: DataFrame, levels: Sequence[float] = LEVELS, *, bounded: bool = False) -> DataFrame:
    """Does the central interval hold the truth, per object, parameter and level.

    All quantiles of an (object, parameter) come from one aggregate.
    """
    asked = {}
    for i, a in enumerate(levels):
        asked[f"_lo{i}"] = (F.col("value"), (1 - a) / 2)
        asked[f"_hi{i}"] = (F.col("value"), (1 + a) / 2)
    found = g.group_stats(pairs, PAIR, quantiles=asked, aggs={"truth": F.first("truth")}, bounded=bounded)
    each = F.array(*[
        F.struct(
            s.lit(a).alias("level"),
            within(F.col("truth"), F.col(f"_lo{i}"), F.col(f"_hi{i}")).alias("inside"),
        )
        for i, a in enumerate(levels)
    ])
    return found.select("object_id", "param", F.inline(each))


def coverage_shares(inside: DataFrame) -> DataFrame:
    """Share of truths inside the central interval, per level and parameter, from `covered`."""
    return inside.groupBy("level", "param").agg(F.avg(F.col("inside").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def coverage(pairs: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    return coverage_shares(covered(pairs, levels))


def coverage_overall(per_param: DataFrame) -> DataFrame:
    return per_param.groupBy("level").agg(F.avg("coverage").alias("coverage"))


def calibration_error(overall: DataFrame) -> DataFrame:
    return overall.agg(F.avg(F.abs(F.col("coverage") - F.col("level"))).alias("calibration_error"))


def contraction(samples: DataFrame, prior_std: DataFrame) -> DataFrame:
    """1 - posterior variance / prior variance. ``prior_std``: one row per parameter."""
    spread = samples.groupBy(*PAIR).agg(F.var_pop("value").alias("_v"))
    ratio = F.try_divide(F.col("_v"), F.col("prior_std") * F.col("prior_std"))
    return spread.join(F.broadcast(prior_std), "param").select(*PAIR, (s.lit(1.0) - ratio).alias("contraction"))


def negative_log_truth(pairs: DataFrame) -> DataFrame:
    """-log density of the truth under the normal with the samples' mean and variance."""
    m = pairs.groupBy(*PAIR).agg(
        F.first("truth").alias("truth"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")
    )
    gap = F.col("truth") - F.col("_m")
    nll = s.lit(0.5) * (F.ln(s.lit(2 * math.pi) * F.col("_v")) + gap * gap / F.col("_v"))
    return m.select(*PAIR, F.when(F.col("_v") > 0, nll).alias("nll"))


def posterior_summary(pairs: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Posterior against the published value of each parameter; unpublished ones are left out."""
    v, t = F.col("value"), F.col("truth")
    rows = pairs.filter(s.is_finite(t))
    found = g.group_stats(
        rows, PAIR,
        quantiles={"post_median": (v, 0.5), "_q16": (v, 0.16), "_q84": (v, 0.84), "_q025": (v, 0.025), "_q975": (v, 0.975)},
        aggs={"published": F.first("truth"), "post_std": F.stddev_pop("value")}, bounded=bounded,
    )
    miss = F.col("post_median") - F.col("published")
    return found.select(
        *PAIR, "published", "post_median", "post_std",
        F.when(F.col("post_std") > 0, miss / F.col("post_std")).alias("z"),
        F.try_divide(F.abs(miss), F.abs("published")).alias("frac_err"),
        within(F.col("published"), F.col("_q16"), F.col("_q84")).alias("in_68"),
        within(F.col("published"), F.col("_q025"), F.col("_q975")).alias("in_95"),
    )


def per_param_summary(summary: DataFrame, by: Sequence[str] = ("param",)) -> DataFrame:
    return g.group_stats(
        summary, list(by),
        quantiles={"median_frac_err": (F.col("frac_err"), 0.5)},
        aggs={
            "n": F.count(F.lit(1)),
            "coverage_68": F.avg(F.col("in_68").cast("double")),
            "coverage_95": F.avg(F.col("in_95").cast("double")),
            "mean_abs_z": F.avg(F.abs("z")),
        },
    )


def interval_widths(pairs: DataFrame, *, bounded: bool = False) -> DataFrame:
    """68% interval of each (object, parameter): width and whether it holds the truth."""
    v = F.col("value")
    found = g.group_stats(
        pairs, PAIR, quantiles={"_lo": (v, 0.16), "_hi": (v, 0.84)}, aggs={"truth": F.first("truth")}, bounded=bounded,
    )
    return found.select(
        *PAIR, (F.col("_hi") - F.col("_lo")).alias("width"), within(F.col("truth"), F.col("_lo"), F.col("_hi")).alias("inside")
    )


def stratified_characterization(widths: DataFrame, strata: DataFrame) -> DataFrame:
    """Coverage and median width per stratification, stratum and parameter.

    ``strata``: (object_id, spec, label) from ``catalog.unpivot_strata``.
    """
    rows = widths.join(strata, "object_id")
    return g.group_stats(
        rows, ["spec", "label", "param"],
        quantiles={"median_width": (F.col("width"), 0.5)},
        aggs={"n": F.count(F.lit(1)), "cov68": F.avg(F.col("inside").cast("double"))},
    )


# Transit-count regimes of the period report.
REGIMES = ((0.0, 3.0, "under_3"), (3.0, 6.0, "3_to_6"), (6.0, 15.0, "6_to_15"), (15.0, float("inf"), "over_15"))


def regime(n_transits: Column) -> Column:
    found = F.lit(None).cast("string")
    for low, high, name in reversed(REGIMES):
        found = F.when((n_transits >= low) & (n_transits < high), F.lit(name)).otherwise(found)
    return found


def period_strata(ranked: DataFrame, min_objects: int = 30) -> DataFrame:
    """Rank and error statistics per transit-count regime with enough objects.

    ``ranked``: (object_id, truth, post_median, rank, n_draws, n_transits).
    """
    rel = (F.col("post_median") - F.col("truth")) / F.col("truth")
    rows = ranked.withColumn("regime", regime(F.col("n_transits"))).withColumn("rel", rel).filter("regime is not null")
    stats = g.group_stats(
        rows, ["regime"],
        quantiles={"median_rel_err": (F.col("rel"), 0.5)},
        aggs={
            "n": F.count(F.lit(1)),
            "rank_mean": F.avg(F.col("rank") / F.col("n_draws").cast("double")),
            "frac_within_5pct": F.avg((F.abs("rel") < 0.05).cast("double")),
        },
    ).filter(F.col("n") >= min_objects)
    chi = sbc_uniformity(rows, by=("regime",), scope=("regime",)).drop("n")
    return stats.join(chi, "regime")


def alias_mass(pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Share of samples within tolerance of the truth, its half and its double."""

    def near(c):
        return F.avg((F.try_divide(F.abs(F.col("value") - c), c) < tolerance).cast("double"))

    t = F.col("truth")
    return pairs.groupBy(*PAIR).agg(
        near(t).alias("primary_mass"), near(t / 2).alias("half_mass"), near(t * 2).alias("double_mass")
    )


def alias_by_regime(masses: DataFrame, n_transits: DataFrame, min_objects: int = 30) -> DataFrame:
    rows = masses.join(n_transits, "object_id").withColumn("regime", regime(F.col("n_transits")))
    means = [F.bround(F.avg(f"{k}_mass"), 3).alias(f"{k}_mass") for k in ("primary", "half", "double")]
    return rows.filter("regime is not null").groupBy("regime").agg(F.count(F.lit(1)).alias("n"), *means).filter(
        F.col("n") >= min_objects
    )


def weighted_rank(pairs: DataFrame, weight: str = "w") -> DataFrame:
    """Weight below the truth: the rank statistic of a reweighted posterior."""
    return pairs.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("value") < F.col("truth"), F.col(weight)).otherwise(0.0)).alias("cdf"),
        F.count_if(F.col("value") < F.col("truth")).alias("rank"),
        F.count(F.lit(1)).alias("n_draws"),
    )


def corrected_sbc(ranked: DataFrame, n_scale: int, n_bins: int = 20) -> DataFrame:
    """Uniformity before and after reweighting, per parameter."""
    before = sbc_uniformity(ranked, n_bins).select("param", "n", F.col("chi2").alias("chi2_flow"))
    moved = ranked.withColumn("rank", F.floor(F.round(F.col("cdf") * s.lit(n_scale), 9)).cast("long"))
    after = sbc_uniformity(moved, n_bins).select("param", F.col("chi2").alias("chi2_corrected"))
    return before.join(after, "param")


def slab_probability(samples: DataFrame, floor: float, margin: float) -> DataFrame:
    return samples.groupBy("object_id").agg(
        F.avg((F.col("value") > floor + margin).cast("double")).alias("p_detect"), F.count(F.lit(1)).alias("n")
    )


def prior_moments(standardised: DataFrame) -> DataFrame:
    return standardised.groupBy("param").agg(
        F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count(F.lit(1)).alias("n")
    )
