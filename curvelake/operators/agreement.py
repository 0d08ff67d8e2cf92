"""Distances between two sample sets and the agreement reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g

PAIR = ["object_id", "param"]


def merge_sides(a: DataFrame, b: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Both sample sets in one table with a side flag: no join of the sets."""
    cols = [*keys, "value"]
    return a.select(*cols, F.lit("a").alias("side")).unionByName(b.select(*cols, F.lit("b").alias("side")))


def _steps(sides: DataFrame, keys: Sequence[str], bounded: bool) -> DataFrame:
    """Rows in order of value with ``_step``, the area up to the next one, and the sizes ``n_a`` and ``n_b`` of the sides."""
    order, sums, totals = [F.col("value").asc()], {"_ca": F.col("_a"), "_cb": F.col("_b")}, {"n_a": F.col("_a"), "n_b": F.col("_b")}
    following = {"_next": lambda w: F.lead("value").over(w)}
    if bounded:
        # Of equal values the last has seen all of them, and the others are no step away from the next.
        rows = sides.withColumns({f"_{side}": F.when(F.col("side") == side, 1).otherwise(0).cast("long") for side in "ab"})
    else:
        # Equal values fold to one row with a count per side.
        rows = sides.groupBy(*keys, "value").agg(*[F.count_if(F.col("side") == side).alias(f"_{side}") for side in "ab"])
    rows = g.sliding(rows, keys, order, following, after=1, bounded=bounded)
    rows = g.running(rows, keys, order, sums, totals=totals, bounded=bounded)
    gap = F.abs(F.col("_ca") / F.col("n_a").cast("double") - F.col("_cb") / F.col("n_b").cast("double"))
    step = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), gap * F.coalesce(F.col("_next") - F.col("value"), s.lit(0.0)))
    return rows.withColumn("_step", step)


def _area() -> dict[str, Column]:
    return {"wasserstein": F.sum("_step"), "n_a": F.max("n_a"), "n_b": F.max("n_b")}


def wasserstein(sides: DataFrame, keys: Sequence[str] = PAIR, *, bounded: bool = False) -> DataFrame:
    """Area between the two empirical distribution functions, per group, in one ordered pass."""
    return g.group_stats(_steps(sides, list(keys), bounded), list(keys), aggs=_area())


def normalized_wasserstein(sides: DataFrame, ranges: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Distance as a fraction of the prior range and of the wider 68% interval.

    ``ranges``: (param, prior_range), one row per parameter.
    """
    on = {side: F.when(F.col("side") == side, F.col("value")) for side in "ab"}
    wanted = {f"_{side}{q}": (on[side], q / 100) for side in "ab" for q in (16, 84)}
    if bounded:
        found = g.group_stats(_steps(sides, PAIR, True), PAIR, quantiles=wanted, aggs=_area(), bounded=True)
    else:
        found = wasserstein(sides, PAIR).join(g.group_stats(sides, PAIR, quantiles=wanted), PAIR)
    width = F.greatest(F.col("_a84") - F.col("_a16"), F.col("_b84") - F.col("_b16"), s.lit(1e-12))
    return (
        found.join(F.broadcast(ranges), "param")
        .filter(F.col("wasserstein").isNotNull())
        .select(
            *PAIR, "wasserstein",
            F.try_divide(F.col("wasserstein"), F.col("prior_range")).alias("prior_fraction"),
            (F.col("wasserstein") / width).alias("width_fraction"),
        )
    )


def jensen_shannon(sides: DataFrame, n_bins: int = 50, keys: Sequence[str] = PAIR) -> DataFrame:
    """Divergence of the two histograms on the shared range; 0 when the range has no width."""
    keys = list(keys)
    span = sides.groupBy(*keys).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"),
    )
    rows = sides.join(span, keys).withColumn("_bin", s.histogram_bin(F.col("value"), F.col("_lo"), F.col("_hi"), n_bins))
    counts = rows.groupBy(*keys, "_bin").agg(
        F.count_if(F.col("side") == "a").alias("_a"), F.count_if(F.col("side") == "b").alias("_b"),
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"),
    )
    p, q = F.col("_a") / F.col("n_a").cast("double"), F.col("_b") / F.col("n_b").cast("double")
    m = (p + q) / 2

    def part(x):
        return F.when(x > 0, x * F.ln(x / m)).otherwise(s.lit(0.0))

    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return counts.groupBy(*keys).agg(F.sum(F.when(both, s.lit(0.5) * (part(p) + part(q)))).alias("js"))


def agreement_summary(distances: DataFrame) -> DataFrame:
    """Medians per parameter over all compared objects."""
    return g.group_stats(
        distances, ["param"],
        quantiles={f"median_{k}": (F.col(k), 0.5) for k in ("wasserstein", "prior_fraction", "width_fraction")},
        aggs={"n": F.count(F.lit(1))},
    )


def conditioning_summary(runs: DataFrame) -> DataFrame:
    """Were exactly parameters 0 and 1 fixed in every run; median acceptance over the known ones.

    ``runs``: (object_id, fixed ARRAY<INT>, acceptance, ess).
    """
    fixed = F.array_sort(F.array_distinct("fixed")) == F.array(F.lit(0), F.lit(1))
    return g.group_stats(
        runs, [],
        quantiles={"acceptance_median": (s.finite_or_null(F.col("acceptance")), 0.5), "ess_median": (F.col("ess"), 0.5)},
        aggs={"ephemeris_fixed": F.coalesce(F.bool_and(fixed), F.lit(False)), "ess_min": F.min("ess"), "n": F.count(F.lit(1))},
    )


def stratified_agreement(distances: DataFrame, strata: DataFrame) -> DataFrame:
    rows = distances.join(strata, "object_id")
    return g.group_stats(
        rows, ["spec", "label", "param"],
        quantiles={f"median_{k}": (F.col(k), 0.5) for k in ("prior_fraction", "width_fraction")},
        aggs={"n": F.count(F.lit(1))},
    )
