"""Catalogue work: filters, quality gate, stratified pick, strata, ranks and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g


@dataclass(frozen=True)
class QualityLimits:
    min_cadences: int = 5000
    min_cadence_fraction: float = 0.70
    min_in_transit: int = 50
    min_transits: int = 2
    min_observed_snr: float = 12.0
    max_impact: float = 0.9
    enabled: bool = True


def passes_quality(limits: QualityLimits = QualityLimits()) -> Column:
    """All limits hold; a missing measure fails."""
    if not limits.enabled:
        return F.lit(True)
    checks = (
        F.col("finite_geometry")
        & (F.col("n_cadences") >= limits.min_cadences)
        & (F.col("cadence_fraction") >= limits.min_cadence_fraction)
        & (F.col("n_in_transit") >= limits.min_in_transit)
        & (F.col("n_transits") >= limits.min_transits)
        & (F.col("observed_snr") >= limits.min_observed_snr)
        & (F.col("impact") <= limits.max_impact)
    )
    return F.coalesce(checks, F.lit(False))


def read_catalog(
    catalog: DataFrame, *, period: tuple[float, float], ratio: tuple[float, float],
    facility: str | None = None, flag: str | None = None,
) -> DataFrame:
    """Objects strictly inside the period and radius-ratio ranges, with finite parameters, in order of the ratio.

    Plain comparisons on source columns, so a Parquet or JDBC scan receives them. ``dur_hours`` becomes ``duration``
    in days, unknown where it is not finite.
    """
    kept = catalog.filter(
        (F.col("P") > period[0]) & (F.col("P") < period[1])
        & (F.col("RpRs") > ratio[0]) & (F.col("RpRs") < ratio[1])
    )
    if facility:
        kept = kept.filter(F.col("facility").like(facility))
    if flag:
        kept = kept.filter(flag)
    for name in ("P", "RpRs", "t0"):
        if name in kept.columns:
            kept = kept.filter(s.is_finite(F.col(name)))
    if "dur_hours" in kept.columns:
        kept = kept.withColumn("duration", s.finite_or_null(F.col("dur_hours")) / s.lit(24.0)).drop("dur_hours")
    return kept.orderBy("RpRs", *[c for c in ("object_id",) if c in kept.columns])


def stratified_pick(catalog: DataFrame, n: int, *, by: str = "RpRs", tie: str = "object_id") -> DataFrame:
    """At most 6n objects evenly spread along ``by``: those at the rounded points of an even grid.

    A row is picked when some grid point rounds (half to even) to its position, so the test is
    arithmetic on the position and nothing is joined.
    """
    placed = g.positions(catalog, [], [F.col(by).asc(), F.col(tie).asc()])
    total = F.col("n_rows")
    pool = F.least(total, F.lit(6 * n))
    step = (total - 1) / F.greatest(pool - 1, F.lit(1)).cast("double")
    # Grid points next to this position; one of them must round onto it.
    nearest = F.floor(F.col("pos") / F.greatest(step, s.lit(1e-12)))
    hits = [
        (nearest + k >= 0) & (nearest + k < pool) & (F.rint((nearest + k) * step) == F.col("pos")) for k in (-1, 0, 1, 2)
    ]
    picked = hits[0] | hits[1] | hits[2] | hits[3]
    return placed.filter(F.when(total <= pool, F.lit(True)).otherwise(picked)).withColumnRenamed("pos", "rank").drop("n_rows")


def first_matching(df: DataFrame, condition: Column, order: list[Column], n: int) -> DataFrame:
    """First n rows, in order, that satisfy the condition: a top-k, not a full sort."""
    return df.filter(condition).orderBy(*order).limit(n)


def smallest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return g.positions(df, keys, order).filter(F.col("pos") < n).drop("n_rows")


def with_strata(objects: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add one label column per stratification named in ``STRATA``."""
    return objects.withColumns({name: s.stratum(value, *s.STRATA[name]) for name, value in columns.items()})


def unpivot_strata(labelled: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """One row per object and stratification: several groupings from one pass."""
    return labelled.unpivot(ids, names, "spec", "label")
