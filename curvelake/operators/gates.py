"""Pass/fail gates over metric rows. A missing metric fails unless it is declared not applicable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s

# The parameters that the characterisation gates look at.
CHARACTERISATION = ("RpRs", "aRs", "b")


@dataclass(frozen=True)
class Limits:
    """Gate thresholds; the defaults are fixed values."""

    min_auc: float = 0.99
    max_coverage_error: float = 0.03
    min_detected_fraction: float = 0.9
    max_prior_fraction: float = 0.1
    max_width_fraction: float = 0.5
    min_ess: float = 0.05
    min_coverage_68: float = 0.5
    min_coverage_95: float = 0.8
    min_real_detected: int = 27
    min_compared: int = 16
    min_speedup: float = 1000.0


DEFAULT = Limits()


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def sbc_gate(pvalues: DataFrame, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Family-wise uniformity gate: every p above alpha / number of tests. No tests fail."""
    found = pvalues.groupBy(*by).agg(F.count("p").alias("n_tests"), F.min("p").alias("min_pvalue"))
    threshold = s.lit(alpha) / F.greatest(F.col("n_tests"), F.lit(1))
    return found.select(
        *by, "n_tests", "min_pvalue", threshold.alias("alpha_per_test"),
        holds(F.col("min_pvalue") > threshold).alias("passes"),
        holds(F.col("min_pvalue") > 0.05).alias("all_raw_above_005"),
    )


def evaluation_gates(metrics: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``metrics``: roc_auc, sbc_passes, coverage_error. A NULL coverage error stays NULL: not applicable."""
    return metrics.withColumns({
        "detection_auc_ge_0.99": holds(F.col("roc_auc") >= limits.min_auc),
        "sbc_familywise_alpha_0.05": holds(F.col("sbc_passes")),
        "coverage_error_le_0.03": F.col("coverage_error") <= limits.max_coverage_error,
    })


def agreement_extremes(agreement: DataFrame, by: Sequence[str] = (), params: Sequence[str] = CHARACTERISATION) -> DataFrame:
    """Worst agreement over the gated parameters, and the fewest compared objects; 0 if one is absent."""
    kept = agreement.filter(F.col("param").isin(*params))
    fewest = F.when(F.count_distinct("param") == len(params), F.min("n")).otherwise(F.lit(0))
    return kept.groupBy(*by).agg(
        F.max("prior_fraction").alias("max_prior_fraction"),
        F.max("width_fraction").alias("max_width_fraction"),
        fewest.cast("long").alias("min_compared"),
    )


def worst_agreement(agreement: DataFrame, by: Sequence[str] = (), params: Sequence[str] = CHARACTERISATION) -> DataFrame:
    """As ``agreement_extremes``, for gates that every parameter has to pass: an absent parameter or one without
    the metric counts as infinitely bad, and as compared with no object."""
    kept = agreement.filter(F.col("param").isin(*params))
    whole = F.count_distinct("param") == len(params)

    def worst(metric: str) -> Column:
        return F.when(whole & (F.count(F.lit(1)) == F.count(metric)), F.max(metric)).otherwise(s.lit(float("inf")))

    fewest = F.when(whole, F.min(F.coalesce("n", F.lit(0)))).otherwise(F.lit(0))
    return kept.groupBy(*by).agg(
        worst("prior_fraction").alias("max_prior_fraction"), worst("width_fraction").alias("max_width_fraction"),
        fewest.cast("long").alias("min_compared"),
    )


def real_gates(metrics: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """``metrics``: detected_fraction, max_prior_fraction, max_width_fraction, correction_enabled, min_ess.

    The importance gate exists only where the correction ran; elsewhere it is NULL.
    """
    return metrics.withColumns({
        "detected_fraction_ge_0.9": holds(F.col("detected_fraction") >= limits.min_detected_fraction),
        "prior_fraction_le_0.1": holds(F.col("max_prior_fraction") <= limits.max_prior_fraction),
        "width_fraction_le_0.5": holds(F.col("max_width_fraction") <= limits.max_width_fraction),
        "min_ess_ge_0.05": F.when(F.col("correction_enabled"), holds(F.col("min_ess") >= limits.min_ess)),
    })


def diagnostics(
    coverage: DataFrame, by: Sequence[str] = (), params: Sequence[str] = CHARACTERISATION, limits: Limits = DEFAULT
) -> DataFrame:
    """``coverage``: (param, coverage_68, coverage_95) of the detected objects."""
    return coverage.filter(F.col("param").isin(*params)).groupBy(*by).agg(
        holds(F.min("coverage_68") >= limits.min_coverage_68).alias("cov68_ge_0.5"),
        holds(F.min("coverage_95") >= limits.min_coverage_95).alias("cov95_ge_0.8"),
    )


REPORT_GATES = (
    "synthetic_auc", "synthetic_sbc", "synthetic_coverage", "real_detected", "real_compared",
    "real_prior_fraction", "real_width_fraction", "speedup", "baseline_present",
)


def gate_report(metrics: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """The nine release gates and their conjunction, one row per metric row."""
    checks = {
        "synthetic_auc": F.col("auc_passes"),
        "synthetic_sbc": F.col("sbc_passes"),
        "synthetic_coverage": F.col("coverage_passes"),
        "real_detected": F.col("n_detected") >= limits.min_real_detected,
        "real_compared": F.col("min_compared") >= limits.min_compared,
        "real_prior_fraction": F.col("max_prior_fraction") <= limits.max_prior_fraction,
        "real_width_fraction": F.col("max_width_fraction") <= limits.max_width_fraction,
        "speedup": F.col("speedup_x") >= limits.min_speedup,
        "baseline_present": F.col("baseline_auc").isNotNull() & F.col("learned_auc").isNotNull(),
    }
    out = metrics.withColumns({name: holds(check) for name, check in checks.items()})
    every = F.lit(True)
    for name in REPORT_GATES:
        every = every & F.col(name)
    return out.withColumn("final_pass", every)


def gate_rows(report: DataFrame, ids: Sequence[str], gates: Sequence[str]) -> DataFrame:
    return report.unpivot(list(ids), list(gates), "gate", "passed")


def unknown_keys(found: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """Keys present in ``found`` and not in ``known``, once each."""
    return found.select(key).distinct().join(known.select(key), key, "left_anti")


def has_required(found: DataFrame, ids: Sequence[str], required: Sequence[str], key: str = "key") -> DataFrame:
    """Does each report carry every required key?"""
    present = F.count_distinct(F.when(F.col(key).isin(*required), F.col(key)))
    return found.groupBy(*ids).agg((present == len(set(required))).alias("complete"))
