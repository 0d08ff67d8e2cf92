"""Queries for pass/fail gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.operators import gates as gt
from curvelake.plans.registry import query, r, rounded
from curvelake.sources import bindings as b
from curvelake.functions import scalars as s

PVALUES = "pv AS (SELECT l_suppkey AS run, l_linenumber AS param, abs(corr(l_discount, l_quantity)) AS p FROM lineitem GROUP BY 1, 2)"


def pvalues(spark, sf):
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("param")).agg(
        F.abs(F.corr("l_discount", "l_quantity")).alias("p"))


@query("a47_sbc_gate", f"""WITH {PVALUES}
SELECT run, count(p) AS n_tests, {r('min(p)')} AS min_pvalue, {r('5e-2 / greatest(count(p), 1)')} AS alpha_per_test,
 coalesce(min(p) > 5e-2 / greatest(count(p), 1), false) AS passes, coalesce(min(p) > '0.05'::DOUBLE, false) AS all_raw_above_005 FROM pv GROUP BY 1""")
def sbc_gate(spark, sf):
    return rounded(gt.sbc_gate(pvalues(spark, sf), by=["run"]), "min_pvalue", "alpha_per_test")


METRICS = """mt AS (SELECT l_suppkey AS run, round(avg(l_quantity) / 26e0, 6) AS roc_auc,
 CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 3 > 0 END AS sbc_passes,
 CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round(abs(avg(l_discount) - 5e-2) * 1e1, 6) END AS coverage_error,
 round(avg(CASE WHEN l_quantity > 4 THEN 1e0 ELSE 0e0 END), 6) AS detected_fraction,
 round(avg(l_tax) * 25e-1, 6) AS max_prior_fraction, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE round(avg(l_discount) * 1e1, 6) END AS max_width_fraction,
 l_suppkey % 2 = 0 AS correction_enabled, round(avg(l_tax) * 125e-2, 6) AS min_ess, count(*) FILTER (l_linenumber = 1) // 3 AS n_detected,
 count(*) FILTER (l_linenumber = 2) // 5 AS min_compared, round(sum(l_quantity) / 15e0, 6) AS speedup_x FROM lineitem GROUP BY l_suppkey)"""


def metrics(spark, sf):
    i = F.col("l_suppkey")
    out = b.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"), F.sum("l_quantity").alias("total"),
        F.avg((F.col("l_quantity") > 4).cast("double")).alias("big"), F.count_if(F.col("l_linenumber") == 1).alias("one"),
        F.count_if(F.col("l_linenumber") == 2).alias("two"))
    return out.select(
        i.alias("run"), F.round(F.col("q") / s.lit(26.0), 6).alias("roc_auc"), F.when(i % 5 != 0, i % 3 > 0).alias("sbc_passes"),
        F.when(i % 7 != 0, F.round(F.abs(F.col("d") - s.lit(0.05)) * s.lit(10.0), 6)).alias("coverage_error"),
        F.round("big", 6).alias("detected_fraction"), F.round(F.col("x") * s.lit(2.5), 6).alias("max_prior_fraction"),
        F.when(i % 11 != 0, F.round(F.col("d") * s.lit(10.0), 6)).alias("max_width_fraction"), (i % 2 == 0).alias("correction_enabled"),
        F.round(F.col("x") * s.lit(1.25), 6).alias("min_ess"), F.floor(F.col("one") / 3).alias("n_detected"),
        F.floor(F.col("two") / 5).alias("min_compared"), F.round(F.col("total") / s.lit(15.0), 6).alias("speedup_x"))


@query("a48_evaluation_gates", f"""WITH {METRICS}
SELECT run, coalesce(roc_auc >= '0.99'::DOUBLE, false) AS "detection_auc_ge_0.99", coalesce(sbc_passes, false) AS "sbc_familywise_alpha_0.05",
 coverage_error <= '0.03'::DOUBLE AS "coverage_error_le_0.03" FROM mt""")
def evaluation_gates(spark, sf):
    out = gt.evaluation_gates(metrics(spark, sf))
    return out.select("run", "`detection_auc_ge_0.99`", "`sbc_familywise_alpha_0.05`", "`coverage_error_le_0.03`")


@query("a49_real_gates", f"""WITH {METRICS}
SELECT run, detected_fraction >= '0.9'::DOUBLE AS "detected_fraction_ge_0.9", coalesce(max_prior_fraction <= '0.1'::DOUBLE, false) AS "prior_fraction_le_0.1",
 coalesce(max_width_fraction <= 5e-1, false) AS "width_fraction_le_0.5", CASE WHEN correction_enabled THEN min_ess >= '0.05'::DOUBLE END AS "min_ess_ge_0.05" FROM mt""")
def real_gates(spark, sf):
    out = gt.real_gates(metrics(spark, sf))
    return out.select("run", "`detected_fraction_ge_0.9`", "`prior_fraction_le_0.1`", "`width_fraction_le_0.5`", "`min_ess_ge_0.05`")


AGREE = """ag AS (SELECT l_suppkey AS run, ['RpRs', 'aRs', 'b', 'P'][l_linenumber % 4 + 1] AS param, round(avg(l_tax), 6) AS prior_fraction,
 round(avg(l_discount), 6) AS width_fraction, count(*) AS n, round(avg(CASE WHEN l_discount > 4.5e-2 THEN 1e0 ELSE 0e0 END), 6) AS coverage_68,
 round(avg(CASE WHEN l_tax > 1.5e-2 THEN 1e0 ELSE 0e0 END), 6) AS coverage_95 FROM lineitem GROUP BY 1, 2)"""


def agreement(spark, sf):
    names = F.array(*[F.lit(x) for x in ("RpRs", "aRs", "b", "P")])
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), names[F.col("l_linenumber") % 4].alias("param")).agg(
        F.round(F.avg("l_tax"), 6).alias("prior_fraction"), F.round(F.avg("l_discount"), 6).alias("width_fraction"), F.count("*").alias("n"),
        F.round(F.avg((F.col("l_discount") > 0.045).cast("double")), 6).alias("coverage_68"),
        F.round(F.avg((F.col("l_tax") > 0.015).cast("double")), 6).alias("coverage_95"))


@query("a49_agreement_extremes", f"""WITH {AGREE}
SELECT run, max(prior_fraction) AS max_prior_fraction, max(width_fraction) AS max_width_fraction, CASE WHEN count(DISTINCT param) = 3 THEN min(n) ELSE 0 END AS min_compared
FROM ag WHERE param <> 'P' GROUP BY 1""")
def agreement_extremes(spark, sf):
    return gt.agreement_extremes(agreement(spark, sf), ["run"])


@query("a50_agreement_gates", f"""WITH {AGREE},
holes AS (SELECT run, param, n, CASE WHEN run % 5 = 1 AND param = 'b' THEN NULL ELSE prior_fraction END AS prior_fraction, width_fraction
          FROM ag WHERE NOT (run % 4 = 2 AND param = 'aRs')),
w AS (SELECT run, count(DISTINCT param) = 3 AS whole, count(prior_fraction) = count(*) AS known, max(prior_fraction) AS p, max(width_fraction) AS x, min(n) AS n
      FROM holes WHERE param <> 'P' GROUP BY 1)
SELECT run, whole AND known AND p <= 4.5e-2 AS prior_ok, whole AND x <= 6e-2 AS width_ok, whole AND n >= 2 AS compared_ok FROM w""")
def agreement_gates(spark, sf):
    """Runs that lack a parameter, or one metric of it, fail; thresholds are given."""
    limits = gt.Limits(max_prior_fraction=0.045, max_width_fraction=0.06, min_compared=2)
    run = F.col("run")
    rows = agreement(spark, sf).filter(~((run % 4 == 2) & (F.col("param") == "aRs")))
    rows = rows.withColumn("prior_fraction", F.when(~((run % 5 == 1) & (F.col("param") == "b")), F.col("prior_fraction")))
    blank = F.lit(None).cast("double")
    worst = gt.worst_agreement(rows, ["run"]).withColumns({
        "auc_passes": F.lit(True), "sbc_passes": F.lit(True), "coverage_passes": F.lit(True), "n_detected": F.lit(30), "speedup_x": blank,
        "baseline_auc": blank, "learned_auc": blank})
    out = gt.gate_report(worst, limits)
    return out.select("run", F.col("real_prior_fraction").alias("prior_ok"), F.col("real_width_fraction").alias("width_ok"), F.col("real_compared").alias("compared_ok"))


@query("a49_diagnostics", f"""WITH {AGREE}
SELECT run, min(coverage_68) >= 5e-1 AS "cov68_ge_0.5", min(coverage_95) >= 8e-1 AS "cov95_ge_0.8" FROM ag WHERE param <> 'P' GROUP BY 1""")
def diagnostics(spark, sf):
    return gt.diagnostics(agreement(spark, sf), ["run"])


REPORT = f"""{METRICS},
rp AS (SELECT run, coalesce(roc_auc >= '0.99'::DOUBLE, false) AS synthetic_auc, coalesce(sbc_passes, false) AS synthetic_sbc,
 coalesce(coverage_error <= '0.03'::DOUBLE, false) AS synthetic_coverage, n_detected >= 27 AS real_detected, min_compared >= 16 AS real_compared,
 coalesce(max_prior_fraction <= '0.1'::DOUBLE, false) AS real_prior_fraction, coalesce(max_width_fraction <= 5e-1, false) AS real_width_fraction,
 speedup_x >= 1e3 AS speedup, coverage_error IS NOT NULL AS baseline_present FROM mt)"""


def report(spark, sf):
    rows = metrics(spark, sf).withColumns({
        "auc_passes": F.col("roc_auc") >= gt.DEFAULT.min_auc, "coverage_passes": F.col("coverage_error") <= gt.DEFAULT.max_coverage_error,
        "baseline_auc": F.col("coverage_error"), "learned_auc": F.col("roc_auc")})
    return gt.gate_report(rows).select("run", *gt.REPORT_GATES, "final_pass")


@query("a50_gate_report", f"WITH {REPORT} SELECT *, {' AND '.join(gt.REPORT_GATES)} AS final_pass FROM rp")
def gate_report(spark, sf):
    return report(spark, sf)


@query("a50_gate_rows", f"WITH {REPORT} SELECT gate, count(*) AS runs, count(*) FILTER (passed) AS passed FROM (UNPIVOT rp ON {', '.join(gt.REPORT_GATES)} INTO NAME gate VALUE passed) GROUP BY 1")
def gate_rows(spark, sf):
    rows = gt.gate_rows(report(spark, sf), ["run"], gt.REPORT_GATES)
    return rows.groupBy("gate").agg(F.count("*").alias("runs"), F.count_if("passed").alias("passed"))
