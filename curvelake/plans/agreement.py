"""Queries for sample-set agreement, model flux, likelihoods and importance weights."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import agreement as a
from curvelake.operators import grouped as g
from curvelake.operators import reduce as red
from curvelake.operators import reweight as rw
from curvelake.plans.calibration import NUMBERED, PARAMS, STRATA_SQL, dbl, label_sql
from curvelake.plans.registry import EPH, SPARSE, query, r, rounded
from curvelake.sources import bindings as b

SIDES = f"""wide AS (SELECT l_suppkey AS object_id, CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS side, {PARAMS} FROM lineitem),
sides AS (UNPIVOT wide ON {PARAMS} INTO NAME param VALUE value)"""
WASS = f"""{SIDES},
ct AS (SELECT object_id, param, value, count(*) FILTER (side = 'a') AS ka, count(*) FILTER (side = 'b') AS kb FROM sides GROUP BY 1, 2, 3),
cu AS (SELECT object_id, param, value, sum(ka) OVER w AS ca, sum(kb) OVER w AS cb, lead(value) OVER w AS nx,
       sum(ka) OVER (PARTITION BY object_id, param) AS na, sum(kb) OVER (PARTITION BY object_id, param) AS nb FROM ct
       WINDOW w AS (PARTITION BY object_id, param ORDER BY value ROWS UNBOUNDED PRECEDING)),
ws AS (SELECT object_id, param, sum(abs(ca / nullif(na, 0)::DOUBLE - cb / nullif(nb, 0)::DOUBLE) * coalesce(nx - value, 0)) AS wasserstein,
       max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b FROM cu GROUP BY 1, 2)"""


@query("j08_two_sides", f"WITH {SIDES} SELECT object_id, param, side, count(*) AS n, {r('sum(value)', 4)} AS total FROM sides GROUP BY ALL")
def two_sides(spark, sf):
    out = b.two_sides(spark, sf).groupBy("object_id", "param", "side").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total", digits=4)


@query("a28_wasserstein", f"WITH {WASS} SELECT object_id, param, {r('wasserstein')} AS wasserstein, n_a, n_b FROM ws")
def wasserstein(spark, sf):
    return rounded(b.each_supplier(spark, sf, lambda sides, short: a.wasserstein(sides, bounded=short)), "wasserstein")


NORMED = f"""{WASS},
rg AS (SELECT param, max(value) - min(value) AS prior_range FROM sides GROUP BY 1),
qw AS (SELECT object_id, param,
       quantile_cont(CASE WHEN side = 'a' THEN value END, 0.84::DOUBLE) - quantile_cont(CASE WHEN side = 'a' THEN value END, 0.16::DOUBLE) AS wa,
       quantile_cont(CASE WHEN side = 'b' THEN value END, 0.84::DOUBLE) - quantile_cont(CASE WHEN side = 'b' THEN value END, 0.16::DOUBLE) AS wb FROM sides GROUP BY 1, 2),
dist AS (SELECT object_id, param, wasserstein, wasserstein / nullif(prior_range, 0) AS prior_fraction, wasserstein / greatest(wa, wb, 1e-12) AS width_fraction
         FROM ws JOIN rg USING (param) JOIN qw USING (object_id, param) WHERE wasserstein IS NOT NULL)"""


def distances(spark, sf):
    sides = b.two_sides(spark, sf)
    ranges = sides.groupBy("param").agg((F.max("value") - F.min("value")).alias("prior_range"))
    return b.each_supplier(spark, sf, lambda sides, short: a.normalized_wasserstein(sides, ranges, bounded=short))


@query("a29_wasserstein_normalised", f"""WITH {NORMED}
SELECT object_id, param, {r('wasserstein')} AS wasserstein, {r('prior_fraction')} AS prior_fraction, {r('width_fraction')} AS width_fraction FROM dist""")
def wasserstein_normalised(spark, sf):
    return rounded(distances(spark, sf), "wasserstein", "prior_fraction", "width_fraction")


@query("a30_jensen_shannon", f"""WITH {SIDES},
sp AS (SELECT object_id, param, min(value) AS lo, max(value) AS hi, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM sides GROUP BY 1, 2),
hc AS (SELECT s.object_id, s.param, CASE WHEN hi = lo THEN 25 WHEN value = hi THEN 49 ELSE floor((value - lo) * 5e1 / (hi - lo)) END AS bin,
       count(*) FILTER (side = 'a') AS ka, count(*) FILTER (side = 'b') AS kb
       FROM sides s JOIN sp ON s.object_id = sp.object_id AND s.param = sp.param GROUP BY 1, 2, 3),
hb AS (SELECT hc.object_id, hc.param, ka / nullif(na, 0)::DOUBLE AS p, kb / nullif(nb, 0)::DOUBLE AS q FROM hc JOIN sp ON hc.object_id = sp.object_id AND hc.param = sp.param)
SELECT object_id, param, {r('sum(5e-1 * (CASE WHEN p > 0 THEN p * ln(CASE WHEN p > 0 THEN p / ((p + q) / 2) ELSE 1 END) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(CASE WHEN q > 0 THEN q / ((p + q) / 2) ELSE 1 END) ELSE 0 END))')} AS js
FROM hb GROUP BY 1, 2""")
def jensen_shannon(spark, sf):
    return rounded(a.jensen_shannon(b.two_sides(spark, sf)), "js")


@query("a34_agreement_summary", f"""WITH {NORMED}
SELECT param, {r('median(wasserstein)')} AS median_wasserstein, {r('median(prior_fraction)')} AS median_prior_fraction,
 {r('median(width_fraction)')} AS median_width_fraction, count(*) AS n FROM dist GROUP BY 1""")
def agreement_summary(spark, sf):
    out = a.agreement_summary(g.pinned(distances(spark, sf)))
    return rounded(out, "median_wasserstein", "median_prior_fraction", "median_width_fraction")


@query("a34_conditioning_summary", """WITH runs AS (SELECT l_suppkey, array_agg(DISTINCT l_linenumber % 2) AS fixed,
  avg(l_discount) FILTER (l_returnflag = 'R') AS acceptance, avg(l_tax) AS ess FROM lineitem GROUP BY 1)
SELECT bool_and(list_sort(fixed) = [0, 1]) AS ephemeris_fixed, """ + f"{r('median(acceptance)')} AS acceptance_median, {r('median(ess)')} AS ess_median, {r('min(ess)')} AS ess_min, count(*) AS n FROM runs")
def conditioning_summary(spark, sf):
    runs = b.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.collect_set(F.col("l_linenumber") % 2).alias("fixed"),
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("acceptance"), F.avg("l_tax").alias("ess"))
    return rounded(a.conditioning_summary(runs), "acceptance_median", "ess_median", "ess_min")


@query("a36_stratified_agreement", f"""WITH {NORMED}, {STRATA_SQL.replace('wide AS', 'wide2 AS')}
SELECT spec, label, param, count(*) AS n, {r('median(prior_fraction)')} AS median_prior_fraction, {r('median(width_fraction)')} AS median_width_fraction
FROM dist JOIN strata USING (object_id) GROUP BY 1, 2, 3""")
def stratified_agreement(spark, sf):
    out = a.stratified_agreement(g.pinned(distances(spark, sf)), b.part_strata(spark, sf))
    return rounded(out, "median_prior_fraction", "median_width_fraction")


@query("j02_records_with_results", f"""WITH {NORMED},
rec AS (SELECT s_suppkey AS object_id, s_acctbal AS score FROM supplier),
d AS (SELECT object_id, wasserstein FROM dist WHERE param = 'l_quantity')
SELECT rec.object_id, score, {r('wasserstein')} AS wasserstein FROM rec LEFT JOIN d ON d.object_id = rec.object_id AND score >= 5e3""")
def records_with_results(spark, sf):
    records = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("object_id"), F.col("s_acctbal").alias("score"))
    compared = records.filter("score >= 5000").select("object_id")
    results = b.each_supplier(spark, sf, lambda sides, short: a.wasserstein(sides.filter("param = 'l_quantity'"), bounded=short)).select("object_id", "wasserstein")
    return rounded(records.join(results.join(compared, "object_id"), "object_id", "left"), "wasserstein")


PARAM_SQL = """(SELECT object_id, P, t0, 1e-2 + (object_id % 15) / 1e2 AS k, 3e0 + object_id % 47 AS a, (object_id % 110) / 1e2 AS b, 4e-1 AS u1, 2e-1 AS u2 FROM eph)"""


def flux_sql(source: str, n: int, out: str = "mf", t: str = "t") -> str:
    return f"""
zz AS (SELECT s.*, p.k, p.u1, p.u2, cos({2 * math.pi!r}::DOUBLE * ({t} - p.t0) / p.P) AS co,
       p.a * sqrt(sin({2 * math.pi!r}::DOUBLE * ({t} - p.t0) / p.P) ** 2 + (p.b / p.a * cos({2 * math.pi!r}::DOUBLE * ({t} - p.t0) / p.P)) ** 2) AS z
       FROM {source} s JOIN {PARAM_SQL} p USING (object_id)),
rg2 AS (SELECT zz.*, (i + 5e-1) / {n}e0 AS rr FROM zz, range({n}) g(i)),
rh AS (SELECT *, (1 - u1 * (1 - sqrt(1 - rr * rr)) - u2 * (1 - sqrt(1 - rr * rr)) ** 2) * rr AS light, (rr * rr + z * z - k * k) / (2 * rr * z + 1e-12) AS c0 FROM rg2),
{out} AS (SELECT * EXCLUDE (k, u1, u2, co, z, rr, light, c0), CASE WHEN any_value(co) > 0 AND any_value(z) < 1 + any_value(k) THEN
       1 - sum(light * CASE WHEN z < 1e-12 THEN CASE WHEN rr <= k THEN 1e0 ELSE 0e0 END WHEN c0 <= -1 THEN 1e0 WHEN c0 >= 1 THEN 0e0 ELSE acos(greatest(-1e0, least(1e0, c0))) / pi() END) / sum(light)
       ELSE 1e0 END AS model FROM rh GROUP BY ALL)"""


def model_params():
    i = F.col("object_id")
    return {"P": F.col("P"), "t0": F.col("t0"), "RpRs": s.lit(0.01) + i % 15 / s.lit(100.0), "aRs": s.lit(3.0) + i % 47,
            "b": i % 110 / s.lit(100.0), "u1": s.lit(0.4), "u2": s.lit(0.2)}


def curves(spark, sf):
    cadence = b.sparse_cadence(spark, sf, "event_id")
    return red.join_ephemeris(cadence, b.sparse_ephemeris(cadence))


@query("f19_model_flux", f"""WITH {SPARSE}, {EPH}, src AS (SELECT object_id, event_id, t FROM cad), {flux_sql('src', 8)}
SELECT object_id, event_id, {r('model')} AS model FROM mf""")
def model_flux(spark, sf):
    rows = curves(spark, sf).withColumn("model", rw.transit_flux(F.col("t"), model_params(), 8))
    return rounded(rows.select("object_id", "event_id", "model"), "model")


@query("f20_exposure_flux", f"""WITH {SPARSE}, {EPH}, src AS (SELECT object_id, event_id, t + (-5e-1 + e / 2e0) * 2e-2 AS t FROM cad, range(3) h(e)), {flux_sql('src', 8)}
SELECT object_id, event_id, {r('sum(model) / 3')} AS model FROM mf GROUP BY 1, 2""")
def exposure_flux(spark, sf):
    rows = curves(spark, sf).withColumn("model", rw.exposure_flux(F.col("t"), model_params(), 8, 0.02, 3))
    return rounded(rows.select("object_id", "event_id", "model"), "model")


@query("f19_model_flux_200", f"""WITH {SPARSE}, {EPH}, src AS (SELECT object_id, event_id, t FROM cad), {flux_sql('src', 200)}
SELECT object_id, event_id, {r('model')} AS model FROM mf""")
def model_flux_200(spark, sf):
    rows = curves(spark, sf).withColumn("model", rw.transit_flux(F.col("t"), model_params(), 200))
    return rounded(rows.select("object_id", "event_id", "model"), "model")


@query("f20_exposure_flux_200", f"""WITH {SPARSE}, {EPH}, src AS (SELECT object_id, event_id, t + (-5e-1 + e / 2e0) * 2e-2 AS t FROM cad, range(3) h(e)), {flux_sql('src', 200)}
SELECT object_id, event_id, {r('sum(model) / 3')} AS model FROM mf GROUP BY 1, 2""")
def exposure_flux_200(spark, sf):
    rows = curves(spark, sf).withColumn("model", rw.exposure_flux(F.col("t"), model_params(), 200, 0.02, 3))
    return rounded(rows.select("object_id", "event_id", "model"), "model")


PREDICTED = """pd AS (SELECT l_suppkey AS object_id, l_linenumber AS draw, 1 - l_tax AS flux, 1 - l_discount AS model, 5e-2 + l_quantity / 1e3 AS sigma FROM lineitem)"""


def predicted(spark, sf):
    """A stored prediction table: draw = line number, one cadence per line."""
    return b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("object_id"), F.col("l_linenumber").alias("draw"),
        (s.lit(1.0) - F.col("l_tax")).alias("flux"), (s.lit(1.0) - F.col("l_discount")).alias("model"),
        (s.lit(0.05) + F.col("l_quantity") / s.lit(1e3)).alias("sigma"))


@query("a40_log_likelihood", f"""WITH {PREDICTED}
SELECT object_id, draw, {r('-5e-1 * sum(((flux - model) / sigma) * ((flux - model) / sigma))')} AS loglik, count(*) AS n FROM pd GROUP BY 1, 2""")
def log_likelihood(spark, sf):
    return rounded(rw.log_likelihood(predicted(spark, sf)), "loglik")


GRID = rw.dilution_grid(0.5, 0.5, 1.0, 9)


@query("a41_marginal_log_likelihood", f"""WITH {PREDICTED},
gd(d, w) AS (VALUES {', '.join(f'({dbl(d)}, {dbl(w)})' for d, w in GRID)}),
ll AS (SELECT object_id, draw, d, -5e-1 * sum((flux - (1 + (model - 1) * d)) * (flux - (1 + (model - 1) * d)) / (sigma * sigma)) + ln(any_value(w)) AS l
       FROM pd CROSS JOIN gd GROUP BY object_id, draw, d, w),
mx AS (SELECT object_id, draw, max(l) AS m FROM ll GROUP BY 1, 2)
SELECT object_id, draw, {r('max(m) + ln(sum(exp(l - m)))')} AS loglik FROM ll JOIN mx USING (object_id, draw) GROUP BY 1, 2""")
def marginal_log_likelihood(spark, sf):
    return rounded(rw.marginal_log_likelihood(predicted(spark, sf), GRID), "loglik")


@query("j07_dilution_grid", f"""WITH {PREDICTED}, gd(branch, d) AS (VALUES {', '.join(f'({i}, {dbl(d)})' for i, (d, _) in enumerate(GRID))})
SELECT object_id, draw, branch, d AS dilution, count(*) AS n, {r('sum(1 + (model - 1) * d)')} AS model_sum FROM pd CROSS JOIN gd GROUP BY 1, 2, 3, 4""")
def diluted_models(spark, sf):
    sums = predicted(spark, sf).groupBy("object_id", "draw").agg(F.avg("model").alias("m"), F.count("*").alias("n"))
    grid = F.posexplode(F.array(*[s.lit(d) for d, _ in GRID])).alias("branch", "dilution")
    out = sums.select("*", grid).withColumn("model_sum", s.dilute(F.col("m"), F.col("dilution")) * F.col("n"))
    return rounded(out.drop("m"), "model_sum")


LOGW = "-(l_discount - 5e-2) * (l_discount - 5e-2) / '0.0008'::DOUBLE + CASE WHEN l_tax >= '0.08'::DOUBLE THEN NULL ELSE 0 END + l_quantity / 1e2"
WEIGHTS = f"""{NUMBERED},
lw AS (SELECT l_partkey AS object_id, draw, {LOGW} AS logw FROM o),
mx AS (SELECT object_id, max(logw) AS m, count(*) AS n FROM lw GROUP BY 1),
ex AS (SELECT object_id, draw, logw, n, coalesce(exp(logw - m), 0) AS e FROM lw JOIN mx USING (object_id)),
wt AS (SELECT object_id, draw, CASE WHEN sum(e) OVER p > 0 THEN e / sum(e) OVER p ELSE 1e0 / n END AS w FROM ex WINDOW p AS (PARTITION BY object_id))"""


def weighted(spark, sf):
    gap = F.col("l_discount") - s.lit(0.05)
    draws = b.numbered_lines(spark, sf).select(
        "object_id", "draw", (-(gap * gap) / s.lit(0.0008)).alias("loglik"),
        F.when(F.col("l_tax") >= 0.08, s.lit(float("-inf"))).otherwise(s.lit(0.0)).alias("logprior"),
        (-F.col("l_quantity") / s.lit(100.0)).alias("logq"))
    return rw.importance_weights(draws)


@query("a42_importance_weights", f"WITH {WEIGHTS} SELECT object_id, draw, {r('w')} AS w FROM wt")
def importance_weights(spark, sf):
    return rounded(weighted(spark, sf).select("object_id", "draw", "w"), "w")


@query("a43_effective_fraction", f"""WITH {WEIGHTS}
SELECT object_id, {r('sum(w) * sum(w) / nullif(sum(w * w), 0) / count(*)')} AS ess_fraction, {r('sum(w)')} AS total FROM wt GROUP BY 1""")
def effective_fraction(spark, sf):
    return rounded(rw.effective_fraction(weighted(spark, sf)), "ess_fraction", "total")


@query("w09_resample", f"""WITH {WEIGHTS},
cs AS (SELECT object_id, draw, w, sum(w) OVER (PARTITION BY object_id ORDER BY draw ROWS UNBOUNDED PRECEDING) AS c FROM wt),
cp AS (SELECT object_id, draw, CAST(floor(round(1e2 * c, 9) + 5e-1) - floor(round(1e2 * (c - w), 9) + 5e-1) AS INTEGER) AS copies FROM cs)
SELECT object_id, draw, copies, CAST(i AS INTEGER) AS copy FROM cp, LATERAL (SELECT unnest(range(1, copies + 1)) AS i) WHERE copies > 0""")
def resample(spark, sf):
    out = rw.resample(weighted(spark, sf), 100, [F.col("draw")])
    return out.select("object_id", "draw", "copies", "copy")


@query("a42_posterior_correction", f"""WITH {SPARSE}, {EPH},
dr AS (SELECT object_id, d AS draw, 1e-2 + (object_id % 15) / 1e2 + d / 2e2 AS kd, CASE WHEN d = 5 THEN NULL ELSE -d / 2e1 END AS logprior, d / 1e1 AS logq
       FROM eph, range(6) g(d)),
src AS (SELECT object_id, event_id, draw, t, kd, 1 - flux / 1e4 AS flux FROM cad JOIN dr USING (object_id)), {flux_sql('src', 8).replace('p.k,', 's.kd AS k,')},
gd(d, w) AS (VALUES {', '.join(f'({dbl(d)}, {dbl(w)})' for d, w in GRID)}),
ll AS (SELECT object_id, draw, d, -5e-1 * sum((flux - (1 + (model - 1) * d)) * (flux - (1 + (model - 1) * d)) / 4e-4) + ln(any_value(w)) AS l
       FROM mf CROSS JOIN gd GROUP BY object_id, draw, d, w),
mx AS (SELECT object_id, draw, max(l) AS m FROM ll GROUP BY 1, 2),
lk AS (SELECT object_id, draw, max(m) + ln(sum(exp(l - m))) AS loglik FROM ll JOIN mx USING (object_id, draw) GROUP BY 1, 2),
lw AS (SELECT object_id, draw, kd, loglik, loglik + logprior - logq AS logw FROM dr JOIN lk USING (object_id, draw)),
tp AS (SELECT object_id, max(logw) AS m, count(*) AS n FROM lw GROUP BY 1),
ex AS (SELECT object_id, draw, kd, loglik, n, coalesce(exp(logw - m), 0) AS e FROM lw JOIN tp USING (object_id)),
wt AS (SELECT object_id, draw, kd, loglik, CASE WHEN sum(e) OVER p > 0 THEN e / sum(e) OVER p ELSE 1e0 / n END AS w FROM ex WINDOW p AS (PARTITION BY object_id)),
cs AS (SELECT *, sum(w) OVER (PARTITION BY object_id ORDER BY draw ROWS UNBOUNDED PRECEDING) AS c FROM wt)
SELECT object_id, draw, kd AS "RpRs", {r('loglik', 4)} AS loglik, {r('w', 4)} AS w,
 CAST(floor(round(1e2 * c, 6) + 5e-1) - floor(round(1e2 * (c - w), 6) + 5e-1) AS INTEGER) AS copies FROM cs""")
def posterior_correction(spark, sf):
    """Proposed radii of every object against its cadences: model, dilution, weights, resampling."""
    folded = curves(spark, sf).withColumns({"flux": s.lit(1.0) - F.col("flux") / s.lit(1e4), "sigma": s.lit(0.02)})
    d, i = F.col("draw"), F.col("object_id")
    objects = b.sparse_ephemeris(b.sparse_cadence(spark, sf)).select("object_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("draw"))
    draws = objects.select(
        "object_id", F.col("draw").cast("long").alias("draw"), (s.lit(0.01) + i % 15 / s.lit(100.0) + d / s.lit(200.0)).alias("RpRs"),
        F.when(d == 5, s.lit(float("-inf"))).otherwise(-d / s.lit(20.0)).alias("logprior"), (d / s.lit(10.0)).alias("logq"))
    params = model_params() | {"RpRs": F.col("RpRs")}
    out = rw.correct_posterior(folded.select("object_id", "t", "flux", "sigma", "P", "t0"), draws, params, n_radial=8, grid=GRID, n_out=100, digits=6)
    return rounded(rounded(out.select("object_id", "draw", "RpRs", "loglik", "w", "copies"), "loglik", digits=4), "w", digits=4)
