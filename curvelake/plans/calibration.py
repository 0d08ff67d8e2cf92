"""Queries for posterior calibration, priors and the scalar functions they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.functions import priors as pr
from curvelake.functions import scalars as s
from curvelake.operators import calibration as c
from curvelake.operators import grouped as g
from curvelake.plans.registry import CATALOG, LINE_ORDER_SQL, query, r, rounded
from curvelake.sources import bindings as b

PARAMS = "l_quantity, l_extendedprice, l_discount, l_tax"
NUMBERED = f"o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER_SQL}) AS draw FROM lineitem)"
_EACH = " UNION ALL ".join(
    f"SELECT l_partkey AS object_id, '{p}' AS param, draw, CAST({p} AS DOUBLE) AS value, CAST(t_{p} AS DOUBLE) AS truth FROM firsts WHERE draw >= 2"
    for p in PARAMS.split(", ")
)
PAIRS = f"""{NUMBERED},
wide AS (SELECT l_partkey AS object_id, draw, {PARAMS} FROM o),
long AS (UNPIVOT wide ON {PARAMS} INTO NAME param VALUE value),
firsts AS (SELECT l_partkey, {PARAMS}, row_number() OVER w AS draw, {', '.join(f'first_value({p}) OVER w AS t_{p}' for p in PARAMS.split(', '))}
 FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY {LINE_ORDER_SQL})),
pairs AS ({_EACH})"""
RANKS = "ranks AS (SELECT object_id, param, count(*) FILTER (value < truth) AS rank, count(*) AS n_draws FROM pairs GROUP BY 1, 2)"


def dbl(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def prior_sql(ranges) -> str:
    rows = ", ".join(f"('{x.param}', {dbl(float(x.low))}, {dbl(float(x.high))}, {str(x.log).lower()})" for x in ranges)
    u = "CASE WHEN is_log THEN ln(greatest({0}, 1e-12)) ELSE {0} END"
    return f"""pr0(param, low, high, is_log) AS (VALUES {rows}),
pr1 AS (SELECT *, {u.format('low')} AS u_low, {u.format('high')} AS u_high FROM pr0),
prior AS (SELECT *, 5e-1 * (u_low + u_high) AS u_mean, (u_high - u_low) / sqrt(12e0) AS u_std FROM pr1)"""


PRIOR = prior_sql(b.LINE_RANGES)
U = "CASE WHEN is_log THEN ln(greatest(value, 1e-12)) ELSE value END"


@query("j03_truth_samples", f"WITH {PAIRS} SELECT object_id, param, draw, value, truth FROM pairs")
def truth_samples(spark, sf):
    lines = b.numbered_lines(spark, sf).select("object_id", "draw", *b.SAMPLE_PARAMS)
    long = b.long_samples(lines, ["object_id", "draw"])
    truth = long.filter("draw = 1").select("object_id", "param", F.col("value").alias("truth"))
    return c.pair_truth(long.filter("draw >= 2"), truth).select("object_id", "param", "draw", "value", "truth")


def ranks(spark, sf):
    return b.held_pairs(spark, sf, lambda pairs, _: c.sbc_ranks(pairs))


def summaries(spark, sf):
    return b.held_pairs(spark, sf, lambda pairs, short: c.posterior_summary(pairs, bounded=short))


def shares(spark, sf):
    return c.coverage_shares(b.held_pairs(spark, sf, lambda pairs, short: c.covered(pairs, bounded=short)))


@query("a21_sbc_ranks", f"WITH {PAIRS}, {RANKS} SELECT * FROM ranks")
def sbc_ranks(spark, sf):
    return ranks(spark, sf)


def chi2_sql(source: str = "ranks", by: str = "param", n: int = 20, scope: str = "") -> str:
    """Every bin of the grid, empty ones included."""
    top = f"(SELECT max(rank) FROM {source})" if not scope else f"(SELECT max(rank) FROM {source} x WHERE x.{scope} = k.{scope})"
    return f"""
ks AS (SELECT k.{by}, {top} AS top, count(*) AS n FROM {source} k GROUP BY k.{by}),
hb AS (SELECT s.{by}, CAST(floor((rank + 5e-1) * {n}e0 / (top + 1e0)) AS INTEGER) AS bin, count(*) AS c FROM {source} s JOIN ks ON s.{by} = ks.{by} GROUP BY 1, 2),
gr AS (SELECT ks.{by}, n, i, coalesce(c, 0) AS c FROM ks CROSS JOIN range({n}) g(i) LEFT JOIN hb ON hb.{by} = ks.{by} AND hb.bin = i),
chi AS (SELECT {by}, max(n) AS n, sum((c - n / {n}e0) * (c - n / {n}e0) / greatest(n / {n}e0, 1e-9)) AS chi2 FROM gr GROUP BY 1)"""


@query("a22_sbc_uniformity", f"WITH {PAIRS}, {RANKS}, {chi2_sql()} SELECT param, n, {r('chi2')} AS chi2 FROM chi")
def sbc_uniformity(spark, sf):
    return rounded(c.sbc_uniformity(g.pinned(ranks(spark, sf))), "chi2")


@query("f16_sbc_pvalues", f"""WITH {PAIRS}, {RANKS}, {chi2_sql()},
-- upper tail as 1 - integral of the density, Simpson's rule on 4000 panels; beyond 400 it is below 1e-70
up AS (SELECT param, n, chi2, least(chi2, 4e2) AS upto FROM chi),
xs AS (SELECT param, n, chi2, upto, upto * i / 4e3 AS x, CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM up, range(4001) g(i))
SELECT param, n, {r('chi2')} AS chi2, {r("1 - sum(c * pow(x, '8.5'::DOUBLE) * exp(-x / 2)) * any_value(upto) / 4e3 / 3 / (pow(2e0, '9.5'::DOUBLE) * gamma('9.5'::DOUBLE))", 5)} AS pvalue
FROM xs GROUP BY param, n, chi2""")
def sbc_pvalues(spark, sf):
    out = c.with_pvalue(c.sbc_uniformity(g.pinned(ranks(spark, sf))))
    return rounded(rounded(out, "chi2"), "pvalue", digits=5)


@query("a23_rank_histogram", f"""WITH {PAIRS}, {RANKS},
sh AS (SELECT param, rank / n_draws::DOUBLE AS x FROM ranks),
tt AS (SELECT param, count(*) AS n, avg(x) AS rank_mean FROM sh GROUP BY 1),
hb AS (SELECT param, CAST(CASE WHEN x = 1 THEN 9 ELSE floor(x * 1e1 / 1e0) END AS INTEGER) AS bin, count(*) AS c FROM sh GROUP BY 1, 2)
SELECT tt.param, CAST(i AS INTEGER) AS bin, n, {r('rank_mean')} AS rank_mean, coalesce(c, 0) AS count, round_even(coalesce(c, 0) / (n / 1e1), 3) AS density
FROM tt CROSS JOIN range(10) g(i) LEFT JOIN hb ON hb.param = tt.param AND hb.bin = i""")
def rank_histogram(spark, sf):
    return rounded(c.rank_histogram(g.pinned(ranks(spark, sf))), "rank_mean")


@query("a24_run_sbc", f"""WITH {PAIRS}, {PRIOR},
d1 AS (SELECT * FROM pairs WHERE object_id % 2 = 1),
z AS (SELECT object_id, param, ({U} - u_mean) / u_std AS zv, (CASE WHEN is_log THEN ln(greatest(truth, 1e-12)) ELSE truth END - u_mean) / u_std AS zt
      FROM d1 JOIN prior USING (param)),
ranks AS (SELECT object_id, param, count(*) FILTER (zv < zt) AS rank, count(*) AS n_draws FROM z GROUP BY 1, 2), {chi2_sql()}
SELECT param, n, {r('chi2')} AS chi2 FROM chi""")
def run_sbc(spark, sf):
    def standardised(pairs, _):
        rows = pr.with_prior(c.select_planets(pairs.withColumn("d", F.col("object_id") % 2)), b.LINE_RANGES)
        return c.sbc_ranks(rows.withColumns({"value": pr.physical_to_std(F.col("value")), "truth": pr.physical_to_std(F.col("truth"))}))

    return rounded(c.sbc_uniformity(g.pinned(b.held_pairs(spark, sf, standardised))), "chi2")


LEVELS_SQL = "lv(level) AS (SELECT round(i / 2e1, 2) FROM range(1, 20) g(i))"
PROBS = sorted({(1 + k * a) / 2 for a in c.LEVELS for k in (-1, 1)})
COVER = f"""{PAIRS},
qs AS (SELECT object_id, param, any_value(truth) AS truth, quantile_cont(value, [{', '.join(dbl(p) for p in PROBS)}]) AS q FROM pairs GROUP BY 1, 2),
lv(level, lo, hi) AS (VALUES {', '.join(f"({dbl(a)}, {PROBS.index((1 - a) / 2) + 1}, {PROBS.index((1 + a) / 2) + 1})" for a in c.LEVELS)}),
cov AS (SELECT level, param, avg(CASE WHEN truth BETWEEN round(q[lo], 9) AND round(q[hi], 9) THEN 1e0 ELSE 0e0 END) AS coverage, count(*) AS n FROM qs CROSS JOIN lv GROUP BY 1, 2),
ov AS (SELECT level, avg(coverage) AS coverage FROM cov GROUP BY 1)"""


@query("a25_interval_coverage", f"WITH {COVER} SELECT level, param, {r('coverage')} AS coverage, n FROM cov")
def interval_coverage(spark, sf):
    return rounded(shares(spark, sf), "coverage")


@query("a25_coverage_overall", f"WITH {COVER} SELECT level, {r('coverage')} AS coverage FROM ov")
def coverage_overall(spark, sf):
    return rounded(c.coverage_overall(shares(spark, sf)), "coverage")


@query("a26_calibration_error", f"WITH {COVER} SELECT {r('avg(abs(coverage - level))')} AS calibration_error FROM ov")
def calibration_error(spark, sf):
    return rounded(c.calibration_error(c.coverage_overall(shares(spark, sf))), "calibration_error")


@query("a27_contraction", f"""WITH {PAIRS}, pst AS (SELECT param, stddev_pop(value) AS s FROM long GROUP BY 1)
SELECT object_id, param, {r('1 - var_pop(value) / (any_value(s) * any_value(s))')} AS contraction FROM pairs JOIN pst USING (param) GROUP BY 1, 2""")
def contraction(spark, sf):
    everything = b.long_samples(b.line_samples(spark, sf).select("object_id", *b.SAMPLE_PARAMS), ["object_id"])
    prior = everything.groupBy("param").agg(F.stddev_pop("value").alias("prior_std"))
    return rounded(b.held_pairs(spark, sf, lambda pairs, _: c.contraction(pairs, prior)), "contraction")


@query("a31_negative_log_truth", f"""WITH {PAIRS},
m AS (SELECT object_id, param, any_value(truth) AS t, avg(value) AS m, var_pop(value) AS v FROM pairs GROUP BY 1, 2)
SELECT object_id, param, CASE WHEN v > 0 THEN {r('5e-1 * (ln(2 * pi() * CASE WHEN v > 0 THEN v ELSE 1 END) + (t - m) * (t - m) / CASE WHEN v > 0 THEN v ELSE 1 END)')} END AS nll FROM m""")
def negative_log_truth(spark, sf):
    return rounded(b.held_pairs(spark, sf, lambda pairs, _: c.negative_log_truth(pairs)), "nll")


SUMMARY = f"""{PAIRS},
ps AS (SELECT object_id, param, any_value(truth) AS published, stddev_pop(value) AS post_std,
       quantile_cont(value, [0.025::DOUBLE, 0.16::DOUBLE, 0.5::DOUBLE, 0.84::DOUBLE, 0.975::DOUBLE]) AS q FROM pairs GROUP BY 1, 2),
su AS (SELECT object_id, param, published, q[3] AS post_median, post_std, CASE WHEN post_std > 0 THEN (q[3] - published) / post_std END AS z,
       abs(q[3] - published) / nullif(abs(published), 0) AS frac_err, published BETWEEN round(q[2], 9) AND round(q[4], 9) AS in_68, published BETWEEN round(q[1], 9) AND round(q[5], 9) AS in_95 FROM ps)"""


@query("a32_posterior_summary", f"""WITH {SUMMARY}
SELECT object_id, param, published, {r('post_median')} AS post_median, {r('post_std')} AS post_std, {r('z')} AS z, {r('frac_err')} AS frac_err, in_68, in_95 FROM su""")
def posterior_summary(spark, sf):
    return rounded(summaries(spark, sf), "post_median", "post_std", "z", "frac_err")


PER_PARAM = f"""count(*) AS n, {r('median(frac_err)')} AS median_frac_err, {r('avg(in_68::INT)')} AS coverage_68,
 {r('avg(in_95::INT)')} AS coverage_95, {r('avg(abs(z))')} AS mean_abs_z"""
SUMMED = ("frac_err", "in_68", "in_95", "z")
PER_COLUMNS = ("median_frac_err", "coverage_68", "coverage_95", "mean_abs_z")


@query("a33_per_param_summary", f"WITH {SUMMARY} SELECT param, {PER_PARAM} FROM su GROUP BY 1")
def per_param_summary(spark, sf):
    return rounded(c.per_param_summary(g.pinned(summaries(spark, sf).select("param", *SUMMED))), *PER_COLUMNS)


@query("a33_detected_summary", f"""WITH {SUMMARY}
SELECT param, p_retailprice >= 1e3 AS detected, {PER_PARAM} FROM su JOIN part ON p_partkey = object_id GROUP BY 1, 2""")
def detected_summary(spark, sf):
    detected = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("object_id"), (F.col("p_retailprice") >= 1e3).alias("detected"))
    rows = summaries(spark, sf).join(detected, "object_id").select("param", "detected", *SUMMED)
    return rounded(c.per_param_summary(g.pinned(rows), ["param", "detected"]), *PER_COLUMNS)


def duration_sql(P="P", k="RpRs", a="aRs", bb="b") -> str:
    return (f"({P} / pi() * asin(greatest(0e0, least(1e0, sqrt(greatest((1e0 + {k}) * (1e0 + {k}) - {bb} * {bb}, 0e0)) / "
            f"({a} * sqrt(greatest(1e-8, least(1e0, 1e0 - ({bb} / {a}) * ({bb} / {a})))))))))")


def label_sql(x: str, name: str) -> str:
    (lo, hi), (l, m, h) = s.STRATA[name]
    return f"CASE WHEN {x} IS NULL OR NOT isfinite({x}) THEN 'unknown' WHEN {x} < {lo} THEN '{l}' WHEN {x} < {hi} THEN '{m}' ELSE '{h}' END"


OBJECTS = f"""{CATALOG},
ob0 AS (SELECT *, {duration_sql()} AS duration, floor(27e0 / greatest(P, 1e-9)) + 1 AS n_transits, '0.0005'::DOUBLE + (object_id % 29) / 5e2 AS sigma FROM cat),
ob1 AS (SELECT *, greatest(duration / '{27.0 / 18000!r}'::DOUBLE, 1e0) * n_transits AS n_in FROM ob0),
ob AS (SELECT *, RpRs * RpRs / greatest(sigma, 1e-12) * sqrt(n_in) AS snr FROM ob1)"""
STRATA_SQL = f"""{OBJECTS},
lb AS (SELECT object_id, {label_sql('b', 'impact')} AS impact, {label_sql('RpRs', 'rprs')} AS rprs, {label_sql('aRs', 'a_rs')} AS a_rs,
       {label_sql('snr', 'snr')} AS snr, {label_sql('n_transits', 'n_transits')} AS n_transits FROM ob),
strata AS (UNPIVOT lb ON impact, rprs, a_rs, snr, n_transits INTO NAME spec VALUE label)"""


@query("f13_stratum_labels", f"WITH {STRATA_SQL} SELECT object_id, spec, label FROM strata")
def stratum_labels(spark, sf):
    return b.part_strata(spark, sf)


@query("f14_expected_snr", f"""WITH {OBJECTS}
SELECT object_id, {r('duration')} AS duration, {r('n_in')} AS n_in, {r('snr')} AS snr, CAST(n_transits AS DOUBLE) AS n_transits FROM ob""")
def expected_snr(spark, sf):
    out = b.part_objects(spark, sf).select("object_id", "duration", "n_in", "snr", "n_transits")
    return rounded(out, "duration", "n_in", "snr")


@query("f04_transit_duration", f"WITH {CATALOG} SELECT object_id, {r(duration_sql())} AS duration FROM cat")
def transit_duration(spark, sf):
    out = b.catalog(spark, sf).withColumn("duration", s.transit_duration(F.col("P"), F.col("RpRs"), F.col("aRs"), F.col("b")))
    return rounded(out.select("object_id", "duration"), "duration")


@query("a35_stratified_characterization", f"""WITH {PAIRS}, {STRATA_SQL},
wd AS (SELECT object_id, param, any_value(truth) AS truth, quantile_cont(value, 0.16::DOUBLE) AS lo, quantile_cont(value, 0.84::DOUBLE) AS hi FROM pairs GROUP BY 1, 2)
SELECT spec, label, param, count(*) AS n, {r('avg(CASE WHEN truth BETWEEN round(lo, 9) AND round(hi, 9) THEN 1e0 ELSE 0e0 END)')} AS cov68, {r('median(hi - lo)')} AS median_width
FROM wd JOIN strata USING (object_id) GROUP BY 1, 2, 3""")
def stratified_characterization(spark, sf):
    widths = b.held_pairs(spark, sf, lambda pairs, short: c.interval_widths(pairs, bounded=short))
    return rounded(c.stratified_characterization(g.pinned(widths), b.part_strata(spark, sf)), "cov68", "median_width")


def regime_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0 AND {x} < 3 THEN 'under_3' WHEN {x} >= 3 AND {x} < 6 THEN '3_to_6' WHEN {x} >= 6 AND {x} < 15 THEN '6_to_15' WHEN {x} >= 15 THEN 'over_15' END"


@query("a37_period_strata", f"""WITH {PAIRS},
q AS (SELECT object_id, truth, count(*) FILTER (value < truth) AS rank, count(*) AS n_draws, median(value) AS med FROM pairs WHERE param = 'l_quantity' GROUP BY 1, 2),
ranks AS (SELECT *, {regime_sql('1e2 / truth')} AS regime, (med - truth) / truth AS rel FROM q), {chi2_sql(by='regime', scope='regime')}
SELECT regime, count(*) AS n, {r('avg(rank / n_draws::DOUBLE)')} AS rank_mean, {r('median(rel)')} AS median_rel_err,
 {r('avg(CASE WHEN abs(rel) < 0.05 THEN 1e0 ELSE 0e0 END)')} AS frac_within_5pct, {r('any_value(chi2)')} AS chi2
FROM ranks JOIN chi USING (regime) GROUP BY 1 HAVING count(*) >= 30""")
def period_strata(spark, sf):
    def ranked(pairs, short):
        pairs = c.slice_parameters(pairs, ["l_quantity"])
        summary = c.posterior_summary(pairs, bounded=short).select("object_id", F.col("published").alias("truth"), "post_median")
        return summary.join(c.sbc_ranks(pairs).drop("param"), "object_id")

    ranked = b.held_pairs(spark, sf, ranked).withColumn("n_transits", s.lit(100.0) / F.col("truth"))
    return rounded(c.period_strata(g.pinned(ranked)), "rank_mean", "median_rel_err", "frac_within_5pct", "chi2")


ALIAS = f"""{PAIRS},
am AS (SELECT object_id, param, truth, avg(CASE WHEN abs(value - truth) / truth < 0.05 THEN 1e0 ELSE 0e0 END) AS primary_mass,
       avg(CASE WHEN abs(value - truth / 2) / (truth / 2) < 0.05 THEN 1e0 ELSE 0e0 END) AS half_mass,
       avg(CASE WHEN abs(value - truth * 2) / (truth * 2) < 0.05 THEN 1e0 ELSE 0e0 END) AS double_mass FROM pairs WHERE param = 'l_quantity' GROUP BY 1, 2, 3)"""


@query("a38_alias_mass", f"""WITH {ALIAS}
SELECT object_id, param, {r('primary_mass')} AS primary_mass, {r('half_mass')} AS half_mass, {r('double_mass')} AS double_mass FROM am""")
def alias_mass(spark, sf):
    masses = b.held_pairs(spark, sf, lambda pairs, _: c.alias_mass(c.slice_parameters(pairs, ["l_quantity"])))
    return rounded(masses, "primary_mass", "half_mass", "double_mass")


@query("a38_alias_by_regime", f"""WITH {ALIAS}
SELECT {regime_sql('1e2 / truth')} AS regime, count(*) AS n, round_even(avg(primary_mass), 3) AS primary_mass, round_even(avg(half_mass), 3) AS half_mass,
 round_even(avg(double_mass), 3) AS double_mass FROM am GROUP BY 1 HAVING count(*) >= 30""")
def alias_by_regime(spark, sf):
    pairs = c.slice_parameters(b.hold_one_out(spark, sf), ["l_quantity"])
    n_tr = pairs.groupBy("object_id").agg((s.lit(100.0) / F.first("truth")).alias("n_transits"))
    return c.alias_by_regime(c.alias_mass(pairs), n_tr)


WEIGHTED = f"""{PAIRS},
lw AS (SELECT l_partkey AS object_id, draw, exp(-(l_discount - 5e-2) * (l_discount - 5e-2) / '{2 * 0.02 * 0.02!r}'::DOUBLE) AS e FROM o WHERE draw >= 2),
wt AS (SELECT object_id, draw, e / sum(e) OVER (PARTITION BY object_id) AS w FROM lw),
wr AS (SELECT p.object_id, p.param, sum(CASE WHEN value < truth THEN w ELSE 0 END) AS cdf, count(*) FILTER (value < truth) AS rank, count(*) AS n_draws
       FROM pairs p JOIN wt ON wt.object_id = p.object_id AND wt.draw = p.draw GROUP BY 1, 2)"""


def weighted_pairs(spark, sf, work):
    """``work`` on the hold-one-out pairs with a weight per draw."""
    from curvelake.operators import reweight as rw

    gap = F.col("l_discount") - s.lit(0.05)
    terms = {"loglik": -(gap * gap) / s.lit(2 * 0.02 * 0.02), "logprior": s.lit(0.0), "logq": s.lit(0.0)}

    def weighed(lines, short):
        weights = rw.importance_weights(lines.withColumns(terms), bounded=short)
        return work(c.long_pairs(weights, b.SAMPLE_PARAMS, "w"))

    return b.held_lines(spark, sf, weighed)


@query("a44_weighted_rank", f"WITH {WEIGHTED} SELECT object_id, param, {r('cdf')} AS cdf, rank, n_draws FROM wr")
def weighted_rank(spark, sf):
    return rounded(weighted_pairs(spark, sf, c.weighted_rank), "cdf")


@query("a45_corrected_sbc", f"""WITH {WEIGHTED},
{chi2_sql('wr').replace('chi AS', 'chi_a AS').replace('ks', 'ks_a').replace('hb', 'hb_a').replace('gr AS', 'gr_a AS').replace('FROM gr', 'FROM gr_a')},
mv AS (SELECT object_id, param, CAST(floor(round(cdf * 1e2, 9)) AS BIGINT) AS rank FROM wr), {chi2_sql('mv')}
SELECT a.param, a.n, {r('a.chi2')} AS chi2_flow, {r('c.chi2')} AS chi2_corrected FROM chi_a a JOIN chi c ON a.param = c.param""")
def corrected_sbc(spark, sf):
    return rounded(c.corrected_sbc(g.pinned(weighted_pairs(spark, sf, c.weighted_rank)), 100), "chi2_flow", "chi2_corrected")


@query("a46_slab_probability", f"""SELECT l_partkey AS object_id, {r('avg(CASE WHEN l_discount > 4.5e-2 THEN 1e0 ELSE 0e0 END)')} AS p_detect, count(*) AS n
FROM lineitem GROUP BY 1""")
def slab_probability(spark, sf):
    samples = b.line_samples(spark, sf).select("object_id", F.col("l_discount").alias("value"))
    return rounded(c.slab_probability(samples, 0.03, 0.015), "p_detect")


LONG = f"wide AS (SELECT l_orderkey, l_linenumber, l_partkey AS object_id, {PARAMS} FROM lineitem), long AS (UNPIVOT wide ON {PARAMS} INTO NAME param VALUE value)"


def long_with_prior(spark, sf):
    lines = b.line_samples(spark, sf).select("object_id", *b.SAMPLE_PARAMS)
    return pr.with_prior(b.long_samples(lines, ["object_id"]), b.LINE_RANGES)


@query("a56_prior_moments", f"""WITH {LONG}, {PRIOR}
SELECT param, {r(f'avg(({U} - u_mean) / u_std)')} AS mean, {r(f'stddev_pop(({U} - u_mean) / u_std)')} AS std, count(*) AS n FROM long JOIN prior USING (param) GROUP BY 1""")
def prior_moments(spark, sf):
    return rounded(c.prior_moments(long_with_prior(spark, sf).withColumn("z", pr.physical_to_std(F.col("value")))), "mean", "std")


@query("a56_log_correlation", f"SELECT {r('corr(ln(l_quantity), ln(l_extendedprice))')} AS correlation FROM lineitem")
def log_correlation(spark, sf):
    return rounded(b.table(spark, sf, "lineitem").agg(
        F.corr(F.ln("l_quantity"), F.ln("l_extendedprice")).alias("correlation")), "correlation")


@query("j10_prior_join", f"""WITH {LONG}, {PRIOR}
SELECT object_id, param, value, {r(U)} AS u, {r(f'({U} - u_mean) / u_std')} AS z,
 {r('CASE WHEN is_log THEN exp(greatest(u_low, least(u_high, ' + U + '))) ELSE greatest(u_low, least(u_high, ' + U + ')) END')} AS back,
 {U} BETWEEN u_low AND u_high AS inside FROM long JOIN prior USING (param)""")
def prior_join(spark, sf):
    rows = long_with_prior(spark, sf)
    rows = rows.withColumn("u", pr.physical_to_u(F.col("value"), F.col("is_log"))).withColumn("z", pr.physical_to_std(F.col("value")))
    rows = rows.withColumns({"back": pr.std_to_physical(F.col("z")), "inside": pr.in_support(F.col("value"))})
    return rounded(rows.select("object_id", "param", "value", "u", "z", "back", "inside"), "u", "z", "back")


@query("f08_prior_bounds", f"""WITH {LONG}, {PRIOR}
SELECT param, {r('any_value(u_mean)')} AS u_mean, {r('any_value(u_std)')} AS u_std, {r('any_value((u_low - u_mean) / u_std)')} AS z_low,
 {r('any_value((u_high - u_mean) / u_std)')} AS z_high, count(*) AS n FROM long JOIN prior USING (param) GROUP BY 1""")
def prior_bounds(spark, sf):
    rows = long_with_prior(spark, sf).groupBy("param", "u_mean", "u_std", "z_low", "z_high").agg(F.count("*").alias("n"))
    return rounded(rows, "u_mean", "u_std", "z_low", "z_high")


THETA = ", ".join(f"{expr} AS {p}" for p, expr in {
    "P": "P", "t0_phase": "(object_id % 10) / 1e1", "RpRs": "RpRs", "aRs": "aRs", "b": "b", "q1": "(object_id % 13) / 12e0", "q2": "(object_id % 17) / 16e0"}.items())
PHYS = f"""{CATALOG}, th AS (SELECT object_id, {THETA} FROM cat),
long AS (UNPIVOT th ON P, t0_phase, RpRs, aRs, b, q1, q2 INTO NAME param VALUE value), {prior_sql(pr.transit_ranges(50.0))}"""


def theta(spark, sf):
    i = F.col("object_id")
    wide = b.catalog(spark, sf).select(
        i, "P", (i % 10 / b.lit(10.0)).alias("t0_phase"), "RpRs", "aRs", "b",
        (i % 13 / b.lit(12.0)).alias("q1"), (i % 17 / b.lit(16.0)).alias("q2"))
    return wide.unpivot(["object_id"], ["P", "t0_phase", "RpRs", "aRs", "b", "q1", "q2"], "param", "value")


@query("f11_log_prior_physical", f"""WITH {PHYS}
SELECT object_id, bool_and({U} BETWEEN u_low AND u_high) AS inside,
 CASE WHEN bool_and({U} BETWEEN u_low AND u_high) THEN {r('sum(-ln(u_high - u_low) - CASE WHEN is_log THEN ln(greatest(value, 1e-300)) ELSE 0 END)')}
 ELSE '-inf'::DOUBLE END AS log_prior FROM long JOIN prior USING (param) GROUP BY 1""")
def log_prior_physical(spark, sf):
    out = pr.log_density_physical(theta(spark, sf), ["object_id"], pr.transit_ranges(50.0))
    return out.withColumn("log_prior", F.when(F.col("inside"), F.round("log_prior", 6)).otherwise(F.col("log_prior")))


@query("f11_log_prior_std", f"""WITH {PHYS}, z AS (SELECT *, ({U} - u_mean) / u_std AS z FROM long JOIN prior USING (param))
SELECT object_id, bool_and(z BETWEEN (u_low - u_mean) / u_std AND (u_high - u_mean) / u_std) AS inside,
 CASE WHEN bool_and(z BETWEEN (u_low - u_mean) / u_std AND (u_high - u_mean) / u_std) THEN {r('sum(-ln((u_high - u_mean) / u_std - (u_low - u_mean) / u_std))')}
 ELSE '-inf'::DOUBLE END AS log_prior_std FROM z GROUP BY 1""")
def log_prior_std(spark, sf):
    ranges = pr.transit_ranges(50.0)
    z = pr.with_prior(theta(spark, sf), ranges).withColumn("z", pr.physical_to_std(F.col("value"))).select("object_id", "param", "z")
    out = pr.log_density_std(z, ["object_id"], ranges)
    return out.withColumn("log_prior_std", F.when(F.col("inside"), F.round("log_prior_std", 6)).otherwise(F.col("log_prior_std")))


@query("p05_in_prior_support", f"""WITH {PHYS}
SELECT object_id, bool_and({U} BETWEEN u_low AND u_high) AS inside FROM long JOIN prior USING (param) GROUP BY 1""")
def in_prior_support(spark, sf):
    rows = pr.with_prior(theta(spark, sf), pr.transit_ranges(50.0))
    return rows.groupBy("object_id").agg(F.bool_and(pr.in_support(F.col("value"))).alias("inside"))


@query("p06_expand_conditioned", f"""WITH {PAIRS},
kn AS (SELECT p_partkey AS object_id, CAST(p_size AS DOUBLE) AS P, (p_partkey % 10) / 1e1 AS t0_phase FROM part),
kl AS (UNPIVOT kn ON P, t0_phase INTO NAME param VALUE value)
SELECT object_id, draw, param, value FROM long UNION ALL
SELECT l_partkey, draw, kl.param, kl.value FROM o JOIN kl ON kl.object_id = l_partkey""")
def expand_conditioned(spark, sf):
    samples = b.long_samples(b.numbered_lines(spark, sf).select("object_id", "draw", *b.SAMPLE_PARAMS), ["object_id", "draw"])
    return c.expand_conditioned(samples, theta(spark, sf), ["P", "t0_phase"])


@query("p07_slice_parameters", f"WITH {PAIRS} SELECT object_id, draw, param, value, truth FROM pairs WHERE param IN ('l_discount', 'l_tax')")
def slice_parameters(spark, sf):
    return c.slice_parameters(b.hold_one_out(spark, sf), ["l_discount", "l_tax"]).select("object_id", "draw", "param", "value", "truth")


@query("p02_select_planets", "SELECT vec_id AS object_id, label % 2 AS d, len(embedding) AS n FROM embeddings WHERE label % 2 = 1")
def select_planets(spark, sf):
    rows = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("object_id"), (F.col("label") % 2).alias("d"), F.size("embedding").cast("long").alias("n"))
    return c.select_planets(rows)


@query("f05_limb_darkening", f"""WITH {CATALOG}, q AS (SELECT object_id, (object_id % 13) / 12e0 AS q1, (object_id % 17) / 16e0 AS q2 FROM cat),
u AS (SELECT *, 2e0 * sqrt(q1) * q2 AS u1, sqrt(q1) * (1e0 - 2e0 * q2) AS u2 FROM q)
SELECT object_id, {r('u1')} AS u1, {r('u2')} AS u2, {r('greatest(0, least(1, (u1 + u2) * (u1 + u2)))')} AS back_q1,
 {r('CASE WHEN round(u1 + u2, 9) > 0 THEN greatest(0, least(1, u1 / (2 * (u1 + u2)))) ELSE 0 END')} AS back_q2 FROM u""")
def limb_darkening(spark, sf):
    i = F.col("object_id")
    rows = b.catalog(spark, sf).select(i, (i % 13 / b.lit(12.0)).alias("q1"), (i % 17 / b.lit(16.0)).alias("q2"))
    u1, u2 = s.kipping_to_quadratic(F.col("q1"), F.col("q2"))
    rows = rows.withColumns({"u1": u1, "u2": u2})
    q1, q2 = s.quadratic_to_kipping(F.col("u1"), F.col("u2"))
    return rounded(rows.select("object_id", "u1", "u2", q1.alias("back_q1"), q2.alias("back_q2")), "u1", "u2", "back_q1", "back_q2")


@query("f06_quadratic_to_kipping", f"""WITH u AS (SELECT p_partkey AS object_id, (p_partkey % 19) / 2e1 - 1e-1 AS u1, (p_partkey % 23) / 3e1 - 2e-1 AS u2 FROM part)
SELECT object_id, {r('greatest(0, least(1, (u1 + u2) * (u1 + u2)))')} AS q1,
 {r('CASE WHEN u1 + u2 > 0 THEN greatest(0, least(1, u1 / (2 * (u1 + u2)))) ELSE 0 END')} AS q2 FROM u""")
def quadratic_to_kipping(spark, sf):
    i = F.col("p_partkey")
    rows = b.table(spark, sf, "part").select(
        i.alias("object_id"), (i % 19 / b.lit(20.0) - b.lit(0.1)).alias("u1"), (i % 23 / b.lit(30.0) - b.lit(0.2)).alias("u2"))
    q1, q2 = s.quadratic_to_kipping(F.col("u1"), F.col("u2"))
    return rounded(rows.select("object_id", q1.alias("q1"), q2.alias("q2")), "q1", "q2")


def _sums_by_param(spark, sf, column, one, digits=6):
    """Sum of ``one(value, prior)`` for each part and parameter; the parameters of a part are added up side by side in one row."""
    sums = [F.struct(F.lit(x.param).alias("param"), F.round(F.sum(one(F.col(x.param), pr.constants(x))), digits).alias(column),
                     F.count(x.param).alias("n")) for x in b.LINE_RANGES]
    rows = b.line_samples(spark, sf).groupBy("object_id").agg(F.array(*sums).alias("_sums"))
    return rows.select("object_id", F.inline("_sums")).filter("n > 0")


@query("f07_physical_to_u", f"WITH {LONG}, {PRIOR} SELECT object_id, param, {r(f'sum({U})')} AS u, count(*) AS n FROM long JOIN prior USING (param) GROUP BY 1, 2")
def physical_to_u(spark, sf):
    return _sums_by_param(spark, sf, "u", lambda value, prior: pr.physical_to_u(value, prior["is_log"]))


@query("f09_physical_to_std", f"WITH {LONG}, {PRIOR} SELECT object_id, param, {r(f'sum(({U} - u_mean) / u_std)')} AS z, count(*) AS n FROM long JOIN prior USING (param) GROUP BY 1, 2")
def physical_to_std(spark, sf):
    return _sums_by_param(spark, sf, "z", pr.physical_to_std)


CLIPPED = "greatest(u_low, least(u_high, 3 * ((" + U + ") - u_mean) + u_mean))"


@query("f10_std_to_physical", f"""WITH {LONG}, {PRIOR}
SELECT object_id, param, {r(f'sum(CASE WHEN is_log THEN exp({CLIPPED}) ELSE {CLIPPED} END)', 4)} AS back, count(*) AS n FROM long JOIN prior USING (param) GROUP BY 1, 2""")
def std_to_physical(spark, sf):
    """Standardised values stretched threefold, so that clipping to the prior box takes effect."""
    def stretched(value, prior):
        return pr.std_to_physical(pr.physical_to_std(value, prior) * b.lit(3.0), prior=prior)

    return _sums_by_param(spark, sf, "back", stretched, digits=4)
