"""Queries for light-curve reduction and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import catalog as c
from curvelake.operators import grouped as g
from curvelake.operators import reduce as red
from curvelake.plans.registry import (
    DENSE, EPH, EPH_DENSE, SPARSE, phase, phase_days, query, r, rounded,
)
from curvelake.sources import bindings as b

FOLDED = f"""{SPARSE}, {EPH},
fold AS (SELECT c.*, P, t0, duration, {phase()} AS phase, {phase()} * P AS t_phase
         FROM cad c JOIN eph USING (object_id))"""


def sparse(spark, sf):
    cadence = b.sparse_cadence(spark, sf)
    return cadence, b.sparse_ephemeris(cadence)


@query("s01_clean_light_curve", f"""WITH {SPARSE},
m AS (SELECT object_id, median(flux) AS med, count(*) AS n, min(t) AS t_first FROM cad GROUP BY 1)
SELECT object_id, {r('t')} AS t, {r('flux / med')} AS flux FROM cad JOIN m USING (object_id)
WHERE n >= 60 AND t <= t_first + 2e1""")
def clean_light_curve(spark, sf):
    out = red.clean_light_curve(b.sparse_cadence(spark, sf), 20.0, 60)
    return rounded(out, "t", "flux")


SEGMENTS = f"""{DENSE},
m AS (SELECT object_id, median(flux) AS med FROM cad GROUP BY 1),
n AS (SELECT c.object_id, t, flux / med AS flux FROM cad c JOIN m USING (object_id) WHERE abs(med) >= 1e-1),
k AS (SELECT object_id, median(flux) AS m, stddev_pop(flux) AS s, count(*) AS n FROM n GROUP BY 1),
o AS (SELECT n.object_id, row_number() OVER (PARTITION BY n.object_id ORDER BY t, flux) - 1 AS pos, m, s, n AS cnt,
      greatest(m - 5 * s, least(flux, m + 5 * s)) AS flux FROM n JOIN k ON n.object_id = k.object_id),
seg AS (SELECT object_id, pos // 100 AS segment, CAST(pos % 100 AS INTEGER) AS i, flux FROM o
        WHERE pos // 100 < cnt // 100)"""


@query("s03_noise_segments", f"WITH {SEGMENTS} SELECT object_id, segment, i, {r('flux')} AS flux FROM seg")
def noise_segments(spark, sf):
    return rounded(red.noise_segments(b.dense_cadence(spark, sf), 100), "flux")


@query("s04_noise_library_stats", f"""WITH {SEGMENTS}
SELECT (SELECT count(*) FROM (SELECT DISTINCT object_id, segment FROM seg)) AS n_segments,
       100::BIGINT AS segment_length, {r('median(flux)')} AS median, {r('stddev_pop(flux)')} AS std,
       count(*) > 0 AS available FROM seg""")
def noise_library_stats(spark, sf):
    out = red.segment_stats(red.noise_segments(b.dense_cadence(spark, sf), 100))
    return rounded(out, "median", "std")


@query("p01_drop_nonfinite", """
SELECT user_id AS object_id, count(*) AS n, """ + r("sum(f)") + """ AS total FROM (
  SELECT user_id, CASE WHEN value > 200 THEN 'nan'::DOUBLE WHEN event_type = 'error' THEN 'inf'::DOUBLE
                  ELSE value END AS f FROM events) WHERE isfinite(f) GROUP BY 1""")
def drop_nonfinite(spark, sf):
    cadence = b.sparse_cadence(spark, sf, "event_type")
    broken = F.when(F.col("flux") > 200, s.lit("nan")).when(F.col("event_type") == "error", s.lit("inf"))
    rows = red.drop_nonfinite(cadence.withColumn("flux", broken.otherwise(F.col("flux"))))
    out = rows.groupBy("object_id").agg(F.count("*").alias("n"), F.sum("flux").alias("total"))
    return rounded(out, "total")


@query("p03_stride_subsample", f"""WITH {SPARSE},
o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t, flux) - 1 AS pos,
      count(*) OVER (PARTITION BY object_id) AS n FROM cad)
SELECT object_id, pos, {r('t')} AS t, flux FROM o
WHERE n <= 20 OR (pos % greatest(1, n // 20) = 0 AND pos // greatest(1, n // 20) < 20)""")
def stride_subsample(spark, sf):
    return rounded(red.stride_subsample(b.sparse_cadence(spark, sf), 20), "t")


@query("p03_stride_uncapped", f"""WITH {SPARSE},
o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t, flux) - 1 AS pos,
      count(*) OVER (PARTITION BY object_id) AS n FROM cad)
SELECT object_id, pos, {r('t')} AS t, flux FROM o WHERE n <= 20 OR pos % greatest(1, n // 20) = 0""")
def stride_uncapped(spark, sf):
    return rounded(red.stride_subsample(b.sparse_cadence(spark, sf), 20, cap=False), "t")


@query("j01_fold_join", f"""WITH {FOLDED}
SELECT object_id, {r('t')} AS t, flux, {r('phase')} AS phase, {r('t_phase')} AS t_phase FROM fold""")
def fold_join(spark, sf):
    cadence, eph = sparse(spark, sf)
    out = red.fold(red.join_ephemeris(cadence, eph))
    return rounded(out.select("object_id", "t", "flux", "phase", "t_phase"), "t", "phase", "t_phase")


BINNED = f"""{FOLDED},
bins AS (SELECT object_id, CAST(floor((phase + 5e-1) * 2e1 / 1e0) AS INTEGER) AS bin, avg(flux) AS value, count(*) AS n
         FROM fold WHERE floor((phase + 5e-1) * 2e1 / 1e0) BETWEEN 0 AND 19 GROUP BY 1, 2)"""


def phase_bins(spark, sf, n=20):
    rows = red.fold(red.join_ephemeris(*sparse(spark, sf)))
    return red.bin_mean(rows, ["object_id"], F.col("phase"), F.col("flux"), s.lit(-0.5), s.lit(0.5), n)


@query("a01_bin_mean", f"WITH {BINNED} SELECT object_id, bin, {r('value')} AS value, n FROM bins")
def bin_mean(spark, sf):
    return rounded(phase_bins(spark, sf), "value")


def _filled(n: int, source: str = "bins", fill: str = "fill") -> str:
    """Complete ``source`` over bins 0..n-1 of every row of ``obj``."""
    return f"""
grid AS (SELECT o.object_id, o.{fill} AS fill, CAST(g.i AS INTEGER) AS bin FROM obj o, range({n}) g(i)),
j AS (SELECT grid.object_id, fill, grid.bin, value, CASE WHEN value IS NOT NULL THEN grid.bin END AS at_bin
      FROM grid LEFT JOIN {source} s ON s.object_id = grid.object_id AND s.bin = grid.bin),
nb AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, last_value(at_bin IGNORE NULLS) OVER p AS pa,
       first_value(value IGNORE NULLS) OVER f AS nv, first_value(at_bin IGNORE NULLS) OVER f AS na FROM j
       WINDOW p AS (PARTITION BY object_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              f AS (PARTITION BY object_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
view AS (SELECT object_id, bin, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL AND nv IS NULL THEN fill
         WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) / (na - pa) * (bin - pa) END AS value FROM nb)"""


@query("w03_interpolate_bins", f"""WITH {BINNED},
obj AS (SELECT object_id, median(flux) AS fill FROM cad GROUP BY 1), {_filled(20)}
SELECT object_id, bin, {r('value')} AS value FROM view""")
def interpolate_bins(spark, sf):
    objects = g.group_stats(b.sparse_cadence(spark, sf), ["object_id"], quantiles={"fill": (F.col("flux"), 0.5)})
    return rounded(red.fill_bins(phase_bins(spark, sf), objects, 20, "fill"), "value")


def global_sql(n: int) -> str:
    return f"""{SPARSE},
obj AS (SELECT object_id, median(flux) AS fill, min(t) AS lo, max(t) AS hi FROM cad GROUP BY 1),
bins AS (SELECT object_id, CAST(floor((t - lo) * {n}e0 / (hi - lo)) AS INTEGER) AS bin, avg(flux) AS value
         FROM cad JOIN obj USING (object_id)
         WHERE hi > lo AND floor((t - lo) * {n}e0 / (hi - lo)) BETWEEN 0 AND {n - 1} GROUP BY 1, 2), {_filled(n)}"""


@query("a02_global_view", f"WITH {global_sql(100)} SELECT object_id, bin, {r('value')} AS value FROM view")
def global_view(spark, sf):
    return rounded(red.global_view(b.sparse_cadence(spark, sf), 100), "value")


def local_sql(n: int) -> str:
    return f"""{FOLDED},
near AS (SELECT *, least(2e0 * greatest(duration, 1e-6), 5e-1 * P) AS half FROM fold),
obj AS (SELECT object_id, median(flux) AS fill, count(*) FILTER (abs(t_phase) <= half) AS k FROM near GROUP BY 1),
bins AS (SELECT object_id, CAST(floor((t_phase + half) * {n}e0 / (half + half)) AS INTEGER) AS bin, avg(flux) AS value
         FROM near JOIN obj USING (object_id) WHERE k >= 2 AND abs(t_phase) <= half
         AND floor((t_phase + half) * {n}e0 / (half + half)) BETWEEN 0 AND {n - 1} GROUP BY 1, 2), {_filled(n)}"""


@query("a03_local_view", f"WITH {local_sql(21)} SELECT object_id, bin, {r('value')} AS value FROM view")
def local_view(spark, sf):
    return rounded(red.local_view(*sparse(spark, sf), 21), "value")


# Interpolated values of two decimals often end in a five just beyond the rounding; this moves both sides off it.
OFF_TIES = 1e-9


@query("a02_global_view_2001", f"WITH {global_sql(2001)} SELECT object_id, bin, {r('value + 1e-9')} AS value FROM view")
def global_view_2001(spark, sf):
    return rounded(red.global_view(b.sparse_cadence(spark, sf), 2001).withColumn("value", F.col("value") + OFF_TIES), "value")


@query("a03_local_view_201", f"WITH {local_sql(201)} SELECT object_id, bin, {r('value + 1e-9')} AS value FROM view")
def local_view_201(spark, sf):
    return rounded(red.local_view(*sparse(spark, sf), 201).withColumn("value", F.col("value") + OFF_TIES), "value")


def normalized_sql(source: str, value: str = "value", key: str = "object_id", keep: str = "bin") -> str:
    return f"""
nm AS (SELECT {key}, median({value}) AS med, stddev_pop({value}) AS sd FROM {source} GROUP BY 1),
na2 AS (SELECT s.{key}, median(abs(s.{value} - med)) * 1.4826::DOUBLE AS mad FROM {source} s JOIN nm USING ({key}) GROUP BY 1),
normed AS (SELECT s.{key}, s.{keep}, greatest(-3e1, least(3e1, (s.{value} - med) /
           CASE WHEN mad >= 1e-8 THEN mad WHEN sd >= 1e-8 THEN sd ELSE 1e0 END)) AS {value}
           FROM {source} s JOIN nm USING ({key}) JOIN na2 USING ({key}))"""


VIEW_BINS = ("vb AS (SELECT vec_id AS object_id, label, CAST(i - 1 AS INTEGER) AS bin, CAST(embedding[i] AS DOUBLE) AS value "
             "FROM embeddings, range(1, 65) g(i))")


@query("a04_normalize_view", f"""WITH {VIEW_BINS}, {normalized_sql('vb')}
SELECT object_id, bin, {r('value')} AS value FROM normed""")
def normalize_view(spark, sf):
    out = red.normalize_view(b.view_bins(spark, sf)).select("object_id", "bin", "value")
    return rounded(out, "value")


@query("a04_normalized_local_view", f"""WITH {local_sql(21)}, {normalized_sql('view')}
SELECT object_id, bin, {r('value')} AS value FROM normed""")
def normalized_local_view(spark, sf):
    out = red.normalize_view(red.local_view(*sparse(spark, sf), 21)).select("object_id", "bin", "value")
    return rounded(out, "value")


@query("a04_normalized_local_view_201", f"""WITH {local_sql(201)}, {normalized_sql('view')}
SELECT object_id, bin, {r('value')} AS value FROM normed""")
def normalized_local_view_201(spark, sf):
    out = red.normalize_view(red.local_view(*sparse(spark, sf), 201)).select("object_id", "bin", "value")
    return rounded(out, "value")


@query("w08_deepest_bin", f"""WITH {BINNED}, {normalized_sql('bins')}
SELECT object_id, arg_min(bin, {{'v': {r('value')}, 'b': bin}}) AS bin, min({r('value')}) AS value FROM normed GROUP BY 1""")
def deepest_bin(spark, sf):
    view = red.normalize_view(phase_bins(spark, sf)).withColumn("value", F.round("value", 6))
    return red.deepest_bin(view.select("object_id", "bin", "value"))


@query("a57_edge_scatter", f"""WITH {VIEW_BINS}
SELECT object_id, {r('greatest(stddev_pop(value), 1e-3)')} AS scatter FROM vb WHERE bin < 12 OR bin >= 52 GROUP BY 1""")
def edge_scatter(spark, sf):
    return rounded(red.edge_scatter(b.view_bins(spark, sf), 64), "scatter")


@query("w01_differences", f"""WITH {SPARSE}
SELECT object_id, {r('t')} AS t, {r('flux - lag(flux) OVER w')} AS d_flux, {r('t - lag(t) OVER w')} AS d_t
FROM cad WINDOW w AS (PARTITION BY object_id ORDER BY t, flux)""")
def differences(spark, sf):
    out = red.differences(b.sparse_cadence(spark, sf)).select("object_id", "t", "d_flux", "d_t")
    return rounded(out, "t", "d_flux", "d_t")


@query("w01_median_cadence", f"""WITH {SPARSE},
d AS (SELECT object_id, t - lag(t) OVER (PARTITION BY object_id ORDER BY t, flux) AS d FROM cad)
SELECT object_id, {r('median(d)')} AS dt, count(*) AS n FROM d GROUP BY 1""")
def median_cadence(spark, sf):
    return rounded(red.median_cadence(b.sparse_cadence(spark, sf)), "dt")


STEPS = f"""{SPARSE},
d0 AS (SELECT object_id, flux - lag(flux) OVER (PARTITION BY object_id ORDER BY t, flux) AS d FROM cad),
d AS (SELECT * FROM d0 WHERE d IS NOT NULL),
m AS (SELECT object_id, median(d) AS m FROM d GROUP BY 1)"""


@query("a11_white_sigma", f"""WITH {STEPS}
SELECT object_id, {r('1.4826::DOUBLE * median(abs(d - m)) / sqrt(2e0)')} AS sigma FROM d JOIN m USING (object_id) GROUP BY 1""")
def white_sigma(spark, sf):
    return rounded(red.white_sigma(b.sparse_cadence(spark, sf)), "sigma")


SIGMA_RAW = "1.4826::DOUBLE * median(abs(d)) / sqrt(2e0) + 1e-6"


@query("a11_white_sigma_uncentred", f"""WITH {STEPS}
SELECT object_id, {r(SIGMA_RAW)} AS sigma FROM d GROUP BY 1""")
def white_sigma_uncentred(spark, sf):
    return rounded(red.white_sigma(b.sparse_cadence(spark, sf), centred=False), "sigma")


def fold_sql(k: int) -> str:
    return f"""WITH {FOLDED},
f AS (SELECT object_id, t, flux, {phase_days()} + t0 AS folded, 1e-1 AS sigma FROM fold),
o AS (SELECT *, count(*) OVER (PARTITION BY object_id) AS n, ntile({k}) OVER (PARTITION BY object_id ORDER BY folded, flux) - 1 AS tile,
      row_number() OVER (PARTITION BY object_id ORDER BY folded, flux) - 1 AS pos FROM f)
SELECT object_id, CASE WHEN n <= {k} THEN pos ELSE tile END AS grp, {r(f'avg(CASE WHEN n <= {k} THEN t ELSE folded END)')} AS t,
       {r('avg(flux)')} AS flux, {r('any_value(sigma) / sqrt(count(*))')} AS err, count(*) AS n FROM o GROUP BY object_id, 2"""


def folded_bins(spark, sf, k: int):
    rows = red.join_ephemeris(*sparse(spark, sf)).withColumn("t0_phase", F.col("t0") / F.col("P"))
    return rounded(red.fold_bin(rows.withColumn("sigma", s.lit(0.1)), k), "t", "flux", "err")


@query("a10_fold_bin_900", fold_sql(900))
def fold_bin_900(spark, sf):
    return folded_bins(spark, sf, 900)


@query("a10_fold_bin", fold_sql(60))
def fold_bin(spark, sf):
    return folded_bins(spark, sf, 60)


@query("w05_phase_order", f"""WITH {FOLDED}
SELECT object_id, {r('t')} AS t, flux, row_number() OVER (PARTITION BY object_id ORDER BY {r('phase', 9)}, flux, t) - 1 AS pos,
       count(*) OVER (PARTITION BY object_id) AS n_rows FROM fold""")
def phase_order(spark, sf):
    rows = red.fold(red.join_ephemeris(*sparse(spark, sf))).withColumn("ph", F.round("phase", 9))
    placed = g.positions(rows, ["object_id"], [F.col("ph"), F.col("flux"), F.col("t")])
    return rounded(placed.select("object_id", "t", "flux", "pos", "n_rows"), "t")


@query("w06_equal_count_groups", f"""WITH {SPARSE},
o AS (SELECT *, ntile(7) OVER (PARTITION BY object_id ORDER BY t, flux) - 1 AS grp FROM cad)
SELECT object_id, grp, count(*) AS n, {r('avg(t)')} AS t, {r('avg(flux)')} AS flux FROM o GROUP BY 1, 2""")
def equal_count_groups(spark, sf):
    placed = g.positions(b.sparse_cadence(spark, sf), ["object_id"], red.by_time())
    out = placed.withColumn("grp", red.equal_count_group(7)).groupBy("object_id", "grp").agg(
        F.count("*").alias("n"), F.avg("t").alias("t"), F.avg("flux").alias("flux"))
    return rounded(out, "t", "flux")


QUALITY = f"""{FOLDED},
d0 AS (SELECT object_id, flux - lag(flux) OVER (PARTITION BY object_id ORDER BY t, flux) AS d FROM cad),
sg AS (SELECT object_id, {SIGMA_RAW} AS sigma FROM d0 WHERE d IS NOT NULL GROUP BY 1),
ob AS (SELECT e.*, sigma, 1e-2 + (object_id % 15) / 1e2 AS RpRs,
       CASE WHEN object_id % 11 <> 0 THEN 3e0 + object_id % 47 END AS aRs, (object_id % 110) / 1e2 AS b
       FROM eph e JOIN sg USING (object_id)),
ph AS (SELECT c.object_id, c.t, c.flux, ob.duration, abs({phase_days('c.t', 'ob.t0', 'ob.P')}) AS away
       FROM cad c JOIN ob USING (object_id)),
st AS (SELECT object_id, count(*) AS n, count(*) FILTER (away < 5e-1 * duration) AS n_in, max(t) - min(t) AS span,
       median(CASE WHEN away < 5e-1 * duration THEN flux END) AS f_in,
       median(CASE WHEN away > 15e-1 * duration THEN flux END) AS f_out FROM ph GROUP BY 1),
q AS (SELECT object_id, n AS n_cadences, n / 8e1 AS cadence_fraction, n_in AS n_in_transit,
      CAST(floor(span / P) AS BIGINT) + 1 AS n_transits, sigma,
      RpRs * RpRs / greatest(sigma, 1e-9) * sqrt(greatest(n_in, 1)) AS expected_snr, f_out - f_in AS observed_depth,
      (f_out - f_in) / greatest(sigma, 1e-9) * sqrt(greatest(n_in, 1)) AS observed_snr,
      coalesce(aRs IS NOT NULL AND b BETWEEN 0 AND 105e-2, false) AS finite_geometry, b AS impact
      FROM st JOIN ob USING (object_id))"""


def quality(spark, sf):
    cadence, eph = sparse(spark, sf)
    i = F.col("object_id")
    objects = eph.join(red.white_sigma(cadence, centred=False), "object_id").withColumns({
        "RpRs": s.lit(0.01) + (i % 15) / s.lit(100.0),
        "aRs": F.when(i % 11 != 0, s.lit(3.0) + i % 47),
        "b": (i % 110) / s.lit(100.0),
    })
    return red.quality_metrics(cadence, objects, 80)


QUALITY_COLUMNS = ("cadence_fraction", "sigma", "expected_snr", "observed_depth", "observed_snr")


@query("a12_quality_metrics", f"""WITH {QUALITY}
SELECT object_id, n_cadences, {r('cadence_fraction')} AS cadence_fraction, n_in_transit, n_transits, {r('sigma')} AS sigma,
 {r('expected_snr')} AS expected_snr, {r('observed_depth')} AS observed_depth, {r('observed_snr')} AS observed_snr,
 finite_geometry, impact FROM q""")
def quality_metrics(spark, sf):
    return rounded(quality(spark, sf), *QUALITY_COLUMNS)


@query("p04_quality_gate", f"""WITH {QUALITY}
SELECT object_id, coalesce(finite_geometry AND n_cadences >= 60 AND cadence_fraction >= 7e-1 AND n_in_transit >= 2
 AND n_transits >= 2 AND observed_snr >= -5e-1 AND impact <= 9e-1, false) AS passes FROM q""")
def quality_gate(spark, sf):
    limits = c.QualityLimits(min_cadences=60, min_in_transit=2, min_observed_snr=-0.5)
    return quality(spark, sf).select("object_id", c.passes_quality(limits).alias("passes"))


@query("j05_gap_mask", f"""WITH {SPARSE},
gap AS (SELECT object_id, t - 1 / 48e0 AS start, t + 1 / 48e0 AS stop FROM cad WHERE event_type = 'error')
SELECT object_id, {r('t')} AS t, flux FROM cad c WHERE NOT EXISTS (
  SELECT 1 FROM gap WHERE gap.object_id = c.object_id AND c.t BETWEEN gap.start AND gap.stop)""")
def gap_mask(spark, sf):
    return rounded(red.mask_gaps(b.sparse_cadence(spark, sf), b.gaps(spark, sf)), "t")


def _median_sql(half: int, value: str = "flux") -> str:
    return f"""
wn AS (SELECT *, list({value}) OVER (w ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS l,
       count(*) OVER (w ROWS BETWEEN {half} PRECEDING AND 1 PRECEDING) AS k_before,
       count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND {half} FOLLOWING) AS k_after FROM src
       WINDOW w AS (PARTITION BY object_id ORDER BY t, flux)),
tr AS (SELECT *, list_sort(list_concat(list_concat([l[1] for x in range({half} - k_before)], l),
       [l[-1] for x in range({half} - k_after)]))[{half + 1}] AS trend FROM wn)"""


@query("w02_running_median", f"""WITH {DENSE}, src AS (SELECT * FROM cad), {_median_sql(5)}
SELECT object_id, t, flux, {r('trend')} AS trend FROM tr""")
def running_median(spark, sf):
    return rounded(red.rolling_median(b.dense_cadence(spark, sf), "flux", 5), "trend")


MASKED = f"""
inm AS (SELECT c.object_id, t, flux, abs({phase_days()}) < 7e-1 * duration AS inside FROM cad c JOIN eph USING (object_id)),
ob AS (SELECT object_id, median(flux) AS med, count(*) FILTER (NOT inside) AS n_out FROM inm GROUP BY 1),
wk AS (SELECT inm.object_id, t, flux, med, CASE WHEN inside AND n_out > 2 THEN NULL ELSE flux END AS work FROM inm JOIN ob USING (object_id)),
nbr AS (SELECT *, last_value(work IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN work IS NOT NULL THEN t END IGNORE NULLS) OVER p AS px,
        first_value(work IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN work IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nx FROM wk
        WINDOW p AS (PARTITION BY object_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               f AS (PARTITION BY object_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
src AS (SELECT object_id, t, flux, med, coalesce(work, pv + (nv - pv) * (t - px) / nullif(nx - px, 0), pv, nv) AS work FROM nbr)"""


@query("w03_interpolate_masked", f"""WITH {SPARSE}, {EPH}, {MASKED}
SELECT object_id, {r('t')} AS t, flux, {r('work')} AS work FROM src""")
def interpolate_masked(spark, sf):
    rows = red.mask_transits(red.join_ephemeris(*sparse(spark, sf)))
    return rounded(rows.select("object_id", "t", "flux", "work"), "t", "work")


@query("w04_flatten", f"""WITH {SPARSE}, {EPH}, {MASKED}, {_median_sql(7, 'work')},
fx AS (SELECT *, CASE WHEN abs(trend) < 1e-6 THEN med ELSE trend END AS tr2 FROM tr)
SELECT object_id, {r('t')} AS t, flux, {r('work')} AS work, {r('tr2')} AS trend, {r('coalesce(flux / nullif(tr2, 0), flux)')} AS flat FROM fx""")
def flatten(spark, sf):
    return rounded(red.flatten_fixed(*sparse(spark, sf), 15), "t", "work", "trend", "flat")


def _own_median_sql() -> str:
    """Median over a frame whose width is the object's own; the ends repeat as in ``_median_sql``."""
    return f"""
pw AS (SELECT src.*, k.h, row_number() OVER (PARTITION BY src.object_id ORDER BY t, flux) AS rn, count(*) OVER (PARTITION BY src.object_id) AS n
       FROM src JOIN (SELECT object_id, (k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) // 2 AS h FROM sz) k ON src.object_id = k.object_id),
al AS (SELECT object_id, list(work ORDER BY t, flux) AS v FROM src GROUP BY 1),
tr AS (SELECT pw.object_id, t, flux, med, work, 2 * h + 1 AS "window",
       list_sort(list_concat(list_concat([v[1] for x in range(greatest(0, h - rn + 1))], v[greatest(1, rn - h):least(n, rn + h)]),
       [v[-1] for x in range(greatest(0, rn + h - n))]))[h + 1] AS trend FROM pw JOIN al USING (object_id))"""


OWN = """
d AS (SELECT object_id, t - lag(t) OVER (PARTITION BY object_id ORDER BY t, flux) AS d FROM cad),
sp AS (SELECT object_id, median(d) AS dt, count(*) AS n FROM d GROUP BY 1),
sz AS (SELECT object_id, greatest(11, least(round_even(greatest(1e0, 8e0 * duration) / dt, 0), greatest(11, n // 3)))::INTEGER AS k
       FROM sp JOIN eph USING (object_id))"""


@query("w04_flatten_own_window", f"""WITH {SPARSE}, {EPH}, {MASKED}, {OWN}, {_own_median_sql()},
fx AS (SELECT *, CASE WHEN abs(trend) < 1e-6 THEN med ELSE trend END AS tr2 FROM tr)
SELECT object_id, {r('t')} AS t, flux, {r('work')} AS work, "window", {r('tr2')} AS trend, {r('coalesce(flux / nullif(tr2, 0), flux)')} AS flat FROM fx""")
def flatten_own_window(spark, sf):
    return rounded(red.flatten(*sparse(spark, sf)), "t", "work", "trend", "flat")


@query("w04_trend_windows", f"""WITH {SPARSE}, {EPH},
d AS (SELECT object_id, t - lag(t) OVER (PARTITION BY object_id ORDER BY t, flux) AS d FROM cad),
sp AS (SELECT object_id, median(d) AS dt, count(*) AS n FROM d GROUP BY 1),
sz AS (SELECT object_id, n, dt, greatest(11, least(round_even(greatest(1e0, 8e0 * duration) / dt, 0), greatest(11, n // 3)))::INTEGER AS k
       FROM sp JOIN eph USING (object_id))
SELECT object_id, CASE WHEN n >= 3 AND dt > 0 THEN k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS "window" FROM sz""")
def trend_windows(spark, sf):
    return red.trend_windows(*sparse(spark, sf))


@query("w13_autocorrelation", f"""WITH {SPARSE},
l AS (SELECT object_id, flux, lag(flux, 3) OVER (PARTITION BY object_id ORDER BY t, flux) AS lg FROM cad)
SELECT object_id, {r('corr(flux, lg)')} AS autocorrelation, count(*) AS pairs FROM l WHERE lg IS NOT NULL GROUP BY 1""")
def autocorrelation(spark, sf):
    return rounded(red.autocorrelation(b.sparse_cadence(spark, sf), 3), "autocorrelation")


@query("j11_noise_multiply", f"""WITH {SEGMENTS},
lib AS (SELECT object_id, segment, row_number() OVER (ORDER BY object_id, segment) - 1 AS segment_key, count(*) OVER () AS k
        FROM (SELECT DISTINCT object_id, segment FROM seg)),
one AS (SELECT segment_key, i AS j, flux AS noise FROM seg JOIN lib USING (object_id, segment)),
mo AS (SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY t, flux) - 1 AS INTEGER) AS i, 1 - flux / 1e6 AS model
       FROM cad)
SELECT mo.object_id, mo.i, {r('model * noise')} AS flux FROM mo
JOIN one ON segment_key = (mo.object_id * 7 + 1) % (SELECT max(k) FROM lib) AND j = (mo.i + mo.object_id % 13) % 100""")
def noise_multiply(spark, sf):
    """Every complete piece of every object is in the library."""
    pieces = red.noise_segments(b.dense_cadence(spark, sf), 100)
    library = g.pinned(g.positions(pieces.select("object_id", "segment").distinct(), [], [F.col("object_id"), F.col("segment")]))
    segments = pieces.join(library, ["object_id", "segment"]).select(
        F.col("pos").alias("segment_key"), F.col("i").alias("j"), F.col("flux").alias("noise"), F.lit(100).alias("length"))
    k = library.agg(F.max("n_rows").alias("k"))
    dense = b.dense_cadence(spark, sf)
    rows = g.by_length(dense, ["object_id"], lambda rows, short: g.positions(rows, ["object_id"], red.by_time(), bounded=short))
    objects = rows.crossJoin(F.broadcast(k)).select(
        "object_id", F.col("pos").cast("int").alias("i"), (s.lit(1.0) - F.col("flux") / s.lit(1e6)).alias("model"),
        ((F.col("object_id") * 7 + 1) % F.col("k")).alias("segment_key"), (F.col("object_id") % 13).alias("offset"))
    return rounded(red.apply_noise(objects, segments).select("object_id", "i", "flux"), "flux")
