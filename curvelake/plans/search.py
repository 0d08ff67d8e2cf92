"""Queries for period search."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import reduce as red
from curvelake.operators import search as se
from curvelake.plans.reduction import normalized_sql, sparse
from curvelake.plans.registry import EPH, SPARSE, fmod, query, r, rounded
from curvelake.sources import bindings as b

N = 32


def pgram(source: str = "cad", n: int = N, low: str = "5e-1", ratio: str = "26e0") -> str:
    return f"""
c0 AS (SELECT object_id, median(flux) AS med FROM {source} GROUP BY 1),
c1 AS (SELECT c.object_id, t, flux - med AS f FROM {source} c JOIN c0 USING (object_id)),
sg AS (SELECT object_id, '1.4826'::DOUBLE * median(abs(f)) + 1e-6 AS sigma FROM c1 GROUP BY 1),
pb AS (SELECT object_id, CAST(i AS INTEGER) AS pid, greatest(0, least(63, floor({fmod(f't / ({low} * pow({ratio}, i / {n - 1}e0))', '1e0')} * 64e0))) AS bin, sum(f) AS s, count(*) AS n
       FROM c1, range({n}) g(i) GROUP BY 1, 2, 3),
pm AS (SELECT object_id, pid, max(-(s / n) * sqrt(n) / sigma) AS m, count(*) AS used FROM pb JOIN sg USING (object_id) GROUP BY 1, 2),
pg AS (SELECT object_id, pid, {low} * pow({ratio}, pid / {n - 1}e0) AS period, CASE WHEN used < 64 THEN greatest(m, 0) ELSE m END AS score FROM pm)"""


def periodogram(spark, sf, n=N, engine="pandas"):
    return se.box_periodogram(b.sparse_cadence(spark, sf), 0.5, 13.0, n, engine=engine)


@query("a05_box_periodogram", f"WITH {SPARSE}, {pgram()} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM pg")
def box_periodogram(spark, sf):
    return rounded(periodogram(spark, sf), "period", "score")


@query("x03_periodogram_arrow", f"WITH {SPARSE}, {pgram()} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM pg")
def periodogram_arrow(spark, sf):
    return rounded(periodogram(spark, sf, engine="pandas"), "period", "score")


@query("x03_periodogram_256", f"WITH {SPARSE}, {pgram(n=256)} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM pg")
def periodogram_256(spark, sf):
    return rounded(periodogram(spark, sf, 256, engine="pandas"), "period", "score")


@query("a05_periodogram_256", f"WITH {SPARSE}, {pgram(n=256)} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM pg")
def periodogram_256_sql(spark, sf):
    return rounded(periodogram(spark, sf, 256), "period", "score")


def view_sql(points: int, n: int) -> str:
    return f"""WITH {SPARSE},
o AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY t, flux) - 1 AS pos, count(*) OVER (PARTITION BY object_id) AS n FROM cad),
sub AS (SELECT object_id, t, flux FROM o WHERE n <= {points} OR (pos % greatest(1, n // {points}) = 0 AND pos // greatest(1, n // {points}) < {points})),
{pgram('sub', n)}, {normalized_sql('pg', 'score', keep='pid')}
SELECT object_id, pid, {r('score')} AS score FROM normed"""


@query("a06_periodogram_view_4096", view_sql(4096, 256))
def periodogram_view_4096(spark, sf):
    out = se.periodogram_view(b.sparse_cadence(spark, sf), 0.5, 13.0, 256)
    return rounded(out.select("object_id", "pid", "score"), "score")


@query("a06_periodogram_view", view_sql(40, N))
def periodogram_view(spark, sf):
    out = se.periodogram_view(b.sparse_cadence(spark, sf), 0.5, 13.0, N, n_raw=40)
    return rounded(out.select("object_id", "pid", "score"), "score")


def best_sql(n: int = N) -> str:
    return f"""{SPARSE}, {pgram(n=n)},
bp AS (SELECT object_id, pid, period, row_number() OVER (PARTITION BY object_id ORDER BY round(score, 9) DESC, pid) AS rk, score FROM pg)"""


BEST = best_sql()


@query("a07_best_period", f"WITH {BEST} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM bp WHERE rk = 1")
def best_period(spark, sf):
    return rounded(se.best_period(periodogram(spark, sf)), "period", "score")


@query("a07_best_period_256", f"WITH {best_sql(256)} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM bp WHERE rk = 1")
def best_period_256(spark, sf):
    return rounded(se.best_period(periodogram(spark, sf, 256, engine="pandas")), "period", "score")


def match_sql(n: int = N) -> str:
    return f"""WITH {best_sql(n)}, {EPH}
SELECT object_id, pid, (abs(period - P) / P < 0.05 OR abs(period - P / 2) / (P / 2) < 0.05 OR abs(period - P * 2) / (P * 2) < 0.05) AS match
FROM bp JOIN eph USING (object_id) WHERE rk = 1"""


@query("a39_harmonic_match", match_sql())
def harmonic_match(spark, sf):
    cadence, eph = sparse(spark, sf)
    return se.harmonic_match(se.best_period(periodogram(spark, sf)), eph).select("object_id", "pid", "match")


@query("a39_harmonic_match_256", match_sql(256))
def harmonic_match_256(spark, sf):
    cadence, eph = sparse(spark, sf)
    return se.harmonic_match(se.best_period(periodogram(spark, sf, 256, engine="pandas")), eph).select("object_id", "pid", "match")


NB = 12


def box_sql(n: int = NB, low: str = "2e0", span: str = "1e1", durations: tuple[str, ...] = ("2e-1", "4e-1", "8e-1")) -> str:
    return f"""{SPARSE},
m AS (SELECT object_id, median(flux) AS med, stddev_pop(flux) AS sd, count(*) AS n FROM cad GROUP BY 1),
c1 AS (SELECT c.object_id, t, flux - med AS f FROM cad c JOIN m USING (object_id)),
tot AS (SELECT object_id, sum(f) AS total FROM c1 GROUP BY 1),
du(did, dur) AS (VALUES {', '.join(f'({i}, {d})' for i, d in enumerate(durations))}),
pr AS (SELECT CAST(i AS INTEGER) AS pid, {low} + i * ({span} / {n - 1}e0) AS period FROM range({n}) g(i)),
bx AS (SELECT pid, period, did, dur / period AS w, greatest(CAST(floor(1 / greatest(dur / period, 1e-3)) AS INTEGER), 4) AS steps FROM pr CROSS JOIN du),
cn AS (SELECT bx.*, c / steps::DOUBLE AS centre, c FROM bx, LATERAL (SELECT unnest(range(steps)) AS c)),
ib AS (SELECT object_id, pid, did, c, sum(f) AS s, count(*) AS k FROM c1, cn
       WHERE abs({fmod(fmod('t / period', '1e0') + ' - centre + 5e-1', '1e0')} - 5e-1) < w / 2 GROUP BY 1, 2, 3, 4),
sc AS (SELECT ib.object_id, pid, ((total - s) / (n - k) - s / k) / (sd / sqrt(k) + 1e-9) AS snr FROM ib JOIN m ON m.object_id = ib.object_id
       JOIN tot ON tot.object_id = ib.object_id WHERE k >= 3 AND n - k >= 3),
pw AS (SELECT o.object_id, pr.pid, pr.period, greatest(coalesce(max(snr), 0), 0) AS score FROM (SELECT object_id FROM m) o CROSS JOIN pr
       LEFT JOIN sc ON sc.object_id = o.object_id AND sc.pid = pr.pid GROUP BY 1, 2, 3)"""


BLS = box_sql()


@query("a08_box_least_squares", f"WITH {BLS} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM pw")
def box_least_squares(spark, sf):
    out = se.box_least_squares(b.sparse_cadence(spark, sf), 2.0, 12.0, NB, [0.2, 0.4, 0.8], engine="pandas")
    return rounded(out, "period", "score")


PUBLISHED = box_sql(2000, "5e-1", "125e-1", ("5e-2", "1e-1", "2e-1"))


@query("a08_box_least_squares_2000", f"WITH {PUBLISHED} SELECT object_id, pid, {r('period')} AS period, {r('score')} AS score FROM pw")
def box_least_squares_2000(spark, sf):
    out = se.box_least_squares(b.sparse_cadence(spark, sf), 0.5, 13.0, 2000, [0.05, 0.1, 0.2], engine="pandas")
    return rounded(out, "period", "score")


@query("a09_refine_epoch", f"""WITH {SPARSE}, {EPH},
d AS (SELECT object_id, t - lag(t) OVER (PARTITION BY object_id ORDER BY t, flux) AS d FROM cad),
dt AS (SELECT object_id, median(d) AS dt FROM d GROUP BY 1),
m AS (SELECT object_id, median(flux) AS med, min(t) AS start FROM cad GROUP BY 1),
c1 AS (SELECT c.object_id, start, P, flux - med AS f, greatest(5e-1 * duration, dt) AS half, {fmod('t - start', 'P')} AS ph
       FROM cad c JOIN m USING (object_id) JOIN eph USING (object_id) JOIN dt USING (object_id)),
hit AS (SELECT object_id, i AS centre, any_value(P) AS P, any_value(start) AS start, round(-sum(f) / count(*), 9) AS depth FROM c1, range(512) g(i)
        WHERE least(abs(ph - i * P / 512e0), P - abs(ph - i * P / 512e0)) < half GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY depth DESC, centre) AS rk FROM hit)
SELECT object_id, centre, {r('depth')} AS depth, {r('start + centre * P / 512e0')} AS t0 FROM rk WHERE rk = 1""")
def refine_epoch(spark, sf):
    return rounded(se.refine_epoch(*sparse(spark, sf)), "depth", "t0")


@query("j04_trial_grid", f"""WITH {SPARSE},
k AS (SELECT object_id, count(*) AS n FROM cad GROUP BY 1)
SELECT object_id, CAST(i AS INTEGER) AS pid, {r(f'5e-1 * pow(26e0, i / {N - 1}e0)')} AS period, n FROM k, range({N}) g(i)""")
def trial_grid(spark, sf):
    objects = b.sparse_cadence(spark, sf).groupBy("object_id").agg(F.count("*").alias("n"))
    out = objects.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    return rounded(out.withColumn("period", se.log_grid(0.5, 13.0, N)), "period")


@query("f03_phase_bin", f"""WITH {SPARSE}, {EPH}
SELECT object_id, event_id, CAST(greatest(0, least(63, floor({fmod('t / P', '1e0')} * 64e0))) AS INTEGER) AS bin FROM cad JOIN eph USING (object_id)""")
def phase_bin(spark, sf):
    cadence = b.sparse_cadence(spark, sf, "event_id")
    rows = cadence.join(b.sparse_ephemeris(cadence), "object_id")
    return rows.select("object_id", "event_id", s.phase_bin(F.col("t"), F.col("P"), 64).alias("bin"))


@query("j06_phase_centre_hits", f"""WITH {SPARSE}, {EPH},
tn AS (SELECT object_id, flux, {fmod('t / P', '1e0')} AS turn FROM cad JOIN eph USING (object_id))
SELECT object_id, CAST(i AS INTEGER) AS centre, count(*) AS n, {r('avg(flux)')} AS mean_flux FROM tn, range(32) g(i)
WHERE least(abs(turn - i / 32e0), 1 - abs(turn - i / 32e0)) < 37e-3 GROUP BY 1, 2""")
def phase_centre_hits(spark, sf):
    cadence, eph = sparse(spark, sf)
    rows = red.join_ephemeris(cadence, eph).select(
        "object_id", "flux", s.floor_mod(F.col("t") / F.col("P"), s.lit(1.0)).alias("turn"), s.lit(0.037).alias("reach"))
    out = se.centre_hits(rows, 32).groupBy("object_id", "centre").agg(F.count("*").alias("n"), F.avg("flux").alias("mean_flux"))
    return rounded(out, "mean_flux")
