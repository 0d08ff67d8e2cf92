"""Queries for run logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import runlog as rl
from curvelake.plans.registry import query, r, rounded
from curvelake.sources import bindings as b
from curvelake.sources import datasets as ds
from curvelake.streaming import runs as st

LOG = """lg AS (SELECT user_id AS run, ts, event_id, (epoch_us(ts) - 1704067200000000) / 86400e6 AS t, CASE WHEN value <= 200 THEN value END AS total, value AS raw, event_type,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"""


def log(spark, sf):
    return rl.number_steps(b.run_log_rows(spark, sf), [F.col("t"), F.col("event_id")])


@query("a51_run_best", f"""WITH {LOG},
lo AS (SELECT run, step, total, row_number() OVER (PARTITION BY run ORDER BY total NULLS LAST, step) AS k FROM lg),
hi AS (SELECT run, step, raw, row_number() OVER (PARTITION BY run ORDER BY raw DESC, step) AS k FROM lg)
SELECT lo.run, lo.step, lo.total, hi.step AS raw_step, hi.raw FROM lo JOIN hi ON lo.run = hi.run WHERE lo.k = 1 AND hi.k = 1""")
def run_best(spark, sf):
    rows = log(spark, sf)
    high = rl.best_step(rows, "raw", highest=True).withColumnRenamed("step", "raw_step")
    return rl.best_step(rows, "total").join(high, "run")


@query("a52_run_throughput", f"""WITH {LOG},
d AS (SELECT run, step, raw, greatest((t - lag(t) OVER w) * 864e2, 1e-6) AS interval, step - lag(step) OVER w AS ds FROM lg WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT run, step, {r('interval', 3)} AS interval, {r('coalesce(ds / interval, 0)')} AS steps_per_s, {r('coalesce(ds / interval * 256, 0)', 4)} AS lc_per_s,
 {r('(100 - step) / greatest(coalesce(ds / interval, 0), 1e-6)', 6)} AS eta_s, coalesce(round_even(raw / interval, 3), 0) AS data_wait_frac
FROM (SELECT run, step, raw, ds, CASE WHEN ds IS NOT NULL THEN interval END AS interval FROM d)""")
def run_throughput(spark, sf):
    out = rl.throughput(log(spark, sf), 100, 256, seconds=F.col("t") * s.lit(86400.0), waited=F.col("raw"))
    out = out.withColumns({"interval": F.round("interval", 3), "steps_per_s": F.round("steps_per_s", 6), "lc_per_s": F.round("lc_per_s", 4), "eta_s": F.round("eta_s", 6)})
    return out.select("run", "step", "interval", "steps_per_s", "lc_per_s", "eta_s", "data_wait_frac")


LATEST = f"""{LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rk FROM lg)"""


@query("k06_last_record", f"""WITH {LATEST}, one AS (SELECT * FROM k WHERE rk = 1)
SELECT c_custkey AS run, coalesce(step, 0) AS step, coalesce(total, -1e0) AS total FROM customer LEFT JOIN one ON run = c_custkey""")
def last_record(spark, sf):
    runs = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"))
    return rl.last_record(log(spark, sf), {"step": F.lit(0).cast("long"), "total": s.lit(-1.0)}, runs)


@query("a53_run_health", f"""WITH {LATEST},
l AS (SELECT run, total, CASE WHEN run % 3 = 0 THEN 'cpu' ELSE 'cuda' END AS device, round(raw / 1e2, 6) AS wait, (30 - t) * 864e2 / 1e3 AS age,
      CASE WHEN run % 13 = 0 THEN 'done' ELSE 'running' END AS status FROM k WHERE rk = 1)
SELECT run, concat_ws(';', CASE WHEN device = 'cpu' THEN 'CPU-LONG-RUN' END, CASE WHEN wait > '0.35'::DOUBLE THEN 'GPU-STARVED' END, CASE WHEN total IS NULL THEN 'NON-FINITE-LOSS' END) AS warnings,
 CASE WHEN status = 'done' THEN 'DONE' WHEN age > 60 THEN 'STALLED' WHEN total IS NULL THEN 'DIVERGED' WHEN device = 'cpu' OR wait > '0.35'::DOUBLE THEN 'WARN' ELSE 'HEALTHY' END AS verdict FROM l""")
def run_health(spark, sf):
    last = log(spark, sf).groupBy("run").agg(F.max(F.struct("step", "total", "raw", "t")).alias("l"))
    latest = last.select(
        "run", "l.total", F.when(F.col("run") % 3 == 0, "cpu").otherwise("cuda").alias("device"), F.round(F.col("l.raw") / s.lit(100.0), 6).alias("data_wait_frac"),
        ((s.lit(30.0) - F.col("l.t")) * s.lit(86400.0) / s.lit(1e3)).alias("age_s"), F.when(F.col("run") % 13 == 0, "done").otherwise("running").alias("status"))
    out = rl.health(latest, n_steps=60_000, stalled_after=60.0)
    return out.select("run", F.array_join("warnings", ";").alias("warnings"), "verdict")


@query("a54_loss_trend", f"""WITH {LOG}, p AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM lg),
m AS (SELECT run, any_value(n) AS n, avg(total) FILTER (step <= 10) AS f, avg(total) FILTER (step > n - 10) AS l FROM p GROUP BY 1)
SELECT run, {r('f')} AS first_mean, {r('l')} AS last_mean, CASE WHEN n >= 20 THEN coalesce(l <= f * '1.05'::DOUBLE, false) ELSE true END AS trending FROM m""")
def loss_trend(spark, sf):
    return rounded(rl.loss_trend(log(spark, sf)), "first_mean", "last_mean")


@query("w10_nonfinite_streak", f"""WITH {LOG}, i AS (SELECT *, count(total) OVER (PARTITION BY run ORDER BY step) AS island FROM lg)
SELECT run, step, count(*) FILTER (total IS NULL) OVER (PARTITION BY run, island ORDER BY step) AS streak,
 count(*) FILTER (total IS NULL) OVER (PARTITION BY run, island ORDER BY step) >= 2 AS abort FROM i""")
def nonfinite_streak(spark, sf):
    return rl.nonfinite_streak(log(spark, sf), 2).select("run", "step", "streak", "abort")


@query("w10_streak_with_gaps", f"""WITH {LOG}, sp AS (SELECT run, step * 50 AS step, total FROM lg WHERE step % 3 <> 1),
i AS (SELECT *, count(total) OVER (PARTITION BY run ORDER BY step) AS island FROM sp)
SELECT run, step, count(*) FILTER (total IS NULL) OVER (PARTITION BY run, island ORDER BY step) AS streak,
 count(*) FILTER (total IS NULL) OVER (PARTITION BY run, island ORDER BY step) >= 3 AS abort FROM i""")
def streak_with_gaps(spark, sf):
    """A log whose steps are not consecutive: records count."""
    sparse = log(spark, sf).filter("step % 3 <> 1").withColumn("step", F.col("step") * 50)
    return rl.nonfinite_streak(sparse, 3).select("run", "step", "streak", "abort")


@query("w11_best_so_far", f"""WITH {LOG} SELECT run, step, min(total) OVER w AS best, max(raw) OVER w AS best_raw FROM lg WINDOW w AS (PARTITION BY run ORDER BY step)""")
def best_so_far(spark, sf):
    rows = rl.best_so_far(log(spark, sf), "total")
    return rl.best_so_far(rows.withColumnRenamed("best", "low"), "raw", highest=True).select("run", "step", F.col("low").alias("best"), F.col("best").alias("best_raw"))


@query("w12_keep_newest", f"WITH {LATEST} SELECT run, step, total FROM k WHERE rk <= 3")
def keep_newest(spark, sf):
    return rl.keep_newest(log(spark, sf), 3).select("run", "step", "total")


SESSIONS = """g AS (SELECT user_id AS run, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
ss AS (SELECT run, ts, sum(fresh) OVER (PARTITION BY run ORDER BY ts) AS sid FROM g)"""


@query("t02_stalls", f"""WITH {SESSIONS}
SELECT run, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 43200000000 AS session_end, count(*) AS records FROM ss GROUP BY run, sid""")
def stalls(spark, sf):
    out = rl.stalls(b.run_log_rows(spark, sf), 43_200)
    return out.select("run", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "records")


@query("t06_windowed_throughput", f"""SELECT user_id AS run, epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS window_start, count(*) AS records,
 {r('avg(CASE WHEN value <= 200 THEN value END)')} AS mean_total FROM events GROUP BY 1, 2""")
def windowed_throughput(spark, sf):
    out = rl.windowed_throughput(b.run_log_rows(spark, sf), "6 hours").withColumn("window_start", F.unix_micros("window_start"))
    return rounded(out, "mean_total")


def event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    raw = st.read_log_stream(spark, f"{sf}/events.parq*", schema, fmt="parquet")
    return b.as_run_log(raw)


def finished(query_):
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("t01_live_status", """SELECT user_id AS run, count(*) AS records, CASE WHEN arg_max(value, ts) <= 200 THEN arg_max(value, ts) END AS total, arg_max(value, ts) AS raw FROM events GROUP BY 1""")
def live_status(spark, sf):
    """Stream the log, keep a snapshot table, read its newest version."""
    path = ds.scratch(spark, "status")
    finished(st.snapshot_upsert(st.latest_status(event_stream(spark, sf)), f"{path}/table", f"{path}/checkpoint"))
    return st.read_snapshot(spark, f"{path}/table").drop("ts")


@query("t03_streak_stream", f"""WITH {LOG}, i AS (SELECT *, count(total) OVER (PARTITION BY run ORDER BY step) AS island FROM lg),
k AS (SELECT run, step, count(*) FILTER (total IS NULL) OVER (PARTITION BY run, island ORDER BY step) AS streak FROM i)
SELECT run, max(step) AS last_step, arg_max(streak, step) AS streak, max(streak) AS longest, max(streak) >= 2 AS aborted FROM k GROUP BY 1""")
def streak_stream(spark, sf):
    path = ds.scratch(spark, "streaks")
    finished(st.upsert_streaks(event_stream(spark, sf), f"{path}/table", f"{path}/checkpoint", 2))
    return st.read_snapshot(spark, f"{path}/table")


@query("t06_windowed_stream", f"""SELECT user_id AS run, epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS window_start, count(*) AS records,
 {r('avg(CASE WHEN value <= 200 THEN value END)')} AS mean_total FROM events GROUP BY 1, 2
 HAVING epoch_us(time_bucket(INTERVAL '6 hours', min(ts))) + 21600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000""")
def windowed_stream(spark, sf):
    """Append mode: a window is written once the watermark has passed its end."""
    path = ds.scratch(spark, "windows")
    windows = rl.windowed_throughput(event_stream(spark, sf).withWatermark("ts", "10 minutes"), "6 hours")
    finished(st.append_to(windows, f"{path}/table", f"{path}/checkpoint"))
    out = spark.read.parquet(f"{path}/table").withColumn("window_start", F.unix_micros("window_start"))
    return rounded(out, "mean_total")


@query("t02_stall_alerts", """SELECT user_id AS run, epoch_us(max(ts)) // 1000 AS last_seen_ms FROM events GROUP BY 1
HAVING epoch_us(max(ts)) // 1000 + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000""")
def stall_alerts(spark, sf):
    path = ds.scratch(spark, "alerts")
    finished(st.append_to(st.stall_alerts(event_stream(spark, sf), 3600), f"{path}/table", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table")


@query("t04_resume", """SELECT user_id AS run, count(*) AS records FROM events GROUP BY 1""")
def resume(spark, sf):
    """Two halves of the log arrive one after the other; the restarted query continues from its checkpoint."""
    path = ds.scratch(spark, "resume")
    rows = b.table(spark, sf, "events")
    schema = rows.schema
    half = rows.agg((F.max("event_id") / 2).alias("h"))
    marked = rows.crossJoin(F.broadcast(half))
    for part in ("event_id < h", "event_id >= h"):
        marked.filter(part).drop("h").write.mode("append").parquet(f"{path}/in")
        stream = b.as_run_log(st.read_log_stream(spark, f"{path}/in", schema, fmt="parquet"))
        finished(st.snapshot_upsert(st.latest_status(stream), f"{path}/table", f"{path}/checkpoint"))
    return st.read_snapshot(spark, f"{path}/table").select("run", "records")


@query("t05_status_snapshot", f"""WITH {LATEST} SELECT run, step, total, {r('step / 1e2', 4)} AS progress FROM k WHERE rk = 1""")
def status_snapshot(spark, sf):
    """Half of the log, then the rest, streamed into an upserted table of one row per run."""
    path = ds.scratch(spark, "snapshot")
    rows = b.table(spark, sf, "events")
    half = rows.agg((F.max("event_id") / 2).alias("h"))
    marked = rows.crossJoin(F.broadcast(half))
    for part in ("event_id < h", "event_id >= h"):
        marked.filter(part).drop("h").write.mode("append").parquet(f"{path}/in")
        stream = b.as_run_log(st.read_log_stream(spark, f"{path}/in", rows.schema, fmt="parquet"))
        finished(st.snapshot_upsert(st.latest_status(stream), f"{path}/table", f"{path}/checkpoint"))
    last = st.read_snapshot(spark, f"{path}/table").withColumnRenamed("records", "step")
    return last.select("run", "step", "total", F.round(F.col("step") / s.lit(100.0), 4).alias("progress"))
