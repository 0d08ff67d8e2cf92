"""Analysis of append-only run logs ``(run, step, ts, total, ...)``; NULL total = not finite."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.functions import scalars as s
from curvelake.operators import grouped as g

RUN = ["run"]


def number_steps(log: DataFrame, order: list[Column]) -> DataFrame:
    placed = g.positions(log, RUN, order)
    return placed.withColumn("step", F.col("pos") + 1).drop("pos", "n_rows")


def best_step(log: DataFrame, metric: str, *, highest: bool = False) -> DataFrame:
    """Step of the best metric per run, the first among equals."""
    value, step = F.col(metric), F.col("step")
    known = value.isNotNull()
    if highest:
        best = F.max(F.when(known, F.struct(value.alias("v"), (-step).alias("s"))))
        return log.groupBy(*RUN).agg(best.alias("_b")).select(
            *RUN, (-F.col("_b.s")).alias("step"), F.col("_b.v").alias(metric)
        )
    best = F.min(F.when(known, F.struct(value.alias("v"), step.alias("s"))))
    return log.groupBy(*RUN).agg(best.alias("_b")).select(*RUN, F.col("_b.s").alias("step"), F.col("_b.v").alias(metric))


def best_so_far(log: DataFrame, metric: str, *, highest: bool = False) -> DataFrame:
    return g.running(
        log, RUN, [F.col("step")], {"best": F.col(metric)},
        kind="max" if highest else "min",
    )


def throughput(log: DataFrame, n_steps: int, batch_size: int, *, seconds: Column, waited: Column | None = None) -> DataFrame:
    """Steps and curves per second since the previous record, share of time spent waiting, time left.

    The first record of a run has no interval: its rate and its share are 0.
    """
    rows = g.sliding(
        log.withColumn("_t", seconds), RUN, [F.col("step")],
        {"_t0": lambda w: F.lag("_t").over(w), "_s0": lambda w: F.lag("step").over(w)}, before=1,
    )
    interval = s.at_least(F.col("_t") - F.col("_t0"), 1e-6)
    rate = (F.col("step") - F.col("_s0")) / interval
    out = rows.withColumns({"interval": interval, "steps_per_s": F.coalesce(rate, F.lit(0.0))}).withColumns({
        "lc_per_s": F.col("steps_per_s") * batch_size,
        "eta_s": (F.lit(n_steps) - F.col("step")) / s.at_least(F.col("steps_per_s"), 1e-6),
    })
    if waited is not None:
        out = out.withColumn("data_wait_frac", F.coalesce(F.bround(waited / F.col("interval"), 3), F.lit(0.0)))
    return out.drop("_t", "_t0", "_s0")


def last_record(log: DataFrame, defaults: Mapping[str, Column], runs: DataFrame | None = None) -> DataFrame:
    """Latest record per run; runs without records get the defaults."""
    last = log.groupBy(*RUN).agg(F.max(F.struct("step", *[c for c in defaults if c != "step"])).alias("_l"))
    if runs is not None:
        last = runs.join(last, RUN, "left")
    return last.select(*RUN, *[F.coalesce(F.col(f"_l.{c}"), d).alias(c) for c, d in defaults.items()])


def health(latest: DataFrame, *, expect_device: str | None = None, n_steps: int = 0, max_wait: float = 0.35, stalled_after: float = 180.0) -> DataFrame:
    """Warnings and verdict per run from its latest record.

    ``latest``: run, device, total, data_wait_frac, age_s, status.
    """
    finite = s.is_finite(F.col("total"))
    device = F.lower(F.coalesce("device", F.lit("")))
    mismatch = (device != expect_device) if expect_device else F.lit(False)
    warnings = F.array_compact(F.array(
        F.when(mismatch, "DEVICE-MISMATCH").when((device == "cpu") & F.lit(n_steps > 2000), "CPU-LONG-RUN"),
        F.when(F.col("data_wait_frac") > max_wait, "GPU-STARVED"),
        F.when(~finite, "NON-FINITE-LOSS"),
    ))
    verdict = (
        F.when(F.col("status").isin("done", "interrupted", "error"), F.upper("status"))
        .when(F.col("age_s") > stalled_after, "STALLED")
        .when(~finite, "DIVERGED")
        .when(F.size("warnings") > 0, "WARN")
        .otherwise("HEALTHY")
    )
    return latest.withColumn("warnings", warnings).withColumn("verdict", verdict)


def loss_trend(log: DataFrame, edge: int = 10, slack: float = 1.05) -> DataFrame:
    """Is the mean of the last records within ``slack`` of the first? True for short logs."""
    placed = g.positions(log, RUN, [F.col("step")])
    first = F.avg(F.when(F.col("pos") < edge, F.col("total")))
    last = F.avg(F.when(F.col("pos") >= F.col("n_rows") - edge, F.col("total")))
    ok = F.when(F.first("n_rows") >= 2 * edge, F.coalesce(last <= first * s.lit(slack), F.lit(False))).otherwise(F.lit(True))
    return placed.groupBy(*RUN).agg(first.alias("first_mean"), last.alias("last_mean"), ok.alias("trending"))


def nonfinite_streak(log: DataFrame, patience: int = 20) -> DataFrame:
    """Consecutive non-finite records up to each step, and whether patience has run out.

    Records are counted, not steps: a log may hold every hundredth step only.
    """
    placed = g.positions(log, RUN, [F.col("step").asc()])
    finite = F.when(F.col("total").isNotNull(), F.col("pos"))
    rows = g.running(placed, RUN, [F.col("pos").asc()], {"_last": finite}, kind="max")
    streak = (F.col("pos") - F.coalesce("_last", F.lit(-1))).cast("long")
    return rows.withColumn("streak", streak).withColumn("abort", F.col("streak") >= patience).drop("pos", "n_rows", "_last")


def keep_newest(log: DataFrame, k: int) -> DataFrame:
    placed = g.positions(log, RUN, [F.col("step").desc()])
    return placed.filter(F.col("pos") < k).drop("pos", "n_rows")


def stalls(log: DataFrame, seconds: int = 180, *, ts: str = "ts") -> DataFrame:
    """Activity sessions separated by silences longer than ``seconds``. Works on batch and stream."""
    return (
        log.groupBy("run", F.session_window(ts, f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("records"), F.max(ts).alias("last_ts"))
        .select("run", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "records", "last_ts")
    )


def windowed_throughput(log: DataFrame, width: str = "1 hour", *, ts: str = "ts") -> DataFrame:
    """Records and mean loss per tumbling window. Works on batch and stream."""
    return (
        log.groupBy("run", F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("records"), F.avg("total").alias("mean_total"))
        .select("run", F.col("w.start").alias("window_start"), "records", "mean_total")
    )
