"""Live run monitoring: status, stalls, patience, snapshots.

Every stream takes a checkpoint location, so a restarted query continues after its last commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curvelake.operators import grouped as g
from curvelake.operators.grouped import safe_join
from curvelake.streaming import snapshots

#: Parts of a snapshot table; a trigger rewrites those it has rows for.
BUCKETS = 16


def read_log_stream(spark: SparkSession, path: str, schema, *, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def latest_status(log: DataFrame) -> DataFrame:
    """Latest record per run; on a stream the state holds one row per run."""
    last = F.max(F.struct("ts", "event_id", "total", "raw")).alias("_l")
    return log.groupBy("run").agg(last, F.count(F.lit(1)).alias("records")).select(
        "run", "records", F.col("_l.ts").alias("ts"), F.col("_l.total").alias("total"), F.col("_l.raw").alias("raw")
    )


def snapshot_upsert(changes: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a one-row-per-run table: each trigger's rows take the place of their runs' earlier rows."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        return batch if old is None else batch.unionByName(safe_join(old, batch.select("run"), ["run"], "left_anti"))

    return _fold(changes, path, checkpoint, buckets, "update", merge)


def _fold(stream: DataFrame, path: str, checkpoint: str, buckets: int, mode: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """A table that each micro-batch is merged into by `merge(rows of the touched buckets, batch)`."""

    def apply(batch: DataFrame, number: int) -> None:
        snapshots.update(batch, path, number, "run", buckets, merge)

    return (
        stream.writeStream.outputMode(mode).foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest published version of a snapshot table."""
    return snapshots.read(spark, path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def streak_summary(log: DataFrame) -> DataFrame:
    """What a piece of each run's log says about non-finite losses: records, the streaks it begins and ends with, the longest one.

    Two summaries of consecutive pieces make the summary of both, so a run may come in any number of pieces. Places and last finite
    records are found in ordered passes, where a run takes as many ranges as it needs.
    """
    placed = g.positions(log.select("run", "ts", "event_id", "total"), ["run"], [F.col("ts").asc(), F.col("event_id").asc()])
    finite = F.when(F.col("total").isNotNull(), F.col("pos"))
    rows = g.running(placed, ["run"], [F.col("pos").asc()], {"_last": finite}, kind="max")
    n, first, last = F.first("n_rows"), F.min(finite), F.max(finite)
    return rows.groupBy("run").agg(
        n.alias("records"), F.coalesce(first, n).alias("leading"), F.coalesce(n - 1 - last, n).alias("trailing"),
        F.max(F.col("pos") - F.coalesce("_last", F.lit(-1))).alias("most"),
    )


def upsert_streaks(log: DataFrame, path: str, checkpoint: str, patience: int = 20, *, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep last_step, streak, longest and aborted of every run: consecutive non-finite losses across micro-batches.

    Records of a run must arrive in step order from batch to batch; inside a batch they are ordered. The table's row is the state
    of a run, so a restart goes on from its last version.
    """

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = streak_summary(batch)
        if old is None:
            old = new.select("run", *[F.lit(0).cast("long").alias(c) for c in ("last_step", "streak", "longest")], F.lit(False).alias("aborted")).limit(0)
        known = old.select(F.col("run").alias("_run"), *[F.col(c).alias(f"_{c}") for c in ("last_step", "streak", "longest", "aborted")], F.lit(True).alias("_old"))
        rows = new.withColumn("_new", F.lit(True)).join(known, F.col("run").eqNullSafe(F.col("_run")), "full_outer")
        zero = F.lit(0).cast("long")
        before, records = F.coalesce("_streak", zero), F.coalesce("records", zero)
        streak = F.when(F.coalesce("trailing", zero) == records, before + records).otherwise(F.col("trailing"))
        longest = F.greatest(F.coalesce("_longest", zero), before + F.coalesce("leading", zero), F.coalesce("most", zero))
        return rows.select(
            F.when(F.col("_new").isNotNull(), F.col("run")).otherwise(F.col("_run")).alias("run"), (F.coalesce("_last_step", zero) + records).alias("last_step"),
            streak.alias("streak"), longest.alias("longest"), (F.coalesce("_aborted", F.lit(False)) | (longest >= patience)).alias("aborted"),
        )

    return _fold(log, path, checkpoint, buckets, "append", merge)


def stall_alerts(log: DataFrame, seconds: int = 180, delay: str = "10 minutes") -> DataFrame:
    """One alert per run when event time passes ``seconds`` beyond its last record."""

    def watch(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame([{"run": key[0], "last_seen_ms": seen}])
            return
        newest = max(c["ts"].max().value // 1_000_000 for c in chunks)
        seen = max(newest, state.get[0] if state.exists else 0)
        state.update((seen,))
        state.setTimeoutTimestamp(max(seen + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return log.withWatermark("ts", delay).select("run", "ts").groupBy("run").applyInPandasWithState(
        watch, "run long, last_seen_ms long", "seen long", "append", GroupStateTimeout.EventTimeTimeout
    )
