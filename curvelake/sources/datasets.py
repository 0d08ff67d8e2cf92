"""Sharded datasets, manifests, reports and run logs on disk."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.operators import grouped as g


def assign_shards(df: DataFrame, key: str, shard_size: int) -> DataFrame:
    """Shard number in key order, ``shard_size`` rows each, the last one short."""
    placed = g.positions(df, [], [F.col(key).asc()])
    return placed.withColumn("shard", F.floor(F.col("pos") / shard_size).cast("long")).drop("pos", "n_rows")


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that exist under a path or glob, in order; none where nothing matches. Any other trouble is raised."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def existing_shards(spark: SparkSession, path: str) -> DataFrame | None:
    """Numbers of the shards that have a folder: the folders are listed, their rows are not read."""
    folders = matching(spark, f"{path}/shard=*")
    if not folders:
        return None
    return spark.createDataFrame([(int(f.rpartition("=")[2]),) for f in folders], "shard long")


def write_dataset(df: DataFrame, path: str, key: str, shard_size: int) -> None:
    """Write the shards that are not there yet; a finished shard is never rewritten.

    The commit protocol publishes the files of a job together, so an interrupted run leaves no partial
    shard and can simply be started again.
    """
    shards = assign_shards(df, key, shard_size)
    done = existing_shards(df.sparkSession, path)
    if done is not None:
        shards = shards.join(done, "shard", "left_anti")
    shards.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def read_dataset(spark: SparkSession, path: str, required: Sequence[str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """Required columns and those optional ones that any shard has; the others come back NULL."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    extra = [
        F.col(c) if c in found.columns else F.lit(None).cast(kind).alias(c) for c, kind in (optional or {}).items()
    ]
    return found.select(*required, *extra, F.col("shard").cast("long").alias("shard"))


def shard_offsets(dataset: DataFrame) -> DataFrame:
    """First flat index of each shard."""
    sizes = dataset.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    upto = g.running(sizes, [], [F.col("shard")], {"_end": F.col("size")})
    return upto.select("shard", (F.col("_end") - F.col("size")).alias("offset"), "size")


def locate(indices: DataFrame, offsets: DataFrame) -> DataFrame:
    """Shard and local index of flat indices ``idx``.

    Shard starts and indices are merged in order and each index takes the last start before it: an
    ordered pass, no range join.
    """
    starts = offsets.select(F.col("offset").cast("double").alias("x"), F.col("shard").alias("start_shard"), F.lit(None).cast("long").alias("idx"))
    asked = indices.select((F.col("idx") + F.lit(0.5)).alias("x"), F.lit(None).cast("long").alias("start_shard"), F.col("idx").cast("long").alias("idx"))
    merged = g.nearest_known(starts.unionByName(asked), [], "x", "start_shard")
    return merged.filter(F.col("idx").isNotNull()).select(
        "idx", F.col("prev_v").alias("shard"), (F.col("idx") - F.col("prev_x")).cast("long").alias("local")
    )


def gather(dataset: DataFrame, indices: DataFrame, key: str) -> DataFrame:
    """Rows at the given flat indices (shard order, then key order)."""
    where = locate(indices, shard_offsets(dataset))
    local = g.positions(dataset, ["shard"], [F.col(key).asc()])
    return where.join(local.withColumnRenamed("pos", "local").drop("n_rows"), ["shard", "local"])


def batches(df: DataFrame, size: int, order: Sequence[Column], *, drop_last: bool = True) -> DataFrame:
    """Fixed-size batches along ``order``; the short last one is dropped, as at the end of an epoch."""
    placed = g.positions(df, [], list(order))
    out = placed.withColumn("batch_id", F.floor(F.col("pos") / size))
    if drop_last:
        out = out.filter(F.col("batch_id") < F.floor(F.col("n_rows") / size))
    return out.drop("pos", "n_rows")


def shuffled_batches(df: DataFrame, size: int, key: str, seed: int) -> DataFrame:
    """Batches in an order fixed by the seed: the same rows after any retry."""
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    return batches(rows, size, [F.col("_h"), F.col(key)]).drop("_h")


def canonical_json(config: Mapping) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"))


# Offset of the evaluation seed, and the settings that count as realism flags.
EVAL_SEED_OFFSET = 99_991
FLAG_SETTINGS = ("gap_fraction", "dilution_fraction", "density_prior", "detrend", "real_noise")


def dataset_metadata(df: DataFrame, config: Mapping, seed: int, shard_size: int) -> DataFrame:
    """One row: size, shards, seeds, configuration hash and flags."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows")).select(
        "n_rows",
        F.ceil(F.col("n_rows") / shard_size).alias("n_shards"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(seed + EVAL_SEED_OFFSET).cast("long").alias("eval_seed"),
        F.sha2(F.lit(canonical_json(config)), 256).alias("config_sha256"),
        *[F.lit(bool(config.get(k))).alias(k) for k in FLAG_SETTINGS],
    )


def shard_status(dataset: DataFrame, expected: DataFrame) -> DataFrame:
    """Found against expected rows per shard, shards missing on either side included."""
    found = dataset.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    joined = expected.join(found, "shard", "full_outer")
    rows, want = F.coalesce("rows", F.lit(0)), F.coalesce("expected", F.lit(0))
    return joined.select(
        "shard", rows.alias("rows"), want.alias("expected"), (rows >= want).alias("complete"), F.col("expected").isNull().alias("extra")
    )


def manifest(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.col("complete") & ~F.col("extra")).alias("complete_shards"),
        F.count_if(F.col("extra")).alias("supplement_shards"),
        F.count_if(~F.col("complete")).alias("bad_shards"),
        F.sum("rows").alias("rows"),
        F.try_divide(
            F.lit(100.0) * F.count_if(F.col("complete") & ~F.col("extra")), F.count_if(~F.col("extra")).cast("double")
        ).alias("percent"),
    )


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def supplement(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Base rows plus the extra rows whose key is new."""
    fresh = extra.join(base.select(key), key, "left_anti").dropDuplicates([key])
    return base.unionByName(fresh, allowMissingColumns=True)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, paths: Sequence[str], schema: str, key: str, *, multi_line: bool = False) -> DataFrame:
    """Reports from several places, each a path or a glob; for each key the first place that has it wins.

    ``multi_line`` reads one indented JSON document per file, or an array of them, instead of one per line.
    Places where nothing exists are passed over.
    """
    rows = spark.createDataFrame([], schema).withColumn("_p", F.lit(0))
    for priority, path in enumerate(paths):
        if matching(spark, path):
            one = spark.read.schema(schema).option("multiLine", multi_line).json(path).withColumn("_p", F.lit(priority))
            rows = rows.unionByName(one)
    fields = [c for c in rows.columns if c not in (key, "_p")]
    best = F.min(F.struct("_p", *fields))
    return rows.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b._p").alias("source"), *[F.col(f"_b.{c}") for c in fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    from curvelake.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
