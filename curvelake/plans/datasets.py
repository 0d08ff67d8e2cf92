"""Queries for sharded datasets, manifests, reports and logs on disk."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from curvelake.plans.registry import query, r, rounded
from curvelake.sources import bindings as b
from curvelake.sources import datasets as ds
from curvelake.sources import files

SHARDS = "sh AS (SELECT vec_id AS id, label % 2 AS d, (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS shard FROM embeddings)"


def curves(spark, sf):
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") % 2).alias("d"), F.col("embedding").alias("view"))


def written(spark, sf):
    path = ds.scratch(spark, "dataset")
    ds.write_dataset(curves(spark, sf), path, "id", 100)
    return path


@query("s05_write_dataset", f"WITH {SHARDS} SELECT shard, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM sh GROUP BY 1")
def write_dataset(spark, sf):
    """Written twice: the second run must leave every shard alone."""
    path = written(spark, sf)
    ds.write_dataset(curves(spark, sf), path, "id", 100)
    rows = ds.read_dataset(spark, path, ["id"])
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("s05_text_keys", "SELECT (row_number() OVER (ORDER BY c_name) - 1) // 64 AS shard, c_name AS id FROM customer")
def text_keys(spark, sf):
    """Shards in the order of a text key, in two runs."""
    path = ds.scratch(spark, "dataset")
    rows = b.table(spark, sf, "customer").select(F.col("c_name").alias("id"))
    for _ in range(2):
        ds.write_dataset(rows, path, "id", 64)
    return ds.read_dataset(spark, path, ["id"]).select("shard", "id")


@query("s06_read_dataset", f"WITH {SHARDS} SELECT id, d, CAST(NULL AS DOUBLE) AS dilution, shard FROM sh")
def read_dataset(spark, sf):
    return ds.read_dataset(spark, written(spark, sf), ["id", "d"], {"dilution": "double"})


@query("s06_batches", "SELECT id, batch_id FROM (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch_id, count(*) OVER () AS n FROM orders) WHERE batch_id < n // 64")
def fixed_batches(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return ds.batches(rows, 64, [F.col("id")])


@query("s06_shuffled_batches", "SELECT batch_id, count(*) AS n FROM (SELECT (row_number() OVER () - 1) // 64 AS batch_id, count(*) OVER () AS n FROM orders) WHERE batch_id < n // 64 GROUP BY 1")
def shuffled_batches(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return ds.shuffled_batches(rows, 64, "id", 7).groupBy("batch_id").agg(F.count("*").alias("n"))


LOCATE = """sz AS (SELECT l_suppkey AS shard, count(*) AS size FROM lineitem GROUP BY 1),
off AS (SELECT shard, size, sum(size) OVER (ORDER BY shard) - size AS off FROM sz),
ix AS (SELECT DISTINCT o_orderkey * 3 % (SELECT count(*) FROM lineitem) AS idx FROM orders)"""


@query("j13_locate_index", f"WITH {LOCATE} SELECT idx, shard, CAST(idx - off AS BIGINT) AS local FROM ix JOIN off ON idx >= off AND idx < off + size")
def locate_index(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    idx = b.table(spark, sf, "orders").crossJoin(F.broadcast(total)).select((F.col("o_orderkey") * 3 % F.col("n")).alias("idx")).distinct()
    return ds.locate(idx, ds.shard_offsets(lines.select(F.col("l_suppkey").alias("shard"))))


@query("s06_gather", f"""WITH {SHARDS}, o AS (SELECT *, row_number() OVER (ORDER BY shard, id) - 1 AS idx FROM sh),
ix AS (SELECT DISTINCT o_orderkey * 7 % (SELECT count(*) FROM embeddings) AS idx FROM orders) SELECT idx, id, d, shard FROM o JOIN ix USING (idx)""")
def gather(spark, sf):
    dataset = ds.assign_shards(curves(spark, sf).drop("view"), "id", 100)
    total = dataset.agg(F.count(F.lit(1)).alias("n"))
    idx = b.table(spark, sf, "orders").crossJoin(F.broadcast(total)).select((F.col("o_orderkey") * 7 % F.col("n")).alias("idx")).distinct()
    return ds.gather(dataset, idx, "id").select("idx", "id", "d", "shard")


CONFIG = {"gap_fraction": 0.08, "dilution_fraction": 0.0, "density_prior": True, "detrend": True, "real_noise": False, "n_global": 2001}


@query("s07_dataset_metadata", f"""SELECT count(*) AS n_rows, CAST(ceil(count(*) / 1e2) AS BIGINT) AS n_shards, 7::BIGINT AS seed, 99998::BIGINT AS eval_seed,
 '{hashlib.sha256(ds.canonical_json(CONFIG).encode()).hexdigest()}' AS config_sha256, true AS gap_fraction, false AS dilution_fraction, true AS density_prior,
 true AS detrend, false AS real_noise FROM embeddings""")
def dataset_metadata(spark, sf):
    return ds.dataset_metadata(b.table(spark, sf, "embeddings"), CONFIG, 7, 100)


@query("s07_file_hashes")
def file_hashes(spark, sf):
    return files.file_hashes(spark, f"{sf}/*.parquet").drop("path")


@query("s07_known_file_hashes", """WITH f AS (SELECT n_regionkey AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS content FROM nation GROUP BY 1
 UNION ALL SELECT 100 + user_id % 4, string_agg(user_id || ' ' || event_id || ' ' || event_type, chr(10) ORDER BY event_id) || chr(10) FROM events GROUP BY 1)
SELECT region, octet_length(encode(content)) AS length, sha256(content) AS sha256 FROM f""")
def known_file_hashes(spark, sf):
    """One text file for each region and for a quarter of the events each, written in order and hashed where it lies."""
    path = ds.scratch(spark, "texts")
    names = b.table(spark, sf, "nation").select(F.col("n_regionkey").cast("int").alias("region"), F.lit(0).cast("long").alias("at"), F.col("n_name").alias("value"))
    events = b.table(spark, sf, "events")
    line = F.concat_ws(" ", "user_id", "event_id", "event_type").alias("value")
    lines = names.unionByName(events.select((100 + F.col("user_id") % 4).cast("int").alias("region"), F.col("event_id").cast("long").alias("at"), line))
    lines.repartition("region").sortWithinPartitions("region", "at", "value").select("region", "value").write.partitionBy("region").text(path)
    found = files.file_hashes(spark, f"{path}/region=*")
    return found.select(F.regexp_extract("path", r"region=(\d+)", 1).cast("int").alias("region"), "length", "sha256")


STATUS = """ex AS (SELECT s_suppkey AS shard, 595::BIGINT AS expected FROM supplier WHERE s_suppkey % 10 <> 9),
fd AS (SELECT l_suppkey AS shard, count(*) AS rows FROM lineitem GROUP BY 1),
st AS (SELECT coalesce(ex.shard, fd.shard) AS shard, coalesce(rows, 0) AS rows, coalesce(expected, 0) AS expected,
       coalesce(rows, 0) >= coalesce(expected, 0) AS complete, expected IS NULL AS extra FROM ex FULL JOIN fd ON ex.shard = fd.shard)"""


def status(spark, sf):
    want = b.table(spark, sf, "supplier").filter("s_suppkey % 10 <> 9").select(
        F.col("s_suppkey").alias("shard"), F.lit(595).cast("long").alias("expected"))
    return ds.shard_status(b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shard")), want)


@query("s08_shard_status", f"WITH {STATUS} SELECT * FROM st")
def shard_status(spark, sf):
    return status(spark, sf)


@query("s08_manifest", f"""WITH {STATUS} SELECT count(*) FILTER (complete AND NOT extra) AS complete_shards, count(*) FILTER (extra) AS supplement_shards,
 count(*) FILTER (NOT complete) AS bad_shards, sum(rows)::BIGINT AS rows, {r('100e0 * count(*) FILTER (complete AND NOT extra) / count(*) FILTER (NOT extra)')} AS percent FROM st""")
def manifest(spark, sf):
    return rounded(ds.manifest(status(spark, sf)), "percent")


LOG_SCHEMA = "run long, step long, total double"


@query("s09_read_run_log", "SELECT user_id AS run, event_id AS step, value AS total FROM events ORDER BY event_id DESC LIMIT 400")
def read_run_log(spark, sf):
    path = ds.scratch(spark, "log")
    rows = b.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("total"))
    broken = rows.filter("step % 50 = 0").select(F.lit('{"run": 1, "step"').alias("value"))
    lines = rows.select(F.to_json(F.struct("run", "step", "total")).alias("value")).unionByName(broken)
    lines.write.text(path)
    return files.read_log_tail(spark, path, LOG_SCHEMA, 400, "step")


@query("s10_read_reports", """WITH a AS (SELECT s_suppkey AS name, s_acctbal AS score FROM supplier WHERE s_nationkey % 2 = 0), c AS (SELECT s_suppkey AS name, -s_acctbal AS score FROM supplier)
SELECT name, 0 AS source, score FROM a UNION ALL SELECT name, 1, score FROM c WHERE name NOT IN (SELECT name FROM a)""")
def read_reports(spark, sf):
    suppliers = b.table(spark, sf, "supplier")
    first, second = ds.scratch(spark, "reports"), ds.scratch(spark, "reports")
    ds.write_report(suppliers.filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("name"), F.col("s_acctbal").alias("score")), first)
    ds.write_report(suppliers.select(F.col("s_suppkey").alias("name"), (-F.col("s_acctbal")).alias("score")), second)
    return ds.read_reports(spark, [first, second], "name long, score double", "name")


@query("s10_nested_reports", f"""WITH a AS (SELECT s_nationkey AS name, count(*) AS n, avg(s_acctbal) AS mean FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1),
c AS (SELECT s_nationkey AS name, -count(*) AS n, avg(-s_acctbal) AS mean FROM supplier GROUP BY 1)
SELECT name, 1 AS source, n, {r('mean')} AS mean FROM a UNION ALL SELECT name, 2, n, {r('mean')} FROM c WHERE name NOT IN (SELECT name FROM a)""")
def nested_reports(spark, sf):
    """Indented reports, one file each, found by globs; the first candidate place does not exist."""
    places = [ds.scratch(spark, "nested") for _ in range(3)]
    for sign, place in ((1, places[1]), (-1, places[2])):
        rows = b.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean"))
        rows = rows.filter("name % 2 = 0") if sign > 0 else rows
        detection = F.struct((sign * F.col("n")).alias("n"), (sign * F.col("mean")).alias("mean"))
        text = rows.select(F.to_json(F.struct("name", F.struct(detection.alias("detection")).alias("summary")), {"pretty": "true"}).alias("value"))
        text.write.option("maxRecordsPerFile", 1).text(place)
    schema = "name int, summary struct<detection: struct<n: bigint, mean: double>>"
    found = ds.read_reports(spark, [f"{p}/part-*" for p in places], schema, "name", multi_line=True)
    return rounded(found.select("name", "source", "summary.detection.n", "summary.detection.mean"), "mean")


@query("s11_write_report", f"""SELECT s_nationkey AS nation, count(*) AS n, {r('avg(s_acctbal)')} AS mean_score FROM supplier GROUP BY 1""")
def write_report(spark, sf):
    path = ds.scratch(spark, "report")
    stats = b.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean_score"))
    ds.write_report(stats.select("nation", F.struct("n", "mean_score").alias("detection")), path)
    back = spark.read.schema("nation int, detection struct<n: bigint, mean_score: double>").json(path)
    return rounded(back.select("nation", "detection.n", "detection.mean_score"), "mean_score")
