"""Datasets on disk and run-log streams."""

import glob
import hashlib
import os
import random

from pyspark.sql import functions as F

from curvelake.operators import runlog as rl
from curvelake.sources import datasets as ds
from curvelake.sources import files
from curvelake.streaming import runs as st
from curvelake.streaming import snapshots


def test_dataset_is_resumable(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = spark.range(600).select("id", (F.col("id") % 2).alias("d"))
    ds.write_dataset(rows.filter("id < 500"), path, "id", 250)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/shard=*/*.parquet")}
    assert len(before) == 2
    ds.write_dataset(rows, path, "id", 250)
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/shard=*/*.parquet")}
    assert len(after) == 3 and all(after[f] == m for f, m in before.items())
    back = ds.read_dataset(spark, path, ["id"], {"dilution": "double"})
    assert back.count() == 600 and back.filter("dilution is not null").count() == 0
    assert [r["count"] for r in back.groupBy("shard").count().orderBy("shard").collect()] == [250, 250, 100]


def test_gather_and_batches(spark):
    rows = spark.range(1000).select("id", F.floor(F.col("id") / 300).alias("shard"))
    idx = spark.createDataFrame([(i,) for i in (0, 299, 300, 999, 601)], "idx long")
    got = {r["idx"]: (r["id"], r["shard"]) for r in ds.gather(rows, idx, "id").collect()}
    assert got == {i: (i, i // 300) for i in (0, 299, 300, 999, 601)}
    batches = ds.shuffled_batches(rows, 64, "id", 3)
    sizes = [r["count"] for r in batches.groupBy("batch_id").count().collect()]
    assert sizes == [64] * 15
    first = [r["id"] for r in batches.filter("batch_id = 0").orderBy("id").collect()]
    assert first == [r["id"] for r in ds.shuffled_batches(rows, 64, "id", 3).filter("batch_id = 0").orderBy("id").collect()]
    assert first != list(range(64))


def test_log_tail_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"step": 1, "total": 0.5}\n\n{"step": 2, "tot\n{"step": 3, "total": 0.25}\n')
    rows = files.read_log_tail(spark, str(path), "step long, total double", 5, "step").collect()
    assert [(r["step"], r["total"]) for r in rows] == [(3, 0.25), (1, 0.5)]


SCHEMA = "run long, ts timestamp, event_id long, total double, raw double"


def write_log(spark, path, rows):
    df = spark.createDataFrame(rows, "run long, s double, event_id long, total double")
    df.select("run", F.timestamp_seconds("s").alias("ts"), "event_id", "total", F.col("total").alias("raw")).coalesce(1).write.mode("append").json(path)


def test_streak_survives_a_restart(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    rows = [(1, float(i), i, None if i in (3, 4, 5, 6) else 1.0) for i in range(10)] + [(2, float(i), i, 1.0) for i in range(4)]
    for part in (rows[:5], rows[5:]):
        write_log(spark, log, part)
        st.upsert_streaks(st.read_log_stream(spark, log, SCHEMA), out, check, 4).awaitTermination()
    got = {r["run"]: r for r in st.read_snapshot(spark, out).collect()}
    assert got[1]["longest"] == 4 and got[1]["aborted"] and got[1]["streak"] == 0 and got[1]["last_step"] == 10
    assert got[2]["longest"] == 0 and not got[2]["aborted"]
    batch = rl.nonfinite_streak(spark.read.schema(SCHEMA).json(log).withColumn("step", F.col("event_id") + 1), 4)
    assert batch.agg(F.max("streak")).first()[0] == 4


def test_stall_alert(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    write_log(spark, log, [(1, 1000.0, 1, 1.0), (2, 1000.0, 2, 1.0), (2, 5000.0, 3, 1.0)])
    stream = st.read_log_stream(spark, log, SCHEMA)
    st.append_to(st.stall_alerts(stream, 180, "1 minute"), out, check).awaitTermination()
    assert [(r["run"], r["last_seen_ms"]) for r in spark.read.parquet(out).collect()] == [(1, 1_000_000)]


def test_health_verdicts(spark):
    rows = [(1, "cuda", 0.5, 0.1, 5.0, "running"), (2, "cpu", 0.5, 0.1, 5.0, "running"), (3, "cuda", None, 0.1, 5.0, "running"),
            (4, "cuda", 0.5, 0.5, 500.0, "running"), (5, "cuda", 0.5, 0.5, 5.0, "done")]
    latest = spark.createDataFrame(rows, "run long, device string, total double, data_wait_frac double, age_s double, status string")
    got = {r["run"]: (r["verdict"], r["warnings"]) for r in rl.health(latest, n_steps=60_000).collect()}
    assert got[1] == ("HEALTHY", []) and got[2] == ("WARN", ["CPU-LONG-RUN"]) and got[3][0] == "DIVERGED"
    assert got[4][0] == "STALLED" and got[5][0] == "DONE"


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, raw):
        self.raw, self.at, self.read_bytes = raw, 0, 0

    def size(self):
        return len(self.raw)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.read_bytes += n
        return self.raw[self.at : self.at + n]


def test_only_the_end_of_a_log_is_read():
    lines = [f'{{"step": {i}, "total": 0.5}}' for i in range(200_000)]
    lines[199_990] = '{"step": 1'
    lines[199_980] = ""
    log = Counted("\n".join([*lines, ""]).encode())
    found = files.last_records(log, 30, "step")
    assert found == [x for x in reversed(lines) if x.endswith("}")][:30] and log.read_bytes <= files.BLOCK
    everything = Counted("\n".join(lines).encode())
    assert len(files.last_records(everything, 10**6, "step")) == 199_998 and everything.read_bytes == len(everything.raw)
    long_line = Counted(('{"step": 1, "x": "' + "y" * 500_000 + '"}\n{"step": 2}').encode())
    assert len(files.last_records(long_line, 5, "step")) == 2 and files.last_records(Counted(b""), 5, "step") == []
    assert files.last_records(Counted(b'[1]\n7\n{"other": 1}\n{"step": null}\n'), 5, "step") == []


def test_log_tail_of_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(f'{{"step": {i}, "total": {i}.5}}\n' for i in range(k, 300, 3)))
    (tmp_path / "_SUCCESS").write_text('{"step": 999}')
    for place in (tmp_path, tmp_path / "part-*"):
        rows = files.read_log_tail(spark, str(place), "step long, total double", 7, "step").collect()
        assert [r["step"] for r in rows] == list(range(299, 292, -1)) and rows[0]["total"] == 299.5
    assert files.read_log_tail(spark, str(tmp_path / "none*"), "step long, total double", 7, "step").count() == 0


def test_hashes_of_files_of_any_size(spark, tmp_path):
    """A sparse file above 2 GiB, an empty one and one of several pieces."""
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "pieces").write_bytes(b"abc" * 7_000_000)
    with open(tmp_path / "large", "wb") as f:
        f.truncate((2 << 30) + 5)
    want = {"empty": hashlib.sha256(b"").hexdigest(), "pieces": hashlib.sha256(b"abc" * 7_000_000).hexdigest()}
    zeros = hashlib.sha256()
    for _ in range(256):
        zeros.update(bytes(8 << 20))
    zeros.update(bytes(5))
    want["large"] = zeros.hexdigest()
    got = {r["file"]: (r["length"], r["sha256"]) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in got.items()} == want and got["large"][0] == (2 << 30) + 5


def plain_streaks(bad, patience):
    streak = longest = 0
    for b in bad:
        streak = streak + 1 if b else 0
        longest = max(longest, streak)
    return len(bad), streak, longest, longest >= patience


def test_streaks_in_any_pieces(spark, tmp_path, ranges):
    """Random logs cut into batches at random places; one run holds most rows and lies in many ranges."""
    draw = random.Random(4)
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    runs = {r: [draw.random() < p for _ in range(n)] for r, (n, p) in enumerate([(400, 0.8), (30, 0.5), (1, 1.0), (25, 1.0), (12, 0.0)])}
    done = dict.fromkeys(runs, 0)
    for last in (False, False, True):
        rows = []
        for run, bad in runs.items():
            upto = len(bad) if last else draw.randint(done[run], len(bad))
            rows += [(run, float(i), i, None if bad[i] else 1.0) for i in range(done[run], upto)]
            done[run] = upto
        draw.shuffle(rows)
        write_log(spark, log, rows)
        st.upsert_streaks(st.read_log_stream(spark, log, SCHEMA), out, check, 9, buckets=3).awaitTermination()
    got = {r["run"]: (r["last_step"], r["streak"], r["longest"], r["aborted"]) for r in st.read_snapshot(spark, out).collect()}
    assert got == {run: plain_streaks(bad, 9) for run, bad in runs.items()}


def put(spark, path, number, rows):
    replace = lambda old, new: new if old is None else new.unionByName(old.join(new.select("run"), "run", "left_anti"))
    snapshots.update(spark.createDataFrame(rows, "run long, v string"), path, number, "run", 8, replace)


def table_of(spark, path):
    return {r["run"]: r["v"] for r in snapshots.read(spark, path).collect()}


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, [(i, "a") for i in range(100)])
    put(spark, path, 1, [(7, "b"), (1000, "b")])
    assert table_of(spark, path) == {**{i: "a" for i in range(100)}, 7: "b", 1000: "b"}
    assert 1 <= len(glob.glob(f"{path}/change=1/bucket=*")) <= 2 and len(glob.glob(f"{path}/change=0/bucket=*")) == 8


def test_snapshot_replay_and_reader(spark, tmp_path):
    """A change that failed before or after its marker and comes again; a reader that opened the version before."""
    path = str(tmp_path / "t")
    put(spark, path, 0, [(i, "a") for i in range(50)])
    reader = snapshots.read(spark, path)
    put(spark, path, 1, [(i, "b") for i in range(10)])
    put(spark, path, 1, [(i, "b") for i in range(10)])
    assert sum(r["v"] == "a" for r in reader.collect()) == 50
    assert sorted(table_of(spark, path).values()) == ["a"] * 40 + ["b"] * 10
    # Files of an attempt that never published are not seen, and are written over.
    spark.createDataFrame([(1, "lost")], "run long, v string").write.parquet(f"{path}/change=2/bucket=0")
    assert "lost" not in table_of(spark, path).values()
    put(spark, path, 2, [(3, "c")])
    assert table_of(spark, path)[3] == "c" and "lost" not in table_of(spark, path).values()
    for n in range(3, 7):
        put(spark, path, n, [(i, f"v{n}") for i in range(50)])
    assert set(table_of(spark, path).values()) == {"v6"}
    assert sorted(os.listdir(f"{path}/versions")) == ["5.json", "6.json"] or {x for x in os.listdir(f"{path}/versions") if x.endswith("json") and x[0] != "."} == {"5.json", "6.json"}
    assert len(glob.glob(f"{path}/change=*")) == 2


def test_snapshot_keeps_a_run_without_a_name(spark, tmp_path):
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    for k in range(2):
        write_log(spark, log, [(None, float(k), k, 1.0), (1, float(k), k, 1.0)])
        st.snapshot_upsert(st.latest_status(st.read_log_stream(spark, log, SCHEMA)), out, check).awaitTermination()
    assert sorted((r["run"] is None, r["records"]) for r in st.read_snapshot(spark, out).collect()) == [(False, 2), (True, 2)]
