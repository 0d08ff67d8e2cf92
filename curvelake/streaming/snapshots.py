"""A table of one row per key in hash buckets, changed by copy-on-write.

A change rewrites the buckets it has keys in, each into a folder of that change, and leaves the others where they are. Then a
marker file is published that says in which change's folder every bucket lies: readers see the version before or the one
after, never half of one. The marker of change n starts from that of change n - 1, whatever may lie there of an earlier attempt
at n, so a replayed change gives the same table. Folders that neither of the last two markers names are removed: a reader that has
just opened the version before can finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.session import ensure_checkpoint_dir


class _Store:
    """The file system of a path, by Spark's own configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.at(folder)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))]

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Under its name only once it is whole."""
        stream = self.fs.create(self.at(f"{name}.tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(self.at(f"{name}.tmp"), self.at(name)):
            raise OSError(f"cannot publish {name}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _versions(store: _Store) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in store.names("versions") if n.endswith(".json"))


def _marker(store: _Store, number: int) -> dict:
    return json.loads(store.text(f"versions/{number}.json"))


def _rows(spark: SparkSession, store: _Store, marker: dict, buckets: list[str]) -> DataFrame | None:
    places = [f"{store.root}/change={marker['at'][k]}/bucket={k}" for k in buckets if k in marker["at"]]
    return spark.read.schema(marker["schema"]).parquet(*places) if places else None


def update(changes: DataFrame, path: str, number: int, key: str, buckets: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Merge the rows of change `number` into the table: `merge(rows of the touched buckets, changes)` gives their new rows.

    Where the touched buckets have no rows yet, `merge` gets None for them.
    """
    spark = changes.sparkSession
    store = _Store(spark, path)
    earlier = [n for n in _versions(store) if n < number]
    marker = _marker(store, earlier[-1]) if earlier else {"at": {}, "schema": None, "buckets": buckets}
    count = marker["buckets"]
    place = F.pmod(F.hash(key), F.lit(count)).cast("string")
    # A micro-batch is read several times; it is kept in the shared checkpoint folder meanwhile.
    ensure_checkpoint_dir(spark)
    changes = changes.checkpoint()
    # At most one row for each bucket.
    touched = sorted(r[0] for r in changes.select(place.alias("bucket")).distinct().collect())
    fresh = merge(_rows(spark, store, marker, touched), changes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
    # One task for each bucket at least; more files where a bucket is large are the writer's affair.
    fresh.withColumn("bucket", place).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store.root}/change={number}")
    filled = {n.removeprefix("bucket=") for n in store.names(f"change={number}") if n.startswith("bucket=")}
    at = {k: n for k, n in marker["at"].items() if k not in touched} | {k: number for k in filled}
    store.publish(f"versions/{number}.json", json.dumps({"at": at, "schema": schema, "buckets": count}))
    kept = [n for n in (*earlier[-1:], number)]
    named = {f"change={n}" for v in kept for n in _marker(store, v)["at"].values()}
    for n in [v for v in earlier if v not in kept]:
        store.remove(f"versions/{n}.json")
    for folder in store.names(""):
        if folder.startswith("change=") and folder not in named:
            store.remove(folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version."""
    store = _Store(spark, path)
    marker = _marker(store, _versions(store)[-1])
    rows = _rows(spark, store, marker, sorted(marker["at"]))
    return rows if rows is not None else spark.createDataFrame([], marker["schema"])
