"""Files read in bounded pieces where they lie: digests of files of any size, and the tail of append-only logs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task holds of a file at a time.
PIECE = 8 << 20
#: Bytes of the first block that is read from the end of a log; later ones double up to a piece.
BLOCK = 64 << 10


def open_file(uri: str) -> pa.NativeFile:
    """A random-access file of a URI or path, on any store that Arrow knows."""
    if re.match(r"file:/*", uri):
        uri = "/" + re.sub(r"^file:/*", "", uri)
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def digest(uri: str, piece: int = PIECE) -> str:
    found = hashlib.sha256()
    with open_file(uri) as stream:
        while block := stream.read(piece):
            found.update(block)
    return found.hexdigest()


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """URI and length of the files of a path or glob, those of folders included, hidden ones left out."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in store.globStatus(place) or []:
        inside = store.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [(x.getPath().toString(), x.getLen()) for x in inside if x.isFile() and not re.match(r"[_.]", x.getPath().getName())]
    return sorted(found)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, length, SHA-256 and path of every file under a path or glob. Files are listed without their content; each is hashed
    in pieces by one task."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("sha256", pa.array([digest(p) for p in batch.column(0).to_pylist()], pa.string()))

    # Long and short files side by side in a task: by name, not by size.
    files = spark.createDataFrame(listed(spark, path), "path string, length long").repartition("path")
    found = files.mapInArrow(hashed, "path string, length long, sha256 string")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256", "path")


def backwards(stream: pa.NativeFile, block: int = BLOCK) -> Iterator[bytes]:
    """Lines from the last to the first. Only what is asked for is read, and one line and one block are held."""
    end, rest = stream.size(), b""
    while end > 0:
        start = max(0, end - block)
        stream.seek(start)
        lines = (stream.read(end - start) + rest).split(b"\n")
        rest, end, block = lines[0], start, min(2 * block, PIECE)
        yield from reversed(lines[1:])
    yield rest


def last_records(stream: pa.NativeFile, n: int, order: str) -> list[str]:
    """The last n lines that are JSON objects with a value under `order`, the last one first."""
    found: list[str] = []
    for line in backwards(stream):
        if len(found) == n:
            break
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict) and record.get(order) is not None:
            found.append(line.decode())
    return found


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class LogTail(DataSource):
    """Format `log_tail`: the last `n` records of each of the files (a JSON list of URIs), as lines."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(self.options)


class _TailReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.n, self.order = json.loads(options["files"]), int(options["n"]), options["order"]

    def partitions(self) -> list[_File]:
        return [_File(uri) for uri in self.files] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple[str]]:
        if partition.uri:
            with open_file(partition.uri) as stream:
                yield from ((line,) for line in last_records(stream, self.n, self.order))


def read_log_tail(spark: SparkSession, path: str, schema: str, n: int, order: str) -> DataFrame:
    """The n records with the highest `order` of append-only JSON-lines logs: a file, a folder or a glob.

    A file's records are in order, so only the end of each file is read: blocks from its last byte back until n records are
    found. Blank and broken lines are skipped.
    """
    spark.dataSource.register(LogTail)
    files = [uri for uri, _ in listed(spark, path)]
    lines = spark.read.format("log_tail").option("files", json.dumps(files)).option("n", n).option("order", order).load()
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*").filter(F.col(order).isNotNull())
    # The limit is the feature: a log tail, as a distributed top-k.
    return rows.orderBy(F.col(order).desc()).limit(n)
