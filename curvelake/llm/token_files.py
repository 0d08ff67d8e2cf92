"""Token ids as Parquet files: one row per document, in ascending doc_id order over all files.

Columns: doc_id, part (number of the file's range), local_start (ids before the document in its part), n_tokens, and
tokens, a list of ids with the end id last. Token ids are dictionary-encoded, the sorted integers delta-encoded
(format version 2). Row groups and pages are kept small, and every column has statistics and a page index, so a
reader can take a doc_id range or the metadata columns alone without touching the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm.common import small_batches, texts
from curvelake.llm.tokens import default_vocabulary, encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Pieces of text a worker remembers the ids of, twice over.
REMEMBERED = 700_000


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text of `docs` and write the files.

    Documents are dealt by ranges of doc_id and sorted in each range, null ids first, rows with one id by text. Null
    and empty texts have the end id alone; repeated rows are written as often as they occur. An empty table
    gives a folder without rows.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path, REMEMBERED), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [x + end for x in encode(batch.column(1).to_pylist())]
            sizes = [len(x) // 4 for x in ids]
            bounds = list(accumulate(sizes, initial=0))
            starts = pa.array(np.array(bounds[:-1], np.int64) + before)
            before += bounds[-1]
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), starts, pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)],
                ["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )

    sorted_docs = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted_docs.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens int, tokens array<int>")
    writer = rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("parquet.writer.version", "PARQUET_2_0")
    for key, value in {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows}.items():
        writer = writer.option(key, str(value))
    for column in ("doc_id", "local_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.enable.dictionary#tokens.list.element", "true").parquet(folder)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, part, local_start; token pages are not read."""
    rows = spark.read.parquet(folder).select("doc_id", "part", "local_start", "n_tokens")
    return rows.join(F.broadcast(_offsets(spark, folder)), "part").select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "part", "local_start"
    )


def _offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Ids before each part: one row per part, a number that partitioning bounds, not the data."""
    totals = spark.read.parquet(folder).groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    return totals.selectExpr("part", "coalesce(sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset")


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens; with bounds only the row groups and pages of that doc_id range are read."""
    rows = spark.read.parquet(folder)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.join(F.broadcast(_offsets(spark, folder)), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of `read_tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes())
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
