"""Helpers that several operators share: input columns, scratch folders, batch sizes, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.session import ensure_checkpoint_dir

BATCH_ROWS = 256
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, under fixed types; other columns never clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(docs: DataFrame) -> DataFrame:
    """`texts` and a hash of the text: with doc_id it finds a row again, even where rows share an id."""
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def carried(docs: DataFrame) -> DataFrame:
    """`text_key` with the other columns of the row as the struct `row`: they pass through an operator instead of being joined again."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), F.struct(*rest).alias("row"))


def restored(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the table that `carried` read, from a result that has its `text` and `row`."""
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])


def same_row(docs: DataFrame, found: DataFrame) -> Column:
    """Join condition of rows of `docs` and of an operator's result that carries doc_id and text_key; nulls match."""
    return docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["text_key"])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: a batch of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks: one thing, made anew when another one is asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """For tasks that keep nothing: workers are shared by all operators."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage: written once to the shared checkpoint folder, read by everything that follows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge list (a, b); component is its smallest reachable node.

    Each round moves every node to the smallest of its neighbours, follows that step once more, and contracts
    the edges onto the results, so that the edge list shrinks until none is left. The smallest node of a
    component never moves, so it ends as everyone's label. Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = shared(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    while not edges.isEmpty():
        near = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        step = near.groupBy(F.col("e.a").alias("a")).agg(F.least(F.col("a"), F.min("e.b")).alias("to"))
        onward = step.select(F.col("a").alias("to"), F.col("to").alias("end"))
        moves = shared(step.join(onward, "to").select("a", F.col("end").alias("to")))
        labels = labels.join(moves.select(F.col("a").alias("component"), "to"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
        moved = edges.join(moves.withColumnRenamed("to", "x"), "a").select("b", "x")
        moved = moved.join(moves.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").filter("x != y")
        edges = shared(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        labels = shared(labels)
    return labels
