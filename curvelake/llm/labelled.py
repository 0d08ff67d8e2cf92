"""Labelled rows to learn from: a bounded sample that keeps one fifth of the documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm.common import texts

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learnt from; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, text, label (0 or 1) of labelled documents outside the held-out fifth: the first `bound` by hash of doc_id whose whole
    texts together have `most_bytes` at most. No row of more than a sixteenth of that is taken.

    Labels that are null or neither 0 nor 1 are left out; of several labels of one document the largest counts,
    of several rows of it the one with the largest text. Labels without a document take no place.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    marks = marks.filter(~held_out(F.col("doc_id"))).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most `bound` pairs of numbers.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    # At most `bound` lengths.
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    fits = rows.select("doc_id", F.octet_length("text").alias("n")).filter(F.col("n") <= most_bytes // 16).withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= most_bytes)
    return rows.join(F.broadcast(fits.select("doc_id")), "doc_id")
