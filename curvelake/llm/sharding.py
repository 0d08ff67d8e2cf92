"""Shards of nearly equal bytes: a minimax contiguous partition of ordered atoms.

Equal texts must share a shard. An atom holds the texts whose md5 starts with the same four hexadecimal
digits: 65,536 atoms at any size of the table, in order of those digits. The smallest capacity that lets the
atoms fall into the wanted number of contiguous shards is found by binary search, checking each one
greedily, and the atoms are cut there. An atom is 1/4096 of a 16th, so shards differ by less than that share, apart from
a text that is larger than a shard by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 16
ATOMS = 1 << 16
SLOT_CELLS = 1024


def atom_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def minimax(atoms: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(atom, size) rows, at most ATOMS of them, to (atom, shard, capacity): one row of one array does the search."""
    line = atoms.groupBy().agg(F.sort_array(F.collect_list(F.struct("atom", "size"))).alias("line"))
    line = line.withColumns({"sizes": F.col("line.size"), "total": F.aggregate("line.size", F.lit(0).cast("long"), lambda a, x: a + x)})
    line = line.filter(F.size("sizes") > 0).withColumn("least", F.greatest(F.array_max("sizes"), F.ceil(F.col("total") / shards)))

    def needed(capacity: Column) -> Column:
        return F.aggregate(
            "sizes", F.struct(F.lit(1).alias("used"), F.lit(0).cast("long").alias("fill")),
            lambda a, x: F.when(a["fill"] + x > capacity, F.struct((a["used"] + 1).alias("used"), x.alias("fill")))
            .otherwise(F.struct(a["used"].alias("used"), (a["fill"] + x).alias("fill"))),
            lambda a: a["used"],
        )

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2)
        return F.when(a["low"] >= a["high"], a).otherwise(
            F.when(needed(middle) <= shards, F.struct(a["low"].alias("low"), middle.alias("high")))
            .otherwise(F.struct((middle + 1).alias("low"), a["high"].alias("high")))
        )

    # A greedy cut at twice the least capacity always fits, so at most 64 halvings of [least, 2 * least] do.
    found = line.withColumn("capacity", F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), F.struct(F.col("least").alias("low"), (2 * F.col("least")).alias("high")), halve, lambda a: a["high"],
    ))

    def cut(even: bool) -> Column:
        """The shard of each atom: full at the capacity; if `even`, also once it has its part of what is left."""
        def step(a: Column, x: Column) -> Column:
            full = a["fill"] + x > F.col("capacity")
            if even:
                full = full | ((a["fill"] > 0) & (a["shard"] < shards - 1) & (2 * a["fill"] + x > 2 * (a["rest"] + a["fill"]) / (shards - a["shard"])))
            return F.struct(
                F.when(full, a["shard"] + 1).otherwise(a["shard"]).alias("shard"), F.when(full, x).otherwise(a["fill"] + x).alias("fill"),
                (a["rest"] - x).alias("rest"), F.when(full, F.concat(a["ends"], F.array(a["at"]))).otherwise(a["ends"]).alias("ends"),
                (a["at"] + 1).alias("at"),
            )
        zero = F.struct(
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("fill"), F.col("total").alias("rest"),
            F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"),
        )
        return F.aggregate("sizes", zero, step, lambda a: a["ends"])

    found = found.withColumns({"even": cut(True), "greedy": cut(False)})
    found = found.withColumn("ends", F.when(F.size("even") < shards, F.col("even")).otherwise(F.col("greedy")))
    each = found.select("capacity", "ends", F.posexplode("line").alias("at", "a"))
    return each.select(F.col("a.atom").alias("atom"), F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"), "capacity")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`.

    size is the UTF-8 bytes of the text plus 1 (null: no bytes), text_crc32 that of the bytes. Slots number the rows of
    a shard from 0 without gaps, by hash cell and then doc_id. Null and empty texts are equal texts.
    Repeated rows take a slot each. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), atom_of(text).alias("atom"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_CELLS)).cast("int").alias("cell"),
    )
    atoms = rows.groupBy("atom").agg(F.sum("size").alias("size"))
    # At most ATOMS rows of a few bytes, and below at most shards * SLOT_CELLS rows.
    placed = rows.join(F.broadcast(minimax(atoms, shards).drop("capacity")), "atom").drop("atom")
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = cells.selectExpr("shard", "cell", "sum(n) OVER (PARTITION BY shard ORDER BY cell) - n AS first")
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, cell ORDER BY doc_id, text_crc32, size) - 1 AS at")
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot")
    )
