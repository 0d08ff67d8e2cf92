"""Prefix trie of conversations by collapsing whole sequences.

Identical conversations become one weighted sequence first: the trie is built from distinct sequences only, each with the number
of conversations that end in it, their smallest id and the digest of their ids. A sequence that is a proper prefix of
another one is not a leaf; an anti-join of the ends against all shorter prefixes finds that. Then the prefixes of the
sequences are aggregated with their weights: one row for each node.

A prefix is known by 128 bits: each turn gives four 32-bit numbers, hashed from its place, role and text, and
the sums over the first d turns, modulo 2^32, name the prefix of d turns. Sums are made in ranges of (conversation, place), so a
conversation that holds a third of all turns lies in many tasks; so do the joins to it.

What a subtree saves is added up without a join over its paths: every node is owned by the leaf with the smallest
conversation among those it leads to. A leaf's owned savings are summed from its end upwards, and the sums of all
leaves of a node are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.llm.common import release, shared
from curvelake.operators.grouped import join_groups, positions, running

GROUP = 100
HEADS = 6
#: Ids that are joined to one text before they reach the task that digests their group.
PIECE = 4096
PARTS = ("_0", "_1", "_2", "_3")
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n_rows, chars and a 128-bit hash of (role, text) of each turn: by number, null first; ties by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return positions(rows, ["conv_id"], order).select(
        "conv_id", "pos", "n_rows", F.length("text").cast("long").alias("chars"),
        *[F.xxhash64(F.lit(salt), "role", "text").alias(name) for salt, name in ((1, "turn_a"), (2, "turn_b"))],
    )


def shared_heads(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations from ordered turns: the first h turns of conversation c - c % GROUP, then c's own from turn h on.

    h is crc32(c) % HEADS; pos and n_rows give way to depth, from 1. A conversation that ends up without turns has no row.
    """
    rest = [c for c in turns.columns if c not in ("conv_id", "pos", "n_rows")]
    one = turns.filter("pos = 0").select("conv_id", "n_rows", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).alias("_h"))
    one = one.withColumn("_base", F.col("conv_id") - F.col("conv_id") % GROUP)
    # One row for each GROUP conversations, and at most HEADS - 1 turns of it.
    base = one.filter("conv_id = _base").select("_base", F.col("n_rows").alias("_n"))
    first = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "_base")
    taken = one.select("conv_id", "_base", "_h").join(first, "_base").filter("pos < _h").select("conv_id", (F.col("pos") + 1).alias("depth"), *rest)
    # Where the base has fewer than h turns, the conversation's own follow on at once.
    plan = one.join(base, "_base", "left").select("conv_id", "_h", F.least("_h", F.coalesce("_n", F.lit(0))).alias("_taken"))
    own = join_groups(turns, plan, ["conv_id"]).filter("pos >= _h")
    return taken.unionByName(own.select("conv_id", (F.col("pos") + 1 - F.col("_h") + F.col("_taken")).alias("depth"), *rest))


def _name() -> list[Column]:
    """Two longs for the four sums modulo 2^32."""
    low = [F.pmod(F.col(p), F.lit(1 << 32)) for p in PARTS]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("name_a"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("name_b")]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, name_a, name_b, n_turns) for every turn: the name of all turns up to it."""
    wide = [F.xxhash64("depth", "turn_a", "turn_b"), F.xxhash64("turn_b", "turn_a", "depth")]
    parts = [f(w) for w in wide for f in (lambda w: w.bitwiseAND(0xFFFFFFFF), lambda w: F.shiftrightunsigned(w, 32))]
    rows = turns.select("conv_id", "depth", "chars", *[p.alias(f"_h{i}") for i, p in enumerate(parts)])
    sums = running(rows, ["conv_id"], [F.col("depth").asc()], {p: F.col(f"_h{i}") for i, p in enumerate(PARTS)}, totals={"n_turns": F.lit(1).cast("long")})
    return sums.select("conv_id", "depth", "chars", "n_turns", *_name())


def end_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, ends_sha256): the digest of the ascending conv_ids of a group, joined by commas.

    Ids are numbered in their group, PIECE of them are joined at a time, and the pieces reach the digest one after the other: a task
    holds one piece, however many ids the group has.
    """
    numbered = positions(ends.select(*keys, "conv_id"), keys, [F.col("conv_id").asc()])
    pieces = numbered.groupBy(*keys, F.floor(F.col("pos") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    pieces = pieces.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "ids")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        current, running_hash, out = None, None, []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(len(keys))], batch.column(len(keys))):
                key, ids = row[:-1], row[-1].as_py().encode()
                if key == current:
                    running_hash.update(b"," + ids)
                else:
                    if current is not None:
                        out.append((*current, running_hash.hexdigest()))
                    current, running_hash = key, hashlib.sha256(ids)
            if out:
                yield written(out)
                out = []
        if current is not None:
            yield written([(*current, running_hash.hexdigest())])

    def written(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*rows))[:-1]], pa.array([r[-1] for r in rows], pa.string())], names=[*keys, "ends_sha256"])

    return pieces.mapInArrow(digested, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row for each distinct sequence of first turns, the empty one (the root) included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A turn is its role and
    text, null as ''; turns go by number, null first, ties by role and text. With `rebuild` conversations get the shared
    heads of `shared_heads` first. Rows without conv_id are left out; repeated rows are turns of their own; other columns are not read. An
    empty table has no member and so no node. Two different prefixes share a name with a chance below 1e-20 for a billion nodes.
    """
    turns = shared(ordered_turns(conversations))
    members = turns.filter("pos = 0").select("conv_id")
    rebuilt = shared_heads(turns) if rebuild else turns.withColumn("depth", F.col("pos") + 1)
    key = ["depth", "name_a", "name_b"]
    zero = F.lit(0).cast("long")
    paths = shared(prefixes(rebuilt))

    # Whole sequences, those without a turn included.
    last = paths.filter("depth = n_turns").select("conv_id", *key)
    ends = shared(members.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(k, zero).alias(k) for k in key]))
    sequences = ends.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"))
    shorter = paths.filter("depth < n_turns").select(*key).unionByName(paths.filter("depth = 1").select(*[zero.alias(k) for k in key])).distinct()
    leaves = sequences.join(shorter, key, "left_anti").select("conv_id", F.lit(True).alias("is_leaf"))
    weights = shared(sequences.select("conv_id", "weight").join(leaves, "conv_id", "left").select("conv_id", "weight", F.coalesce("is_leaf", F.lit(False)).alias("is_leaf")))

    # The prefixes of one conversation for each sequence, from the root to its end.
    steps = join_groups(paths.select("conv_id", "depth", "chars", "name_a", "name_b"), weights, ["conv_id"])
    roots = weights.select("conv_id", zero.alias("depth"), zero.alias("chars"), zero.alias("name_a"), zero.alias("name_b"), "weight", "is_leaf")
    steps = shared(steps.select(*roots.columns).unionByName(roots))
    nodes = shared(steps.groupBy(*key).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.count_if("is_leaf").alias("n_leaves"), F.min(F.when(F.col("is_leaf"), F.col("conv_id"))).alias("owner"),
    ))

    # Savings: each node with its owner, summed from the leaf upwards, then over the leaves of a node.
    gain = nodes.select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("gain"))
    on_leaves = steps.filter("is_leaf").select("conv_id", *key).join(gain, ["conv_id", "depth"], "left")
    upward = running(on_leaves, ["conv_id"], [F.col("depth").desc()], {"saved": F.coalesce("gain", zero)})
    saved = upward.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"))

    # A node's parent is the step before it in the conversation that names it; that conversation is a member of both.
    up = steps.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("depth").alias("up_depth"), F.col("name_a").alias("up_a"), F.col("name_b").alias("up_b"))
    child = nodes.filter("depth > 0").select("conv_id", *key).join(up, ["conv_id", "depth"])
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("name_a").alias("up_a"), F.col("name_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    parent = join_groups(child, parents, ["up_depth", "up_a", "up_b"]).select(*key, "parent_conv_id", "up_depth", "up_a", "up_b")
    parent = shared(parent)
    children = parent.groupBy(F.col("up_depth").alias("depth"), F.col("up_a").alias("name_a"), F.col("up_b").alias("name_b")).agg(F.count(F.lit(1)).alias("n_children"))
    digests = end_digests(ends, key)
    out = nodes.join(saved, key, "left").join(parent.select(*key, "parent_conv_id"), key, "left").join(children, key, "left").join(digests, key, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )
