"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function turns a document into a set of shingle hashes; its k smallest values are its sketch.

1. Documents with equal sets form one class and are represented by their smallest doc_id.
2. Inverted lists map each retained value to the sketches that hold it. Two sketches of sets that are similar
   enough share a known number of values, up to a chance below EPS, so it suffices to list each sketch under
   its rarest values: two of them that overlap that much then meet in at least one list. A passage shared by
   very many documents is among the most frequent values and so drops out of the lists by itself.
3. Lists tie documents into clusters (every member to the smallest of its list). A cluster is cut by set size and by
   hash into blocks of bounded weight; each pair of blocks whose sizes allow a link is one small group of work.
4. In a group the union of two sketches estimates the similarity; pairs that may reach the threshold are
   confirmed on their full sets. A group returns a spanning forest of its links, never all pairs.
5. Connected components of those links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm.common import connected, release, shared, small_batches, text_key, texts

SHINGLE = 5
SKETCH = 64
EPS = 1e-9
BLOCK_DOCS = 128
BLOCK_VALUES = 1 << 20
#: Odd multipliers of the word positions in a shingle, and those of the mixer: arbitrary but fixed.
POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(raw: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z is lower-cased, words end at ASCII white space."""
    words = [t.lower().split() if t else [] for t in raw]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64) * POSITION[0]) | np.uint64(1)
    rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for i in range(size if len(rolled) else 0):
        rolled += h[i : i + len(rolled)] * weights[i]
    rolled = mixed(rolled)
    sets, start = [], 0
    for n in counts.tolist():
        if n >= size:
            values = np.unique(rolled[start : start + n - size + 1].view(np.int64))
        elif n:
            short = (h[start : start + n] * weights[:n]).sum(dtype=np.uint64, keepdims=True) + POSITION[n : n + 1]
            values = mixed(short).view(np.int64)
        else:
            values = np.zeros(0, np.int64)
        sets.append(values)
        start += n
    return sets


def least_shared(k: int, threshold: float) -> int:
    """Shared values among the k smallest of a union that a pair at the threshold misses with a chance below EPS."""
    below = 0.0
    for x in range(k + 1):
        below += comb(k, x) * threshold**x * (1 - threshold) ** (k - x)
        if below > EPS:
            return x
    return k


def sketches(docs: DataFrame, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets, null for empty ones), sketch (the k smallest values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            heads = [s[:k] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in heads])]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), n, pa.array(keys, pa.binary()), sketch], ["doc_id", "text_key", "n_shingles", "set_key", "sketch"]
            )

    return text_key(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, sketch array<long>")


def clusters(reps: DataFrame, threshold: float, k: int = SKETCH) -> DataFrame:
    """(node, component): documents tied through the inverted lists of their rarest retained values."""
    postings = reps.select(F.col("doc_id").alias("doc"), F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    frequent = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    need = np.vectorize(lambda n: ceil(threshold * n - 1e-9) if n <= threshold * k else least_shared(int(n), threshold))(np.arange(1, k + 1))
    listed = postings.join(frequent, "value").groupBy("doc").agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    spare = F.element_at(F.array(*[F.lit(int(n + 1 - m)) for n, m in enumerate(need)]), F.col("k")) + 1 - (F.col("k") - F.size("held"))
    entries = listed.filter(spare > 0).select("doc", F.explode(F.slice("held", F.lit(1), spare)).alias("h")).select("doc", F.col("h.value").alias("value"))
    entries = shared(entries)
    pivots = entries.groupBy("value").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    return connected(entries.join(pivots, "value").select(F.col("doc").alias("a"), F.col("pivot").alias("b")))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections among the few sets of one group."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], (np.cumsum(count > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    step = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        part = np.zeros((len(sets), step), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total


def possible(sets: list[np.ndarray], least: np.ndarray, k: int) -> np.ndarray:
    """Which pairs the union of their sketches allows: enough of its smallest values lie in both."""
    heads = [s[:k] for s in sets]
    ends = np.array([s[k - 1] if len(s) > k else np.iinfo(np.int64).max for s in sets])
    limit = np.minimum(ends[:, None], ends[None, :])
    seen = np.stack([np.searchsorted(h, limit[i], "right") for i, h in enumerate(heads)])
    both = overlaps(heads)
    union = (seen + seen.T - both).astype(np.int64)
    return both >= least[np.clip(union, 0, len(least) - 1)]


def links(docs: np.ndarray, sets: list[np.ndarray], percent: int, k: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    least = np.array([least_shared(n, percent / 100) for n in range(2 * k + 1)])
    pairs = np.triu(possible(sets, least, k), 1)
    rows = np.unique(np.nonzero(pairs | pairs.T)[0])
    if not len(rows):
        return []
    chosen, size = [sets[i] for i in rows], np.array([len(sets[i]) for i in rows])
    both = overlaps(chosen)
    linked = pairs[np.ix_(rows, rows)] & (100 * both >= percent * (size[:, None] + size[None, :] - both))
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for x, y in np.argwhere(linked).tolist():
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            forest.append((int(docs[rows[x]]), int(docs[rows[y]])))
    return forest


def verified(docs: DataFrame, found: DataFrame, sizes: DataFrame, percent: int, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """Edges (a, b) between documents of one cluster, confirmed on full sets, as forests of small groups."""
    threshold = percent / 100
    width = -log(threshold)
    members = shared(found.join(sizes, found.node == sizes.doc_id).select(
        "doc_id", F.col("component").alias("cluster"), "n_shingles", F.floor(F.log("n_shingles") / width).cast("int").alias("band")
    ))
    parts = members.groupBy("cluster", "band").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_VALUES)).cast("int").alias("parts")
    )
    above = parts.select("cluster", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    below = parts.select("cluster", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    placed = members.join(parts.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left"), ["cluster", "band"])
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    placed = placed.select("doc_id", "cluster", "band", own.alias("own"), "parts", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))

    def numbers(n: str) -> F.Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda i: i < F.col(n))

    def group(gap: int, band: F.Column, lower: F.Column, upper: F.Column) -> F.Column:
        return F.struct(F.lit(gap).alias("gap"), band.alias("low"), lower.cast("int").alias("lower"), upper.cast("int").alias("upper"))

    band, mine = F.col("band"), F.col("own")
    work = F.concat(
        F.transform(numbers("parts"), lambda i: group(0, band, F.least(mine, i), F.greatest(mine, i))),
        F.transform(numbers("above"), lambda i: group(1, band, mine, i)),
        F.transform(numbers("below"), lambda i: group(1, band - 1, i, mine)),
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            values = pa.array([s.tobytes() for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), size)], pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), values.cast(pa.binary())], ["doc_id", "values"])

    ids = placed.select("doc_id")
    # Equal sets keep only their representative, so a doc_id repeated in the input is taken once.
    full = texts(docs).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(sets, "doc_id long, values binary")
    tasks = placed.select("doc_id", "cluster", F.explode(work).alias("g")).select("doc_id", "cluster", "g.*")
    key = ["cluster", "gap", "low", "lower", "upper"]
    dealt = tasks.join(full, "doc_id").repartition(*key).sortWithinPartitions(*key).select(*key, "doc_id", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []

        def flush() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            return links(np.array([h[-2] for h in held]), [np.frombuffer(h[-1], np.int64) for h in held], percent, k)

        for batch in batches:
            edges: list[tuple[int, int]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][:5] != row[:5]:
                    edges += flush()
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])
        edges = flush()
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for every row of `docs` (doc_id, text, anything else).

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of `size`-word shingles. A
    document with fewer words has its whole sequence as its one shingle; null, empty and blank texts have none and
    are linked with nothing. component_id is the smallest doc_id reachable over links, the row's own included; kept is
    doc_id = component_id. Repeated rows come out as often as they came in, alike. A null doc_id is linked with
    nothing: component_id null, kept true. Empty in, empty out.
    """
    small_batches(docs.sparkSession)
    every = shared(sketches(docs, size, k))
    known = every.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = shared(every.drop("sketch").join(classes, "set_key", "left").select(
        "doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("rep", "doc_id")).alias("rep")
    ))
    ids = members.filter("doc_id = rep AND n_shingles > 0").select("doc_id").distinct()
    reps = every.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    found = clusters(reps.select("doc_id", "sketch"), percent / 100, k)
    sizes = members.filter("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    edges = verified(docs, found, sizes, percent, size, k)
    joined = connected(edges).withColumnRenamed("node", "rep")
    return members.join(joined, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "rep")).alias("kept"), "text_key",
    )
