"""Benchmark passages in documents: one Aho-Corasick automaton over the windows of all items.

The automaton works on words, not on characters: every benchmark word has a number, every other word of a text is 0.
A text is scanned once; the word positions of its matches are mapped back to character offsets of the original.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelake.llm.common import carried, kept, restored, small_batches, text_key

WINDOW = 13
PERCENT = 5
#: Benchmark text that one automaton takes; a larger benchmark is scanned for in several parts of this size.
BLOCK_CHARS = 16 << 20
#: Bytes that are part of words after A-Z are lower-cased: digits, letters and all of non-ASCII characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLANKED = bytes(b if WORD.match(bytes([b])) else 32 for b in range(256))


def words(raw: bytes | None) -> list[bytes]:
    return raw.lower().translate(_BLANKED).split() if raw else []


class Windows:
    """The automaton, the numbers of the benchmark words, and which items have a window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(raw)]
            for i in range(max(len(ids) - window + 1, 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.automaton.add_word(key, (len(key), names))
        self.automaton.make_automaton() if owners else None
        self.empty = not owners

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [start, end) of all matches, and the items they belong to."""
        number = self.number
        ids = tuple([number.get(w, 0) for w in found])
        if self.empty or not any(ids):
            return [], set()
        runs, items = [], set()
        for last, (n, names) in self.automaton.iter(ids):
            runs.append((last + 1 - n, last + 1))
            items |= names
        return runs, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def character_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code point offsets of word ranges in the original text."""
    places = [m.span() for m in WORD.finditer(raw.lower())]
    found, byte, point = [], 0, 0
    # Runs are in order and do not overlap: every byte is decoded once.
    for a, b in runs:
        ends = []
        for upto in (places[a][0], places[b - 1][1]):
            point, byte = point + len(raw[byte:upto].decode()), upto
            ends.append(point)
        found.append({"start": ends[0], "end": ends[1]})
    return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes | None]]]:
    """The benchmark in parts of bounded size. Their number follows from its size alone."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = int(total // BLOCK_CHARS) + 1
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield [(r.item, r.text.encode() if r.text is not None else None) for r in some.toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated, text_key for every row of `docs`.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive
    words of a benchmark text; a shorter one is a window as a whole, one without words none. A word of a document
    is hit inside any occurrence of a window. items are the sorted ids (as strings; a null id is 'null') whose
    windows occur, spans the merged hits as code point offsets. contaminated: n_hit > 0 and at least `percent`
    of n_words. Null and empty texts have no words. Repeated rows come out as often. Empty tables: no rows, or no hits.
    With `carry` the columns `text` and `row` (the others) come along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    state = carried(docs) if carry else text_key(docs)
    more = ["row"] if carry else []
    kinds = T._parse_datatype_string("doc_id long, text string, text_key long, n_words long, runs array<int>, items array<string>")
    kinds = T.StructType([*kinds.fields, *[state.schema[c] for c in more]])
    for part in _blocks(benchmark):
        held, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            automaton = kept(("windows", key), lambda: Windows(held.value, window))
            for batch in batches:
                raw = batch.column(1).cast(pa.binary()).to_pylist()
                n = batch.num_rows
                old = (batch.column("runs").to_pylist(), batch.column("items").to_pylist()) if "runs" in batch.schema.names else ([[]] * n, [[]] * n)
                counts, runs, items = [], [], []
                for text, before, names in zip(raw, *old):
                    found = words(text)
                    hits, owners = automaton.scan(found)
                    hits = merged(hits + list(zip(before[::2], before[1::2]))) if hits or before else []
                    counts.append(len(found))
                    runs.append([x for r in hits for x in r])
                    items.append(sorted(owners | set(names)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *[batch.column(c) for c in more]],
                    ["doc_id", "text", "text_key", "n_words", "runs", "items", *more],
                )

        state = state.mapInArrow(run, kinds)

    passed = ["text", *more] if carry else []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hit = [], []
            for raw, flat in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist()):
                runs = list(zip(flat[::2], flat[1::2]))
                spans.append(character_spans(raw, runs) if runs else [])
                hit.append(sum(b - a for a, b in runs))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(hit, pa.int64()), batch.column(5), pa.array(spans, kind), *[batch.column(c) for c in passed]],
                ["doc_id", "text_key", "n_words", "n_hit", "items", "spans", *passed],
            )

    result = T._parse_datatype_string("doc_id long, text_key long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    out = state.mapInArrow(finish, T.StructType([*result.fields, *[state.schema[c] for c in passed]]))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"), "text_key", *passed,
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, in one pass without a shuffle."""
    return restored(contaminated(docs, benchmark, carry=True).filter("NOT contaminated"), docs.columns)
