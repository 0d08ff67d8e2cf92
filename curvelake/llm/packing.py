"""Hierarchical multi-length packing of token ids into sequences of several context sizes.

Tiers are the powers of two up to the longest window. A document gives whole longest windows from its start; what is left is
routed to the smallest tier that holds it. Each partition packs its own documents, in blocks of bounded size: the longest
waiting piece opens a window of its tier, and the gap is filled from shorter pieces, the longest that fits
first; where none fits, one is cut to the gap and its rest waits. So every sequence is exactly as
long as its tier. What a partition has left at its end is cut into powers of two. Sequences of one tier are dealt
to step groups of one number of tokens, back and forth in order of attention cost, so that steps cost alike.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from curvelake.llm.common import small_batches, texts
from curvelake.llm.tokens import default_vocabulary, encoder

WINDOW = 1024
SMALLEST = 64
BLOCK_TOKENS = 4 << 20
STEP_TOKENS = 64 << 10
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids binary"
)
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"]


class Packer:
    """Packs the documents of one partition. A piece is (doc_id, start, ids, doc_tokens), ids four bytes each."""

    def __init__(self, window: int = WINDOW, smallest: int = SMALLEST, step_tokens: int = STEP_TOKENS):
        self.window, self.smallest, self.step_tokens = window, smallest, step_tokens
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.lengths = 0  # bit n is set while a piece of n ids waits
        self.tokens = 0
        self.closed: dict[int, list[list[tuple]]] = defaultdict(list)
        self.sequences = self.groups = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self.closed[self.window].append([(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)])
        self._wait((doc_id, whole, ids[4 * whole :], total))

    def _wait(self, piece: tuple) -> None:
        if n := len(piece[2]) // 4:
            self.waiting[n].append(piece)
            self.lengths |= 1 << n
            self.tokens += n

    def _take(self, n: int) -> tuple:
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            self.lengths &= ~(1 << n)
        self.tokens -= n
        return piece

    def _fill(self, size: int) -> list[tuple]:
        """Pieces that fill exactly `size` ids; at least as many wait."""
        pieces, gap = [], size
        while gap:
            fitting = (self.lengths & ((1 << (gap + 1)) - 1)).bit_length() - 1
            if fitting > 0:
                piece = self._take(fitting)
            else:
                longer = self.lengths >> (gap + 1)
                doc_id, start, ids, total = self._take(gap + (longer & -longer).bit_length())
                piece = (doc_id, start, ids[: 4 * gap], total)
                self._wait((doc_id, start + gap, ids[4 * gap :], total))
            pieces.append(piece)
            gap -= len(piece[2]) // 4
        return pieces

    def pack(self) -> None:
        """Close windows until what waits is less than one window of the tier that the longest piece asks for."""
        while self.tokens:
            longest = self.lengths.bit_length() - 1
            tier = max(self.smallest, 1 << (longest - 1).bit_length())
            if tier > self.tokens:
                break
            self.closed[tier].append(self._fill(tier))

    def finish(self) -> None:
        self.pack()
        while self.tokens:
            size = min(self.window, 1 << (self.tokens.bit_length() - 1))
            self.closed[size].append(self._fill(size))

    def steps(self, last: bool) -> Iterator[tuple]:
        """Rows of the sequences that make full step groups; at the end also of the rest."""
        for tier, sequences in self.closed.items():
            share = max(1, self.step_tokens // tier)
            groups = len(sequences) // share
            now, self.closed[tier] = sequences[: groups * share], sequences[groups * share :]
            if last and self.closed[tier]:
                now, self.closed[tier], groups = sequences, [], groups + 1
            now.sort(key=lambda s: -sum(len(p[2]) ** 2 for p in s))
            for k, sequence in enumerate(now):
                lap, place = divmod(k, groups)
                group = self.groups + (place if lap % 2 == 0 else groups - 1 - place)
                offset = 0
                for doc_id, start, ids, total in sequence:
                    n = len(ids) // 4
                    yield doc_id, start, n, ids, total, self.sequences, offset, tier, group
                    offset += n
                self.sequences += 1
            self.groups += groups


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, window: int = WINDOW,
    smallest: int = SMALLEST, step_tokens: int = STEP_TOKENS, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, ids.

    A document is the ids of its whole text and then `end_id`; null and empty texts are that id alone. Each id lies
    in one piece. Sequences are numbered by partition (upper bits) and then from 0. Repeated rows are packed
    each; null ids stay null. ids are the bytes of the piece (null without with_ids). Empty in, empty out.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(path), Packer(window, smallest, step_tokens), TaskContext.get().partitionId() << 36
        end, held = np.array([end_id], "<u4").tobytes(), 0

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            part: list[tuple] = []
            for doc_id, start, n, ids, total, sequence, offset, tier, group in packer.steps(last):
                part.append((doc_id, start, n, zlib.crc32(ids), total, base + sequence, offset, tier, base + group, ids if with_ids else None))
                if len(part) == 4096:
                    yield batch_of(part)
                    part = []
            if part:
                yield batch_of(part)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                packer.add(doc_id, ids + end)
                held += len(ids) // 4 + 1
                if held >= BLOCK_TOKENS:
                    packer.pack()
                    yield from rows(False)
                    held = 0
        packer.finish()
        yield from rows(True)

    return texts(docs).mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)
