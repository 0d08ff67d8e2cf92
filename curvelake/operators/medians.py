"""Running medians by an incremental order statistic over streamed chunks.

An object's rows are cut into chunks of consecutive positions. A chunk's rows, and half a window on both
sides, pass through a task in order; two heaps hold the window's values and change by one value in and one out for each row.
Nothing is sorted or listed anew per row, and a task holds one window and the rows that wait for the values ahead of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.operators import grouped as g

#: Cadences of a chunk; more only where the window is longer, so that a row is in three chunks at most.
CHUNK_ROWS = 65_536


class Window:
    """Median of a changing set of numbers. The lower half is a heap by descending, the upper one by ascending value.

    A number that leaves stays in its heap until it comes to the top, or until half of the heap has left.
    """

    def __init__(self) -> None:
        self.heaps: tuple[list, list] = ([], [])
        self.live = [0, 0]
        self.side: dict[int, int] = {}

    def _top(self, side: int) -> tuple[float, int]:
        heap = self.heaps[side]
        while self.side.get(heap[0][1]) != side:
            heappop(heap)
        return heap[0]

    def _push(self, side: int, signed: float, name: int) -> None:
        heappush(self.heaps[side], (signed, name))
        self.side[name] = side
        self.live[side] += 1

    def _even_out(self) -> None:
        while not 0 <= self.live[0] - self.live[1] <= 1:
            side = int(self.live[1] > self.live[0])
            signed, name = self._top(side)
            heappop(self.heaps[side])
            self.live[side] -= 1
            self._push(1 - side, -signed, name)

    def add(self, name: int, value: float) -> None:
        if self.live[0] and value <= -self._top(0)[0]:
            self._push(0, -value, name)
        else:
            self._push(1, value, name)
        self._even_out()

    def remove(self, name: int) -> None:
        side = self.side.pop(name, None)
        if side is None:
            return
        self.live[side] -= 1
        heap = self.heaps[side]
        if len(heap) > 2 * self.live[side] + 64:
            heap[:] = [x for x in heap if self.side.get(x[1]) == side]
            heapify(heap)
        self._even_out()

    def median(self) -> float | None:
        if not self.live[0]:
            return None
        low = -self._top(0)[0]
        return low if self.live[0] > self.live[1] else (low + self._top(1)[0]) / 2


class Chunk:
    """Medians of the ``size`` places from ``first`` on. Rows (place, value, is home) go in by place, half a window before and after included."""

    def __init__(self, half: int | None, n_rows: int, first: int, size: int):
        self.half, self.n_rows, self.first, self.end = half, n_rows, first, first + size
        self.window, self.place, self.value = Window(), -1, None

    def _take(self, place: int, value: float | None) -> list[float | None]:
        """The median whose window ends at this place."""
        if value is not None:
            self.window.add(place, value)
        if self.first + self.half > place or self.first == self.end:
            return []
        found = self.window.median()
        self.window.remove(self.first - self.half)
        self.first += 1
        return [found]

    def send(self, place: int, value: float | None, home: bool) -> list[float | None]:
        if self.half is None:
            return [None] if home else []
        if place == 0:
            for ahead in range(self.first - self.half, 0):
                self._take(ahead, value)
        self.place, self.value = place, value
        return self._take(place, value)

    def close(self) -> list[float | None]:
        """What the last row of the object settles, which repeats behind it."""
        if self.half is None or self.place != self.n_rows - 1:
            return []
        return [m for behind in range(self.n_rows, self.end + self.half) for m in self._take(behind, self.value)]


def running_median(placed: DataFrame, keys: list[str], value: str, half: Column, name: str = "trend") -> DataFrame:
    """Median of 2 * ``half`` + 1 ordered rows as ``name``; NULL where ``half`` is. ``placed``: rows with ``pos`` and ``n_rows``.

    Past the ends the first and last value repeat. Unknown values are left out of a window, an even number of values has
    the mean of the two in the middle.
    """
    shown = [c for c in placed.columns if c not in ("pos", "n_rows")]
    wide = F.coalesce(half, F.lit(0))
    size = F.greatest(F.lit(CHUNK_ROWS), 2 * wide + 1)
    rows = g.blocks(placed.withColumns({"_half": half.cast("long"), "_chunk": size}), wide, wide, F.col("_chunk"))
    rows = rows.select(
        *shown, "_block", "_home", "pos", "n_rows", "_half", F.col(value).cast("double").alias("_value"), (F.col("_block") * F.col("_chunk")).alias("_start"),
        F.least(F.col("_chunk"), F.col("n_rows") - F.col("_block") * F.col("_chunk")).alias("_size"),
    )
    ordered = rows.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "pos")
    fields = [f for f in rows.schema.fields if f.name in shown]

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        ready: list[float | None] = []
        current, chunk = None, None

        def written() -> Iterator[pa.RecordBatch]:
            if ready:
                table = pa.Table.from_batches(waiting)
                done, rest = table.slice(0, len(ready)), table.slice(len(ready))
                column = pa.chunked_array([pa.array(ready, pa.float64())])
                yield from done.append_column(name, column).combine_chunks().to_batches()
                waiting[:] = rest.to_batches()
                ready.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = list(zip(*[table.column(c).to_pylist() for c in (*keys, "_block")]))
            info = [table.column(c).to_pylist() for c in ("_half", "n_rows", "_start", "_size")]
            numbers = list(zip(table.column("pos").to_pylist(), table.column("_value").to_pylist(), table.column("_home").to_pylist()))
            waiting += [b for b in table.filter(table.column("_home")).select(shown).to_batches() if b.num_rows]
            for i, row in enumerate(numbers):
                if groups[i] != current:
                    if chunk is not None:
                        ready += chunk.close()
                    current, chunk = groups[i], Chunk(*[x[i] for x in info])
                ready += chunk.send(*row)
            yield from written()
        if chunk is not None:
            ready += chunk.close()
        yield from written()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ordered.mapInArrow(medians, f"{schema}, `{name}` double")
