"""Periodic runs of words by maximal pairs in the interval tree of common prefixes.

A run is a stretch of consecutive words with smallest period q and a length of at least max(MIN_WORDS, MIN_REPEATS * q)
that keeps period q over no neighbouring word. Two places i < j of a text form a maximal pair of length L when L words
are equal from both on, the next words differ and so do the words before. With distance q = j - i the stretch i .. j + L - 1
then has period q and no neighbour keeps it: with q + L long enough it is a run as it stands, nothing needs extending.

The suffixes that share FLOOR words with another one are sorted by prefix doubling in numpy, many texts side by side;
common prefixes of neighbours follow in text order. Then the intervals of the tree are closed bottom-up, each with the sorted list of its
places and one list for each word that stands before them. Where two children meet in a node of length L, the smaller
gives its places one after the other: partners are the other child's places with another word before and
a distance of at most L / (MIN_REPEATS - 1). Such a distance is a period of the node's words, so all partners ahead have
one and the same word before them, which picks the list; and only the farthest place behind can have another one. Each
place costs two searches and what it reports, and reports are at most the runs times their exponents.

A stretch also turns up with multiples of its period; the smallest distance of equal stretches is the period.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from curvelake.llm.common import release, small_batches, texts

MIN_WORDS = 6
MIN_REPEATS = 4
#: Words that are looked at side by side; a longer text is a batch by itself.
BATCH_WORDS = 200_000
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string()),
])
SPARK_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def floor_of(min_words: int, min_repeats: int) -> int:
    """Least common prefix that a qualifying pair can have: over all q, max(min_words, min_repeats * q) - q."""
    return min(max(min_words, min_repeats * q) - q for q in range(1, min_words + 1))


def regrouped(group: np.ndarray, second: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`places` ordered by (group, second) with their new groups; a group is named by the rank of its first suffix."""
    order = np.lexsort((second, group))
    g, s = group[order], second[order]
    at, old = np.arange(len(order)), np.r_[True, g[1:] != g[:-1]]
    new = old | np.r_[True, s[1:] != s[:-1]]
    return places[order], g + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))


def shared_suffixes(words: np.ndarray, floor: int) -> np.ndarray:
    """Places of the suffixes that share `floor` words with another one, in suffix order; each text ends with a word of its own."""
    places, group = regrouped(np.zeros(len(words), np.int64), words, np.arange(len(words)))
    rank, known, shared = np.empty(len(words), np.int64), 1, places[:0]
    rank[places] = group
    while len(places):
        same = group[1:] == group[:-1]
        several = np.r_[same, False] | np.r_[False, same]
        places, group = places[several], group[several]
        if known == floor:
            shared = places
        # Suffixes that are still alike have not reached the last word of their text, which is found once.
        step = known if known >= floor else min(known, floor - known)
        if len(places):
            places, group = regrouped(group, rank[places + step], places)
            rank[places] = group
        known += step
    return shared[np.argsort(rank[shared])]


def common_prefixes(words: list[int], order: list[int], floor: int) -> list[int]:
    """Words that each suffix of `order` shares with the one before it; the first shares none.

    One place on in the text, one word less is shared at least, if the neighbour moves on inside `order` too.
    """
    before = dict(zip(order[1:], order))
    found, last, h = {}, -2, 0
    for i in sorted(order):
        j = before.get(i)
        h = h - 1 if i == last + 1 and h > floor else 0
        last = i
        if j is None:
            h = 0
        else:
            while words[i + h] == words[j + h]:
                h += 1
        found[i] = h
    return [found[i] for i in order]


def maximal_pairs(words: list[int], floor: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(first place, distance, common words) of all maximal pairs with `floor` words and a distance of common words / reach at most."""
    order = shared_suffixes(np.array(words, np.int64), floor).tolist()
    prefixes = [*common_prefixes(words, order, floor)[1:], 0]
    left = lambda i: words[i - 1] if i else -1
    open_nodes: list[tuple[int, list[int], dict[int, list[int]]]] = []
    for place, shared in zip(order, prefixes):
        places, classes = [place], {left(place): [place]}
        while open_nodes and open_nodes[-1][0] >= shared:
            length, others, other_classes = open_nodes.pop()
            if length < floor:
                continue
            if len(others) < len(places):
                places, classes, others, other_classes = others, other_classes, places, classes
            far = length // reach
            for e in places:
                own, k = left(e), bisect_right(others, e)
                if k < len(others) and others[k] <= e + far:
                    word = left(others[k])
                    if word != own:
                        same = other_classes[word]
                        for j in same[bisect_right(same, e) : bisect_right(same, e + far)]:
                            yield e, j - e, length
                if k and others[k - 1] >= e - far:
                    g = others[bisect_left(others, e - far)]
                    if left(g) != own:
                        yield g, e - g, length
            for word, mine in classes.items():
                same = other_classes.setdefault(word, [])
                for e in mine:
                    insort(same, e)
                    insort(others, e)
            places, classes = others, other_classes
        open_nodes.append((shared, places, classes))


def runs_of(texts_words: list[list[str]], min_words: int, min_repeats: int) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start and then period."""
    words, starts, n = [], [], 0
    for text in texts_words:
        ids: dict[str, int] = {}
        starts.append(len(words))
        # Words count as equal within their own text only.
        words += [n + ids.setdefault(w, len(ids)) for w in text]
        words.append(n + len(ids))
        n += len(ids) + 1
    least: dict[tuple[int, int], int] = {}
    for start, period, shared in maximal_pairs(words, floor_of(min_words, min_repeats), min_repeats - 1):
        length = period + shared
        if length >= max(min_words, min_repeats * period):
            least[start, length] = min(period, least.get((start, length), period))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts_words]
    for (start, length), period in least.items():
        text = bisect_right(starts, start) - 1
        found[text].append((start - starts[text], length, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return " ".join(words)
    out, upto = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        out += words[upto : max(start, upto)]
        upto = max(upto, end)
    return " ".join(out + words[upto:])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and the collapsed text of every row of `docs`.

    Words are runs without ASCII white space, numbered from 0. `min_repeats` is 3 or more. Null, empty and blank texts have no words, no
    runs and the collapsed text ''. Whole texts are read: a text is worked on in one task, in memory that grows with its
    words. Repeated rows come out as often; an empty table gives an empty one; other columns are not read.
    """
    if min_repeats < 3 or min_words < 2:
        raise ValueError("runs repeat three times at least and have two words at least")
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, cut, waiting = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                cut.append(WORD.findall(text.as_py() or ""))
                waiting += len(cut[-1])
                if waiting >= BATCH_WORDS:
                    yield written(ids, cut)
                    ids, cut, waiting = [], [], 0
            yield written(ids, cut)

    def written(ids: list[int | None], cut: list[list[str]]) -> pa.RecordBatch:
        runs = runs_of(cut, min_words, min_repeats)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(w) for w in cut], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], SCHEMA.field("runs").type),
            pa.array([collapsed(w, r) for w, r in zip(cut, runs)], pa.string()),
        ], schema=SCHEMA)

    return texts(docs).mapInArrow(found, SPARK_SCHEMA)
