"""Secrets by fixed patterns and by inferred grammars.

Base patterns give labelled credentials of three kinds. For each kind a bounded sample of their distinct values is read into
a prefix tree: the characters of a beginning that many values share are symbols of their own, any other one stands for its class.
States are merged where Hoeffding bounds find their ends and next symbols, theirs and those of the states after them,
compatible: first states of one depth, so that few samples are pooled into one profile for each format and fixed prefixes,
places and lengths stay; then states of different depths, if enough samples speak for it, which lets values of free
length repeat. What is left is a probabilistic automaton that also accepts unseen values. Every other
token of every text from 8 characters on is then scored, and where it is none itself its parts: what stands after '=',
and between '/', '.' and '_', so that a value is found that is glued to a name or a URL. The score is the likelihood
under each automaton, per symbol, which must be typical of that kind, and against a model of pairs of classes
counted over the tokens and parts of the whole corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelake.llm.common import carried, release, restored, shared, small_batches, text_key, texts

KINDS = ("assign", "access", "hex")
#: Distinct labelled values of each kind that its automaton is inferred from, the first by hash, and their most bytes.
SAMPLE, SAMPLE_BYTES = 400, 512
#: Samples that two states of different depths need before they can be taken for one.
LEAST = 30
#: Share of the values that a shared beginning needs, their least number, and its least length.
FIXED, FIXED_LEAST, FIXED_CHARS = 0.1, 8, 3
#: Shortest token or part that is scored; base values count from the same length.
MIN_TOKEN = 8
ALPHA = 0.05
#: Log of how much likelier than an ordinary token a found one must be, and the band of typical scores.
MARGIN = 8.0
BAND = 3.5

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: Character classes of the automata.
CLASSES = ((b"0123456789", "d"), (b"abcdef", "a"), (b"ghijklmnopqrstuvwxyz", "g"), (b"ABCDEF", "A"), (b"GHIJKLMNOPQRSTUVWXYZ", "G"), (b"+/", "+"), (b"_-", "_"), (b".", "."), (b"=", "="))
_TABLE = bytes(next((c.encode()[0] for chars, c in CLASSES if bytes([b]) in chars), 63) for b in range(256))
#: A token in a text of classes: a whole run of characters that have one.
TOKEN = re.compile(rb"[^?]{%d,}" % MIN_TOKEN)
#: How a token falls into parts, each rule inside the parts of the one before: at '=' (which stays as padding), without
#: dots and slashes at the ends, without padding, then at each separator.
PARTS = tuple(re.compile(p) for p in (rb"[^=]+=*", rb"[^./](?:.*[^./])?", rb"[^=]+", rb"[^/]+", rb"[^.]+", rb"[^_]+"))
SEPARATED = re.compile(rb"[=/._]")


def classes(value: bytes) -> str:
    return value.translate(_TABLE).decode()


def base_spans(raw: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, value) in bytes, per kind leftmost and not overlapping; the value is the credential itself."""
    spans, low = [], raw.lower()
    starts = []
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    past = 0
    for at in sorted(starts):
        if at >= past and (m := ASSIGN.match(raw, at)):
            past = m.end()
            if len(m[1]) >= 8:
                spans.append((*m.span(), "assign", m[1]))
    spans += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16] if b"AKIA" in raw else []
    spans += [(*m.span(), "hex", m[0]) for m in HEX.finditer(raw)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def parts(raw: bytes, start: int, end: int, rule: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, next rule) of the parts just below a token or part, those of MIN_TOKEN and more."""
    while rule < len(PARTS):
        below = [m.span() for m in PARTS[rule].finditer(raw, start, end)]
        rule += 1
        if below != [(start, end)]:
            return [(a, b, rule) for a, b in below if b - a >= MIN_TOKEN]
    return []


def candidates(raw: bytes, found: list[tuple[int, int, str, bytes]], taken: Callable[[bytes, bytes], object]) -> Iterator[tuple[int, int, object]]:
    """(start, end, answer) of every token and part that touches no base match; `taken` sees its classes and the characters.

    A part is asked only where no token or part around it was taken.
    """
    merged: list[list[int]] = []
    for a, b, _, _ in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    shapes, starts = raw.translate(_TABLE), [a for a, _ in merged]
    for m in TOKEN.finditer(shapes):
        a, b = m.span()
        plain = not (merged and (i := bisect_right(starts, b - 1)) and merged[i - 1][1] > a)
        if plain and (answer := taken(m[0], raw[a:b])):
            yield a, b, answer
        elif SEPARATED.search(raw, a, b):
            todo = parts(raw, a, b)[::-1]
            while todo:
                a, b, rule = todo.pop()
                free = plain or not ((i := bisect_right(starts, b - 1)) and merged[i - 1][1] > a)
                if free and (answer := taken(shapes[a:b], raw[a:b])):
                    yield a, b, answer
                else:
                    todo += parts(raw, a, b, rule)[::-1]


def scan(docs: DataFrame) -> DataFrame:
    """values: the base matches' (kind, value), and pairs: counts of class pairs of the tokens and parts; a row for each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            values, shapes, counts = set(), Counter(), Counter()

            def count(shape: bytes, _: bytes) -> None:
                shapes[shape] += 1

            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                raw = raw or b""
                found = base_spans(raw)
                values.update((k, v.decode()) for _, _, k, v in found if len(v) <= SAMPLE_BYTES)
                for _ in candidates(raw, found, count):
                    pass
            for shape, n in shapes.items():
                whole = f"^{shape.decode()}$"
                for i in range(len(whole) - 1):
                    counts[whole[i : i + 2]] += n
            value = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
            pair = pa.list_(pa.struct([("pair", pa.string()), ("n", pa.int64())]))
            rows = [[{"kind": k, "value": v} for k, v in values]], [[{"pair": p, "n": n} for p, n in counts.items()]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], value), pa.array(rows[1], pair)], ["values", "pairs"])

    return texts(docs).select("text").mapInArrow(run, "values array<struct<kind:string,value:string>>, pairs array<struct<pair:string,n:long>>")


@dataclass
class Automaton:
    """Log-probabilities: of the next symbol (state, symbol) with the state after it, and of ending."""

    kind: str
    moves: dict[tuple[int, str], tuple[int, float]]
    ends: dict[int, float]
    #: Shared beginnings, and whether every value has one.
    fixed: tuple[bytes, ...]
    always: bool
    mean: float = 0.0
    spread: float = 0.0

    def score(self, value: bytes) -> float:
        """Log-likelihood of the format; minus infinity where a symbol has no move."""
        if self.always and not value.startswith(self.fixed):
            return -math.inf
        state, total = 0, 0.0
        for symbol in symbols(value, self.fixed):
            if (step := self.moves.get((state, symbol))) is None:
                return -math.inf
            state, total = step[0], total + step[1]
        return total + self.ends.get(state, -math.inf)

    def typical(self, score: float, size: int) -> bool:
        return score > -math.inf and abs(score / (size + 1) - self.mean) <= BAND * self.spread / math.sqrt(size + 1)

    @property
    def states(self) -> int:
        return len({0, *self.ends} | {a for a, _ in self.moves} | {b for b, _ in self.moves.values()})


def beginnings(values: list[bytes]) -> tuple[bytes, ...]:
    """The longest beginnings that enough of the values share."""
    enough, grown, found = max(FIXED_LEAST, FIXED * len(values)), [b""], []
    while grown:
        start = grown.pop()
        more = Counter(v[: len(start) + 1] for v in values if v.startswith(start) and len(v) > len(start))
        longer = [x for x, n in more.items() if n >= enough]
        grown += longer
        if not longer and len(start) >= FIXED_CHARS:
            found.append(start)
    return tuple(sorted(found))


def symbols(value: bytes, fixed: tuple[bytes, ...]) -> list[str]:
    """A class for each character; the characters themselves, quoted, of a shared beginning that the value has in full."""
    found = list(classes(value))
    start = next((f for f in fixed if value.startswith(f)), b"")
    return [f"'{chr(c)}" for c in start] + found[len(start) :]


class _Merger:
    """A prefix tree with counts whose states are merged; merged states are followed to the one that stands for them."""

    def __init__(self, words: list[list[str]], alpha: float):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.child: list[dict[str, int]] = [{}]
        self.arcs: list[Counter] = [Counter()]
        self.through, self.ending, self.into = [0], [0], [0]
        #: Fewest and most symbols that follow.
        self.least, self.most = [10**9], [0]
        for word in words:
            node = 0
            self.through[0] += 1
            for rest, symbol in zip(range(len(word), 0, -1), word):
                self.least[node], self.most[node] = min(self.least[node], rest), max(self.most[node], rest)
                self.arcs[node][symbol] += 1
                if symbol not in self.child[node]:
                    self.child[node][symbol] = len(self.child)
                    self.child.append({})
                    self.arcs.append(Counter())
                    self.through.append(0)
                    self.ending.append(0)
                    self.into.append(len(self.into))
                    self.least.append(10**9)
                    self.most.append(0)
                node = self.child[node][symbol]
                self.through[node] += 1
            self.ending[node] += 1
            self.least[node] = 0

    def find(self, x: int) -> int:
        while self.into[x] != x:
            x = self.into[x]
        return x

    def next(self, x: int) -> list[tuple[str, int]]:
        return [(s, self.find(y)) for s, y in sorted(self.child[x].items())]

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > (n**-0.5 + m**-0.5) * self.bound

    def compatible(self, x: int, y: int, least: int) -> bool:
        """Do no two states that follow x and y by the same symbols differ, as far as both have `least` samples?"""
        todo, seen = [(x, y)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.through[a], self.through[b]
            if min(n, m) >= least:
                if self._differ(self.ending[a], n, self.ending[b], m):
                    return False
                if any(self._differ(self.arcs[a][s], n, self.arcs[b][s], m) for s in self.child[a].keys() | self.child[b].keys()):
                    return False
            todo += [(self.find(self.child[a][s]), self.find(self.child[b][s])) for s in self.child[a].keys() & self.child[b].keys()]
        return True

    def merge(self, x: int, y: int) -> None:
        """y and what follows it into x."""
        todo = [(x, y)]
        while todo:
            a, b = (self.find(z) for z in todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.through[a] += self.through[b]
            self.ending[a] += self.ending[b]
            self.least[a], self.most[a] = min(self.least[a], self.least[b]), max(self.most[a], self.most[b])
            self.arcs[a] += self.arcs[b]
            for s, below in self.child[b].items():
                if s in self.child[a]:
                    todo.append((self.child[a][s], below))
                else:
                    self.child[a][s] = below

    def as_long(self, x: int, y: int) -> bool:
        """Can what follows be of one length?"""
        return self.least[x] <= self.most[y] and self.least[y] <= self.most[x]

    def pool_depths(self) -> None:
        level = [0]
        while level:
            below = sorted({y for x in level for _, y in self.next(x)}, key=lambda y: (-self.through[y], y))
            level = []
            for node in below:
                same = next((x for x in level if self.as_long(x, node) and self.compatible(x, node, 1)), None)
                if same is None:
                    level.append(node)
                else:
                    self.merge(same, node)

    def pool_others(self) -> None:
        kept, todo = [0], [y for _, y in self.next(0)]
        while todo:
            node = self.find(todo.pop(0))
            if node in kept:
                continue
            enough = self.through[node] >= LEAST
            same = next((x for x in kept if enough and self.through[x] >= LEAST and self.compatible(x, node, LEAST)), None)
            if same is None:
                kept.append(node)
            else:
                self.merge(same, node)
            todo += [y for _, y in self.next(self.find(node)) if y not in kept]
            kept = list(dict.fromkeys(self.find(x) for x in kept))


def infer(kind: str, values: list[bytes], alpha: float = ALPHA) -> Automaton | None:
    """The automaton of a sample of values; None without one."""
    if not values:
        return None
    fixed = beginnings(values)
    always = bool(fixed) and all(v.startswith(fixed) for v in values)
    tree = _Merger([symbols(v, fixed) for v in values], alpha)
    tree.pool_depths()
    tree.pool_others()
    kept, todo = [0], [0]
    while todo:
        for _, y in tree.next(todo.pop()):
            if y not in kept:
                kept.append(y)
                todo.append(y)
    moves = {(a, s): (y, math.log(tree.arcs[a][s] / tree.through[a])) for a in kept for s, y in tree.next(a)}
    ends = {a: math.log(tree.ending[a] / tree.through[a]) for a in kept if tree.ending[a]}
    out = Automaton(kind, moves, ends, fixed, always)
    scores = [(out.score(v), len(v) + 1) for v in values]
    scores = [(x, n) for x, n in scores if x > -math.inf]
    each = np.array([x / n for x, n in scores])
    out.mean = float(each.mean())
    out.spread = float(max(np.sqrt(np.mean([n * (x / n - out.mean) ** 2 for x, n in scores])), 0.05))
    return out


class Ordinary:
    """Pairs of neighbouring classes in the tokens of the corpus; '^' before the first, '$' after the last."""

    def __init__(self, pairs: dict[str, int]):
        self.pairs, self.firsts = pairs, defaultdict(int)
        for pair, n in pairs.items():
            self.firsts[pair[0]] += n

    def score(self, shape: str) -> float:
        whole = f"^{shape}$"
        return sum(math.log((self.pairs.get(whole[i : i + 2], 0) + 0.5) / (self.firsts[whole[i]] + 6)) for i in range(len(whole) - 1))


def pair_counts(scanned: DataFrame) -> dict[str, int]:
    """Counts of class pairs over the tokens and parts of all documents; at most 121 rows."""
    rows = scanned.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n"))
    return {r.pair: r.n for r in rows.collect()}


def automata(scanned: DataFrame, sample: int = SAMPLE) -> list[Automaton]:
    values = scanned.select(F.explode("values").alias("b")).select("b.kind", "b.value").distinct()
    found = []
    for kind in KINDS:
        some = values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        if automaton := infer(kind, [r.value.encode() for r in some]):
            found.append(automaton)
    return found


def find_secrets(docs: DataFrame, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """doc_id, text_key, base and spans, these each an array of (kind, start, end) in order of start and kind, for every row of `docs`.

    spans holds the base matches and what the automata add, as kinds format_assign, format_access and format_hex;
    an added token or part never overlaps a base match or another one. Offsets count code points, the end is exclusive. Null and empty
    texts have none. Repeated rows come out as often. Without labelled credentials nothing is added.
    With `carry` the columns `text` and `row` (the others) come along.
    """
    passed = ["text", "row"] if carry else []
    small_batches(docs.sparkSession)
    scanned = shared(scan(docs))
    models, ordinary = automata(scanned, sample), Ordinary(pair_counts(scanned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: dict[bytes, str | None] = {}
        free, bound = [m for m in models if not m.fixed], [m for m in models if m.fixed]

        def best(of: list[Automaton], raw: bytes, shape: bytes) -> str | None:
            scores = [(score, m.kind) for m in of if m.typical(score := m.score(raw), len(raw))]
            top = max(scores, default=(-math.inf, ""))
            return f"format_{top[1]}" if top[1] and top[0] - ordinary.score(shape.decode()) > MARGIN else None

        def judged(shape: bytes, raw: bytes) -> str | None:
            if shape not in known:
                if len(known) > 100_000:
                    known.clear()
                known[shape] = best(free, raw, shape)
            return known[shape] or (best(bound, raw, shape) if bound else None)

        order = {k: i for i, k in enumerate(KINDS + tuple(f"format_{k}" for k in KINDS))}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, spans = [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                raw = raw or b""
                found = base_spans(raw)
                more = list(candidates(raw, found, judged))
                place: dict[int, int] = {}
                if not raw.isascii():
                    last = count = 0
                    for x in sorted({x for s in found for x in s[:2]} | {x for s in more for x in s[:2]}):
                        count += len(raw[last:x].decode())
                        place[x] = count
                        last = x
                at = lambda x: place.get(x, x)
                mine = [{"kind": k, "start": at(a), "end": at(b)} for a, b, k, _ in found]
                base.append(mine)
                spans.append(sorted(mine + [{"kind": k, "start": at(a), "end": at(b)} for a, b, k in more], key=lambda s: (s["start"], order[s["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, kind), pa.array(spans, kind), *[batch.column(c) for c in passed]], ["doc_id", "text_key", "base", "spans", *passed])

    span = "array<struct<kind:string,start:int,end:int>>"
    rows = carried(docs) if carry else text_key(docs)
    result = T._parse_datatype_string(f"doc_id long, text_key long, base {span}, spans {span}")
    return rows.mapInArrow(run, T.StructType([*result.fields, *[rows.schema[c] for c in passed]]))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by `mark`."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.when(fresh, F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every row and column of `docs`, secrets in its text replaced, in one pass without a shuffle."""
    found = find_secrets(docs, sample, carry=True)
    text = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return restored(found.withColumn("text", text), docs.columns)
