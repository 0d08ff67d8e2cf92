"""Toxicity by a counterfactual-regularised classifier over the distinct words and word beginnings of a text.

Both are hashed into buckets. From a bounded labelled sample, buckets whose presence goes with the label are chosen, and a logistic
model is fitted on them and on the buckets of the identity terms. Beside the log loss it minimises the squared
difference of the scores of two counterfactual sentences, for every sentence of the labelled texts: the sentence with one
identity term and with another one of the same language and group in its place. A sentence that names no group gets
a place for the two terms; none of its own words is overwritten. So all groups come to weigh alike, and what is left
of their common weight is shrunk: a third sentence, without any term, is held against both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm.common import shared, small_batches, texts
from curvelake.llm.labelled import held_out, training_rows
from curvelake.llm.near_dedup import shingle_sets

#: Labelled rows to learn from, and bytes of all their texts; a text is learnt from as a whole or not at all.
TRAIN_DOCS, TRAIN_BYTES = 12_000, 64 << 20
BUCKETS = 1 << 20
#: Bytes of the beginnings of longer words: they carry a stem over to endings that the sample lacks.
STEMS = (4, 5)
#: Least log-likelihood ratio of a chosen bucket against independence of the label.
EVIDENCE = 24.0
#: Least share of ones among the documents with a chosen bucket: its presence alone has to mean something.
PURITY = 0.6
PENALTY = 2.0
RIDGE = 1e-4
#: Share of the chosen buckets that each training step hides, so that each one learns to stand alone.
HIDDEN = 0.6
STEPS = 400
#: Group names by language, swapped within their group.
IDENTITY = {
    "en": {
        "gender": ("women", "men", "girls", "boys", "female", "male", "transgender", "nonbinary"),
        "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
        "origin": ("african", "asian", "european", "american", "mexican", "chinese", "indian", "arab", "latino", "immigrant", "refugee", "black", "white"),
        "orientation": ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
        "age_ability": ("old", "young", "elderly", "teenage", "disabled", "deaf", "blind", "autistic"),
    },
    "de": {
        "gender": ("frauen", "männer", "mädchen", "jungen"), "religion": ("christen", "juden", "muslime", "hindus", "buddhisten", "atheisten"),
        "origin": ("afrikaner", "asiaten", "europäer", "türken", "araber", "ausländer", "flüchtlinge"), "orientation": ("schwule", "lesben", "heterosexuelle"),
    },
    "fr": {
        "gender": ("femmes", "hommes", "filles", "garçons"), "religion": ("chrétiens", "juifs", "musulmans", "hindous", "bouddhistes", "athées"),
        "origin": ("africains", "asiatiques", "européens", "arabes", "étrangers", "réfugiés"), "orientation": ("gays", "lesbiennes", "hétérosexuels"),
    },
    "es": {
        "gender": ("mujeres", "hombres", "chicas", "chicos"), "religion": ("cristianos", "judíos", "musulmanes", "hindúes", "budistas", "ateos"),
        "origin": ("africanos", "asiáticos", "europeos", "árabes", "extranjeros", "refugiados"), "orientation": ("gays", "lesbianas", "heterosexuales"),
    },
}
_SETS = [[t.encode() for t in terms] for groups in IDENTITY.values() for terms in groups.values()]
#: The sets a term stands in: some are words of two languages.
_SETS_OF = {term: [s for s in _SETS if term in s] for terms in _SETS for term in terms}
_BLANKED = bytes(b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(rb"[^.!?\n]+")


def words(raw: bytes | None) -> list[bytes]:
    return raw.lower().translate(_BLANKED).split() if raw else []


def _hashed(found: list[bytes]) -> np.ndarray:
    flat = np.empty(len(found), object)
    flat[:] = found
    h = pd.util.hash_array(flat, categorize=False) if len(found) else np.zeros(0, np.uint64)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def buckets(found: list[bytes]) -> np.ndarray:
    """One row of buckets per word: of the word, and of each beginning or -1 where the word is no longer than it."""
    columns = [_hashed(found)]
    length = np.array([len(w) for w in found], np.int64)
    for n in STEMS:
        stem = _hashed([w[:n] for w in found]) ^ (n * 0x9E37 & BUCKETS - 1)
        columns.append(np.where(length > n, stem, -1))
    return np.stack(columns, 1)


def distinct(found: list[bytes]) -> np.ndarray:
    all_of = np.unique(buckets(found))
    return all_of[all_of >= 0].astype(np.int32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, label, present (distinct buckets), near (least shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            present = pa.array([distinct(words(t)) for t in raw], pa.list_(pa.int32()))
            near = pa.array([shingle_sets([t])[0][:8] for t in raw], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), present, near], ["doc_id", "label", "present", "near"])

    return docs.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, present array<int>, near array<long>")


def slotted(sentence: list[bytes], pick: int) -> tuple[list[bytes], int, bytes, bytes]:
    """The sentence without a term in its slot, the slot, one term and another one.

    The slot is the first identity term, or a new place that `pick` names; `pick` also names the terms.
    """
    slot = next((i for i, w in enumerate(sentence) if w in _SETS_OF), None)
    if slot is None:
        terms = _SETS[pick % len(_SETS)]
        slot = pick // len(_SETS) % (len(sentence) + 1)
        rest, one = sentence, terms[pick % len(terms)]
    else:
        one = sentence[slot]
        terms = _SETS_OF[one][pick % len(_SETS_OF[one])]
        rest = sentence[:slot] + sentence[slot + 1 :]
    return rest, slot, one, terms[(terms.index(one) + 1 + pick % (len(terms) - 1)) % len(terms)]


def counterfactuals(sentence: list[bytes], pick: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The sentence without a term in the slot, with one term and with another one."""
    rest, slot, one, other = slotted(sentence, pick)
    return rest, *[rest[:slot] + [t] + rest[slot:] for t in (one, other)]


def triples(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """The counterfactuals of every sentence of every row as places in `chosen`: bare, one, other.

    The model knows which words a text has, not where: a side is the places of the bare sentence and those of its term.
    """

    def places(each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of buckets, and which of them are chosen."""
        at = np.minimum(np.searchsorted(chosen, each), len(chosen) - 1)
        return at, chosen[at] == each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term = {}
        for term in _SETS_OF:
            at, known = places(distinct([term]))
            of_term[term] = at[known]
        for batch in batches:
            flat, sizes, terms = [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                sentences = [w for s in _SENTENCE.findall(raw or b"") if (w := words(s))]
                for k, s in enumerate(sentences):
                    # Spread over all sets, places and terms, the same in every run.
                    rest, _, one, other = slotted(s, zlib.crc32(f"{doc_id}:{k}".encode()))
                    flat += rest
                    sizes.append(len(rest))
                    terms.append((one, other))
            at, known = places(buckets(flat).ravel())
            owner = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64) * (1 + len(STEMS)))
            pairs = np.unique(owner[known] * len(chosen) + at[known])
            bare = np.split(pairs % len(chosen), np.searchsorted(pairs // len(chosen), np.arange(1, len(sizes)))) if sizes else []
            sides = [[np.union1d(x, of_term[t[i]]) for x, t in zip(bare, terms)] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in (bare, *sides)], ["bare", "one", "other"])

    return docs.select("doc_id", "text").mapInArrow(run, "bare array<int>, one array<int>, other array<int>")


def _rows(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of lists."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return row, np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)


class Model:
    """Buckets and weights in order, and an intercept; `score` takes whole texts."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, intercept: float):
        self.chosen, self.weights, self.intercept = chosen, weights, intercept

    def score(self, raw: list[bytes | None]) -> np.ndarray:
        found = [words(t) for t in raw]
        each = buckets([w for ws in found for w in ws])
        row = np.repeat(np.repeat(np.arange(len(raw)), [len(w) for w in found]), each.shape[1])
        bucket = each.ravel()
        at = np.searchsorted(self.chosen, bucket)
        hit = self.chosen[np.minimum(at, len(self.chosen) - 1)] == bucket if len(self.chosen) else np.zeros(len(bucket), bool)
        pairs = np.unique(row[hit] * len(self.chosen) + at[hit]) if len(self.chosen) else np.zeros(0, np.int64)
        total = np.full(len(raw), self.intercept)
        if len(pairs):
            np.add.at(total, pairs // len(self.chosen), self.weights[pairs % len(self.chosen)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def once(sample: pd.DataFrame) -> pd.DataFrame:
    """The sample with near copies counted once."""
    taken: set[int] = set()
    keep = []
    for near in sample["near"]:
        known = sum(int(x) in taken for x in near)
        keep.append(known < 4 and (len(near) == 8 or known == 0))
        if keep[-1]:
            taken.update(int(x) for x in near)
    return sample[np.array(keep, bool)] if len(sample) else sample


def choose(sample: pd.DataFrame) -> np.ndarray:
    """Buckets that go with the label, and those of the identity terms; none where a label is missing."""
    y = sample["label"].to_numpy(np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    present = [np.asarray(x, np.int64) for x in sample["present"]]
    flat, owner = np.concatenate(present), np.repeat(y, [len(x) for x in present])
    df = np.bincount(flat, minlength=BUCKETS)
    with_one = np.bincount(flat, owner, minlength=BUCKETS)
    without = df - with_one
    share = n1 / len(y)
    # Twice the log-likelihood gained when documents with the bucket get their own share of ones.
    ratio = 2 * (with_one * np.log(np.maximum(with_one, 1) / np.maximum(df * share, 1e-9)) + without * np.log(np.maximum(without, 1) / np.maximum(df * (1 - share), 1e-9)))
    named = np.zeros(BUCKETS, bool)
    named[distinct(list(_SETS_OF))] = True
    return np.nonzero((ratio >= EVIDENCE) & (with_one >= PURITY * df) | named)[0]


def fit(sample: pd.DataFrame, chosen: np.ndarray, pairs: pd.DataFrame, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """A model of the rows of `features` and `triples`. Without both labels the score is the share of ones."""
    y = sample["label"].to_numpy(np.float64)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    if not len(chosen):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(base / (1 - base))))
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    row, at = _rows(sample["present"].tolist())
    row, at = row[column[at] >= 0], column[at[column[at] >= 0]]
    # A sentence counts by the squares of its three differences; equal ones are counted together.
    kinds = Counter(tuple(tuple(map(int, x)) for x in t) for t in zip(pairs["bare"], pairs["one"], pairs["other"]))
    kinds = {t: n for t, n in sorted(kinds.items()) if len(set(t)) > 1}
    share = np.array(list(kinds.values()), np.float64) / max(1, len(pairs))
    sides = [_rows([t[i] for t in kinds]) for i in range(3)]
    w, b = np.zeros(len(chosen)), float(np.log(base / (1 - base)))
    m = v = np.zeros(len(chosen) + 1)

    def logistic(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], minlength=n), -30, 30)))

    draw = np.random.default_rng(11)
    for step in range(1, steps + 1):
        # The hidden buckets are drawn anew for each document.
        shown = draw.random(len(row)) >= HIDDEN
        row_s, at_s = row[shown], at[shown]
        gap = (logistic(row_s, at_s, len(y)) - y) / len(y)
        grad = np.bincount(at_s, gap[row_s], minlength=len(w)) + ridge * w
        grad_b = gap.sum()
        if kinds:
            scores = [logistic(*side, len(kinds)) for side in sides]
            for i, j in ((1, 2), (0, 1), (0, 2)):
                d = 2 * penalty * share * (scores[i] - scores[j])
                for side, score, sign in ((sides[i], scores[i], 1), (sides[j], scores[j], -1)):
                    pull = sign * d * score * (1 - score)
                    grad += np.bincount(side[1], pull[side[0]], minlength=len(w))
                    grad_b += pull.sum()
        g = np.append(grad, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, float(b))


def learn(rows: DataFrame, penalty: float = PENALTY) -> Model:
    """A model of labelled rows (doc_id, text, label). Buckets and places of the bounded sample reach the driver, texts do not."""
    sample = once(features(rows).toPandas().sort_values("doc_id"))
    chosen = choose(sample)
    pairs = triples(rows, chosen).toPandas() if len(chosen) else pd.DataFrame({"bare": [], "one": [], "other": []})
    return fit(sample, chosen, pairs, penalty)


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learnt from at most `bound` labelled rows and TRAIN_BYTES of text.

    Null and empty texts score the intercept alone. Repeated rows score alike. Without labels the score is near 0.
    An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    model = learn(shared(training_rows(docs, labels, "toxic", bound, TRAIN_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
