"""Quality by a byte-level convolutional network in numpy.

A text is covered from its first to its last byte by overlapping chunks. Bytes are embedded, learned filters slide over each chunk byte by byte, and
each filter keeps its maximum in the chunk. The chunk maxima are combined into one vector per
document, their maximum and their mean over all chunks, and one logistic unit gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm.common import small_batches, texts
from curvelake.llm.labelled import held_out, training_rows

#: Labelled rows to learn from, and bytes of all their texts; a text is learnt from as a whole or not at all.
TRAIN_DOCS, TRAIN_BYTES = 4_000, 32 << 20
CHUNK, OVERLAP, WIDTH = 256, 32, 8
EMBED, FILTERS = 6, 16
EPOCHS, BATCH, RATE = 12, 64, 4e-3
#: Chunks that are folded out at a time.
BLOCK = 512


def chunks(raw: bytes | None) -> np.ndarray:
    """Rows of CHUNK bytes, each OVERLAP bytes into the one before; zeros fill the last. An empty text is one row of zeros."""
    raw = raw or b""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Network:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embed = draw.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = draw.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.intercept = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.intercept]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBED) of embedded bytes."""
        flat = self.embed[rows].reshape(len(rows), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, ::EMBED]

    def maxima(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, after the ReLU, and where it is."""
        w = np.ascontiguousarray(self.windows(rows))
        response = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(rows), -1, FILTERS)
        at = response.argmax(1)
        top = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + self.bias
        return np.maximum(top, 0), at

    def score(self, raw: list[bytes | None]) -> np.ndarray:
        parts = [chunks(t) for t in raw]
        sizes = np.array([len(p) for p in parts])
        tops = np.empty((int(sizes.sum()), FILTERS), np.float32)
        done, waiting = 0, []
        for p in parts:
            for start in range(0, len(p), BLOCK):
                waiting.append(p[start : start + BLOCK])
                if sum(map(len, waiting)) >= BLOCK:
                    done = self._into(tops, done, waiting)
                    waiting = []
        if waiting:
            self._into(tops, done, waiting)
        return self.probability(self.pooled(tops, sizes))

    def _into(self, tops: np.ndarray, done: int, waiting: list[np.ndarray]) -> int:
        block = np.concatenate(waiting)
        tops[done : done + len(block)] = self.maxima(block)[0]
        return done + len(block)

    @staticmethod
    def pooled(tops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        if not len(sizes):
            return np.zeros((0, 2 * FILTERS), np.float32)
        return np.concatenate([np.maximum.reduceat(tops, starts), np.add.reduceat(tops, starts) / sizes[:, None]], 1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((pooled @ self.out + self.intercept).astype(np.float64), -30, 30)))

    def gradients(self, docs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        rows, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        parts = [self.maxima(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
        top, at = np.concatenate([t for t, _ in parts]), np.concatenate([a for _, a in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pooled = self.pooled(top, sizes)
        gap = ((self.probability(pooled) - y) / len(y)).astype(np.float32)
        back = gap[:, None] * self.out
        owner = np.repeat(np.arange(len(docs)), sizes)
        largest = top == pooled[owner, :FILTERS]
        ties = np.add.reduceat(largest, starts)[owner]
        to_top = (largest / ties * back[owner, :FILTERS] + (back[:, FILTERS:] / sizes[:, None])[owner]) * (top > 0)
        places = at[:, :, None] + np.arange(WIDTH)
        values = rows[np.arange(len(rows))[:, None, None], places]
        seen = self.embed[values].reshape(len(rows), FILTERS, WIDTH * EMBED)
        d_filters = np.einsum("cf,cfk->kf", to_top, seen)
        spread = (to_top[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(values.ravel(), spread[:, e], minlength=256) for e in range(EMBED)], 1)
        return [d_embed, d_filters, to_top.sum(0), pooled.T @ gap + 1e-4 * self.out, np.array([gap.sum()])]

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        """Adam over shuffled batches of documents."""
        base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        self.intercept[0] = np.log(base / (1 - base))
        if not 0 < y.sum() < len(y):
            self.out[:] = 0
            return self
        draw = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        epochs = max(epochs, -(-600 * BATCH // len(y)) if len(y) < 600 * BATCH // epochs else epochs)
        for epoch in range(epochs):
            order = draw.permutation(len(y))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                step += 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                for p, m, v, g in zip(self.parameters(), first, second, self.gradients([docs[k] for k in some], y[some])):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def fit(sample: pd.DataFrame, epochs: int = EPOCHS) -> Network:
    docs = [chunks(t.encode()) for t in sample["text"]]
    return Network().train(docs, sample["label"].to_numpy(np.float64), epochs)


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learnt from at most `bound` labelled rows and TRAIN_BYTES of text.

    Null and empty texts are one chunk of zeros and score as such. Repeated rows score alike. Without labels of both
    kinds every text scores the share of ones. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    network = fit(training_rows(docs, labels, "quality", bound, TRAIN_BYTES).toPandas().sort_values("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = network.score(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
