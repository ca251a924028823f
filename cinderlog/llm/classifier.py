"""Quality of a text: random-indexing word vectors, pooled, and a small network.

Words are runs of letters, digits and underscores, or runs of signs, in their own
case. Every word has a sparse index vector, ``NONZERO`` signs at places
that its hash draws. The vector of a word is the sum of the index vectors of the
``WINDOW`` words before and after each of its occurrences in all documents, with
those before and after at places of their own; words share ``BUCKETS`` rows
by hash. Tasks add up what they read, and partial sums are added slice by slice as
they arrive, so memory is a fixed table whatever the corpus.

A document is pooled as mean and spread of its word vectors, those of frequent
words weighing less, and as mean product of successive ones. A network of two layers in numpy learns ``labels.quality`` from at
most ``most`` labelled documents, drawn by a hash of their id; every fifth
of them is not fitted and sets the temperature of the probabilities.

A document is held out when crc32 of its id as text leaves 0 modulo 5; no label
of a held-out document is learned from.

Rows: null, empty and wordless texts have a vector of zeros and its score. Repeated
rows are scored each for itself; of labels of one id the smallest counts. Other
columns are ignored. Without labels of both kinds every score is the smoothed share
of label 1, a half without any. Texts of any length are read in slices.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import per_batch

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 14, 64, 4, 2
HIDDEN, EPOCHS, BATCH = 32, 60, 128
MOST = 10_000
THRESHOLD = 0.3
SLICE = 1 << 17  # words whose vectors are in memory at once
PARTS = 64  # slices of the table of word vectors, as tasks pass them on
HELD_NAMES = 500_000
WORD = re.compile(r"\w+|[^\w\s]+")
LONG = 1 << 20  # characters from which a text's words are not listed at once


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Rows(dict):
    """Row of a word in the table of vectors."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_NAMES:
            self.clear()
        self[word] = k = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return k


def word_rows(text: str | None, rows: Rows) -> Iterator[np.ndarray]:
    """The words of a text as rows, some at a time."""
    text = text or ""
    words = WORD.findall(text) if len(text) < LONG else (m[0] for m in WORD.finditer(text))
    found = map(rows.__getitem__, words)
    while len(part := np.fromiter(islice(found, SLICE), np.int64)):
        yield part


def index_vectors() -> np.ndarray:
    """Sparse signs for every row and side (before, after)."""
    draw = np.random.default_rng(11)
    out = np.zeros((2, BUCKETS, DIMS), np.int8)
    for side in out:
        for _ in range(NONZERO):
            side[np.arange(BUCKETS), draw.integers(0, DIMS, BUCKETS)] = draw.choice([-1, 1], BUCKETS)
    return out


def add_contexts(total: np.ndarray, rows: np.ndarray, index: np.ndarray) -> None:
    """Add to each row's sum what stands around its occurrences; the last column counts them."""
    around = np.zeros((len(rows), DIMS), np.int32)
    before, after = index[0][rows], index[1][rows]
    for k in range(1, WINDOW + 1):
        around[k:] += before[:-k]
        around[:-k] += after[k:]
    order = np.argsort(rows, kind="stable")
    at, starts = np.unique(rows[order], return_index=True)
    total[at, :DIMS] += np.add.reduceat(around[order], starts, axis=0)
    total[at, DIMS] += np.diff(np.append(starts, len(rows)))


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all rows, of length one, and how often each row occurs."""
    index = docs.sparkSession.sparkContext.broadcast(index_vectors())  # a fixed table
    size = BUCKETS // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, some = np.zeros((BUCKETS, DIMS + 1), np.int64), Rows(), False
        for batch in batches:
            for text in batch.column(0):
                for part in word_rows(text.as_py(), rows):
                    add_contexts(total, part, index.value)
                    some = True
        if some:
            for k in range(PARTS):
                yield piece(k, total[k * size : (k + 1) * size])

    def piece(k: int, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([table.astype("<i8").tobytes()], pa.binary())],
            ["part", "sums"],
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sent in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(sent.as_py(), "<i8").reshape(size, DIMS + 1)
                total[k] = total[k] + part if k in total else part
        for k, table in total.items():
            yield piece(k, table)

    partial = docs.select("text").mapInArrow(sums, "part int, sums binary")
    # PARTS rows of a fixed size
    found = partial.repartition(PARTS, "part").mapInArrow(added, "part int, sums binary").collect()
    total = np.zeros((BUCKETS, DIMS + 1))
    for r in found:
        total[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["sums"], "<i8").reshape(size, -1)
    vectors, n = total[:, :DIMS], total[:, DIMS]
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32), n


@dataclass
class Model:
    vectors: np.ndarray  # [row, dim]
    weights: np.ndarray  # by row, less for frequent ones
    layers: list[np.ndarray] | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0
    share: float = 0.5

    def pooled(self, text: str | None, rows: Rows) -> np.ndarray:
        """Mean and spread of the text's word vectors, mean product of successive ones."""
        weight, first, second = 0.0, np.zeros(DIMS), np.zeros(DIMS)
        pairs, product, last = 0, np.zeros(DIMS), np.empty(0, np.int64)
        for part in word_rows(text, rows):
            row = self.vectors[np.concatenate([last, part])]
            product += np.einsum("ij,ij->j", row[:-1], row[1:], dtype=np.float64)
            pairs, last = pairs + len(row) - 1, part[-1:]
            # equal words at once
            at, n = np.unique(part, return_counts=True)
            w, v = self.weights[at] * n, self.vectors[at].astype(np.float64)
            weight += w.sum()
            first += w @ v
            second += w @ (v * v)
        if not weight:
            return np.zeros(3 * DIMS)
        mean = first / weight
        spread = np.sqrt(np.maximum(second / weight - mean * mean, 0))
        return np.concatenate([mean, spread, product / max(pairs, 1)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(model: Model, x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rate: float = 3e-3) -> None:
    """Learn both layers by Adam steps on the log loss."""
    draw = np.random.default_rng(5)
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.layers = [
        draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1),
    ]
    x = (x - model.centre) / model.scale
    speed = [np.zeros_like(p) for p in model.layers]
    spread = [np.zeros_like(p) for p in model.layers]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            w1, _, w2, _ = model.layers
            inner = x[part] @ w1 + model.layers[1]
            hidden = np.maximum(inner, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + model.layers[3][0], -50, 50)))
            off = (p - y[part]) / len(part)
            back = np.outer(off, w2) * (inner > 0)
            grads = [
                x[part].T @ back + decay * w1, back.sum(axis=0), hidden.T @ off + decay * w2,
                np.array([off.sum()]),
            ]
            step += 1
            for k, g in enumerate(grads):
                speed[k] = 0.9 * speed[k] + 0.1 * g
                spread[k] = 0.999 * spread[k] + 0.001 * g * g
                model.layers[k] = model.layers[k] - rate * (speed[k] / (1 - 0.9**step)) / (
                    np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8
                )


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a geometric grid."""

    def loss(t: float) -> float:
        z = logits / t
        return float((np.logaddexp(0, z) - y * z).mean())

    return min((0.1 * 1.15**k for k in range(50)), key=loss)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Word vectors from all ``docs`` (doc_id, text), the network from labels (doc_id, quality)."""
    vectors, n = word_vectors(docs)
    share = n / max(n.sum(), 1)
    model = Model(vectors, np.where(n > 0, 1e-3 / (1e-3 + share), 1e-3))
    # at most `most` ids, by a hash of the id
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    drawn = (
        usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    # one text of an id, so no more rows than ids
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    )

    kept = Rows()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pooled = Model(**sent.value).pooled
        found = [pooled(t.as_py(), kept) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))],
            ["doc_id", "quality", "x"],
        )

    sample = per_batch(rows, step, "doc_id long, quality int, x array<double>").toPandas()
    sample = sample.sort_values("doc_id")
    y = sample["quality"].to_numpy(dtype=float)
    model.share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y)) == 2:
        x = np.stack(sample["x"].to_numpy())
        check = np.arange(len(y)) % 5 == 4
        fit(model, x[~check], y[~check])
        if check.any():
            model.temperature = calibrated(model.logits(x[check]), y[check])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # BUCKETS x DIMS numbers
    kept = Rows()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = Model(**sent.value)
        found = model.scores(np.stack([model.pooled(t.as_py(), kept) for t in batch.column(2)]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(found, pa.float64()),
                pa.array((found >= threshold).astype(np.int32)),
            ],
            ["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return per_batch(rows, step, "doc_id long, held_out boolean, score double, predicted int")
