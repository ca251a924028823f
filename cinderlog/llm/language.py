"""Language of a text: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed runs of one to three characters of the
lower-cased text with blanks joined. Document frequencies come from all documents
that may be learned from. The weights are learned online with FTRL-proximal steps
and an elastic-net penalty, which leaves most of them zero, on a bounded sample of
``per_lang`` documents for each language (``most`` in all). A part of the sample
that is not fitted sets the temperature of the softmax.

A document is held out when crc32 of its id as text leaves 1 modulo 3; nothing is
learned from held-out documents or those without a language.

Rows: null texts and texts without a letter are ``und`` with score 0. Other
columns are ignored. Repeated rows are judged each for itself. Of equal scores the
first language in order wins. With nothing to learn from every text is ``und``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import mix, per_batch

BUCKETS = 1 << 15
PER_LANG, MOST = 750, 6000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
CHUNK = 1 << 20  # characters whose n-grams are in memory at once


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, ascending, and how often each occurs."""
    codes = np.frombuffer(
        (" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4"
    ).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), CHUNK):
        part = codes[max(at - 2, 0) : at + CHUNK]
        old = min(at, 2)  # characters before this part, whose own n-grams are counted
        for n in (1, 2, 3):
            if len(part) < n:
                continue
            key = np.full(len(part) - n + 1, n, np.uint64)
            for k in range(n):
                key = (key << np.uint64(20)) | part[k : len(part) - n + 1 + k]
            key = key[max(old - n + 1, 0) :]
            total += np.bincount((mix(key) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [bucket, language], the last row is the bias
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(text)
        value = (1 + np.log(n)) * self.idf[at]
        size = math.sqrt(float(value @ value)) or 1.0
        return at, value / size

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(*self.features(text)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05,
) -> np.ndarray:
    """Weights by follow-the-regularised-leader with per-coordinate steps."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros_like(z)

    def weights(at):
        short = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -short / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value, y = rows[k]
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            logit = value @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid that a golden ratio spaces."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(y)), y]).mean())

    return min((0.02 * 1.2**k for k in range(36)), key=loss)


def document_frequency(docs: DataFrame) -> np.ndarray:
    """How many documents hold each bucket: one partial vector a task, then sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[grams(text.as_py())[0]] += 1
                total[-1] += 1
                n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(run, "bucket int, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS + 1)
    df[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return df


def train(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST) -> Model:
    """Learn from ``docs`` (doc_id, text, lang) that are not held out."""
    usable = docs.where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    df = document_frequency(usable)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    want = max(1, min(per_lang, most // len(langs)))
    # a hash of the id below a share per language, then at most `want` of each
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, 1.3 * want / sizes[lang] + 20 / sizes[lang]))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = usable.where(draw < share[F.col("lang")])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2),
                pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32())),
            ],
            ["doc_id", "lang", "at", "n"],
        )

    sample = per_batch(
        drawn, step, "doc_id long, lang string, at array<int>, n array<int>"
    ).toPandas()
    sample["order"] = pd.util.hash_array(sample["doc_id"].to_numpy(dtype=np.int64))
    sample = sample.sort_values(["lang", "order", "doc_id"], kind="stable").groupby("lang").head(want)
    rows = []
    for at, n, lang in zip(sample["at"], sample["n"], sample["lang"]):
        at = np.asarray(at, np.int64)
        value = (1 + np.log(np.asarray(n, float))) * idf[at]
        rows.append((at, value / (math.sqrt(float(value @ value)) or 1.0), langs.index(lang)))
    check, fitted = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    model = Model(langs, idf, ftrl(fitted or rows, len(langs)))
    logits = np.array([model.logits(at, value) for at, value, _ in check])
    model.temperature = calibrated(logits, np.array([y for *_, y in check]))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.predict(t.as_py()) for t in batch.column(2)]
        langs, scores = zip(*found)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return per_batch(rows, step, "doc_id long, held_out boolean, lang_pred string, score double")
