"""Benchmark decontamination: BM25 retrieval of test items by every training passage.

The test items are the indexed documents, each passage of a training document is
a query. A passage is two neighbouring segments of ``segment`` words, so every run
of up to ``segment`` words lies whole in a passage; a segment is as long as the
longest item. Scores are shares of the score an item gives itself, so one
threshold holds for all items and nothing is cut off by a top-k.

Skipping follows block-max WAND. Postings hold blocks of items with the largest
impact in each. A document's term lists are read from the rarest on; the ``rest``
of an item, all it can still gain from its unread, most common terms, stays below
the threshold. First the blocks' largest impacts are summed for each passage, and
blocks whose sum and rest stay below the threshold are skipped. Then the postings
of the other blocks are summed, and an item is the pivot, scored in full, when its
sum and rest reach the threshold. Both bounds hold for every passage, so skipping
loses nothing.

Every retrieved pair is verified on word order: the shares of the question's and
of the answer's runs of three words that occur in the passage must both reach
``OVERLAP``. Items without question and answer columns are verified as a whole, by
the share of all runs of ``text``, which stands in ``question_overlap``; the other
share is 1, as for every empty side.

Rows: null and empty texts hold no leak; items without a word are left out. A pair
of document and item gives one row, that of its best passage (the first of equal
ones); repeated documents or items give rows of their own. Other columns are
ignored by ``find`` and kept by ``clean_rows``. Empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm.common import per_batch

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
REST = 0.3  # most of an item's own score that its unread terms may hold
BLOCK = 8  # items
RUN = 3
SLICE_CHARS = 64_000_000  # of items in one index; more items are searched slice by slice
CHUNK_WORDS = 40_000
WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


class Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return -1


def runs(words: list[str]) -> set[tuple[str, ...]]:
    n = min(RUN, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


@dataclass
class Lists:
    """Postings of all terms one after another: term t has entries start[t] to start[t + 1]."""

    start: np.ndarray
    target: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, term: np.ndarray, target: np.ndarray, impact: np.ndarray, terms: int) -> "Lists":
        order = np.lexsort((target, term))
        term, target, impact = term[order], target[order], impact[order]
        return cls(np.searchsorted(term, np.arange(terms + 1)), target, impact)

    def read(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the given terms: which of ``terms`` each belongs to, and its place."""
        n = self.start[terms + 1] - self.start[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        first = np.repeat(self.start[terms] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return owner, first + np.arange(len(owner))


@dataclass
class Index:
    ids: list
    questions: list[set]
    answers: list[set]
    vocabulary: Vocabulary
    weights: list[dict[int, float]]
    rare: Lists
    blocks: Lists
    rest: np.ndarray  # of each item
    block_rest: np.ndarray
    segment: int


def build(items: pd.DataFrame, df: dict[str, int], n_items: int, mean_words: float) -> Index | None:
    """Index of (item_id, question, answer) rows, ``df`` counting all items by word."""
    ids, question, answer, bags = [], [], [], []
    for item_id, q, a in items.itertuples(index=False):
        q, a = WORD.findall((q or "").lower()), WORD.findall((a or "").lower())
        if q or a:
            ids.append(item_id)
            question.append(runs(q))
            answer.append(runs(a))
            bags.append(q + a)
    if not ids:
        return None
    vocabulary = Vocabulary({w: k for k, w in enumerate(sorted({w for bag in bags for w in bag}))})
    weights, entries, rest = [], [], np.zeros(len(ids))
    for k, bag in enumerate(bags):
        size = K1 * (1 - B + B * len(bag) / mean_words)
        own = {}
        for w in set(bag):
            tf = bag.count(w)
            idf = np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
            own[vocabulary[w]] = idf * tf * (K1 + 1) / (tf + size)
        total = sum(own.values())
        own = {t: x / total for t, x in own.items()}
        weights.append(own)
        common = sorted(own, key=lambda t: (own[t], t))
        while common and rest[k] + own[common[0]] <= REST:
            rest[k] += own[common.pop(0)]
        entries += [(t, k, own[t]) for t in common]
    terms = np.array([e[0] for e in entries])
    target = np.array([e[1] for e in entries])
    impact = np.array([e[2] for e in entries])
    rare = Lists.of(terms, target, impact, len(vocabulary))
    top = pd.DataFrame({"t": terms, "b": target // BLOCK, "x": impact}).groupby(["t", "b"])["x"].max().reset_index()
    blocks = Lists.of(top["t"].to_numpy(), top["b"].to_numpy(), top["x"].to_numpy(), len(vocabulary))
    n_blocks = (len(ids) + BLOCK - 1) // BLOCK
    block_rest = np.zeros(n_blocks)
    np.maximum.at(block_rest, np.arange(len(ids)) // BLOCK, rest)
    segment = max(16, max(map(len, bags)))
    return Index(ids, question, answer, vocabulary, weights, rare, blocks, rest, block_rest, segment)


def passage_sums(segment: np.ndarray, target: np.ndarray, impact: np.ndarray, width: int):
    """Sums by (passage, target): passage k is segments k and k + 1, a bound if both hold a term."""
    key, which = np.unique(segment * width + target, return_inverse=True)
    total = np.bincount(which, impact, len(key))
    both = np.concatenate((key, key - width))
    key, which = np.unique(both, return_inverse=True)
    total = np.bincount(which, np.concatenate((total, total)), len(key))
    ok = key >= 0
    return key[ok] // width, key[ok] % width, total[ok]


def candidates(index: Index, terms: np.ndarray, segment: np.ndarray) -> list[tuple[int, int]]:
    """(passage, item) pairs whose bound reaches the threshold."""
    known = terms >= 0
    known[known] = index.rare.start[terms[known] + 1] > index.rare.start[terms[known]]
    if not known.any():
        return []
    wide = len(index.vocabulary)
    pair = np.unique(segment[known].astype(np.int64) * wide + terms[known])
    segment, terms = pair // wide, pair % wide
    slack = 1e-9
    # block bounds first
    owner, at = index.blocks.read(terms)
    passage, block, total = passage_sums(
        segment[owner], index.blocks.target[at], index.blocks.impact[at], len(index.block_rest)
    )
    good = total + index.block_rest[block] >= THRESHOLD - slack
    if not good.any():
        return []
    live = np.zeros(int(segment.max()) + 2, bool)
    live[passage[good]] = live[passage[good] + 1] = True
    alive = set((passage[good] * len(index.block_rest) + block[good]).tolist())
    # then the postings that can matter, item by item
    stays = live[segment]
    owner, at = index.rare.read(terms[stays])
    passage, item, total = passage_sums(
        segment[stays][owner], index.rare.target[at], index.rare.impact[at], len(index.ids)
    )
    good = total + index.rest[item] >= THRESHOLD - slack
    n = len(index.block_rest)
    return [
        (p, i) for p, i in zip(passage[good].tolist(), item[good].tolist()) if p * n + i // BLOCK in alive
    ]


def search(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
    """(position of the text, position of the item, score, question and answer overlap)."""
    look = index.vocabulary.__getitem__
    waiting: list[tuple[int, list[str]]] = []
    held = 0

    def flush():
        size, at = index.segment, 0
        parts, owners, firsts = [], [], []
        for k, words in waiting:
            segment = at + np.arange(len(words)) // size
            parts.append((np.fromiter(map(look, words), np.int64, len(words)), segment))
            n = int(segment[-1]) - at + 1
            owners += [k] * n
            firsts += [(words, j * size) for j in range(n)]
            owners.append(-1)  # an empty segment, so that no passage spans two texts
            firsts.append(([], 0))
            at += n + 1
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        terms, segments = (np.concatenate(x) for x in zip(*parts))
        for passage, item in candidates(index, terms, segments):
            if owners[passage] < 0:
                continue
            words, first = firsts[passage]
            part = words[first : first + 2 * size]
            own = index.weights[item]
            score = sum(own.get(t, 0.0) for t in set(map(look, part)))
            if score < THRESHOLD - 1e-9:
                continue
            text, there = " " + " ".join(part) + " ", []
            for wanted in (index.questions[item], index.answers[item]):
                hit = sum(f" {' '.join(r)} " in text for r in wanted)
                there.append(hit / len(wanted) if wanted else 1.0)
            if min(there) >= OVERLAP:
                key = (owners[passage], item)
                if key not in best or score > best[key][0] + 1e-9:
                    best[key] = (score, *there)
        yield from ((k, i, *v) for (k, i), v in best.items())

    for k, text in enumerate(texts):
        words = WORD.findall(text.lower()) if text else []
        if words:
            waiting.append((k, words))
            held += len(words)
        if held >= CHUNK_WORDS:
            yield from flush()
            waiting, held = [], 0
    if waiting:
        yield from flush()


def with_answers(items: DataFrame) -> DataFrame:
    """(item_id, question, answer); without these columns the whole text and no answer."""
    if {"question", "answer"} <= set(items.columns):
        return items.select("item_id", "question", "answer")
    return items.where(F.col("text").isNotNull()).select(
        "item_id", F.col("text").alias("question"), F.lit("").alias("answer")
    )


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of slices of the items, each of bounded size; word counts span all items."""
    items = with_answers(items)
    text = F.concat_ws(" ", "question", "answer")
    size = items.agg(
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.count("*").alias("n"),
        F.coalesce(F.sum(F.size(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))), F.lit(0)).alias("words"),
    ).first()
    if not size["n"]:
        return
    slices = size["chars"] // SLICE_CHARS + 1
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).toPandas()
        part = part.sort_values("item_id", kind="stable")
        bags = [set(WORD.findall(f"{q or ''} {a or ''}".lower())) for q, a in zip(part["question"], part["answer"])]
        df: dict[str, int] = {}
        for bag in bags:
            for w in bag:
                df[w] = df.get(w, 0) + 1
        if slices > 1:  # the other slices' items count too
            mine = items.sparkSession.createDataFrame([(w,) for w in df], "word string")
            every = items.select(
                F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))).alias("word")
            )
            counted = every.join(mine, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
            df |= {r["word"]: max(df[r["word"]], r["n"]) for r in counted.toLocalIterator()}
        index = build(part, df, size["n"], max(1.0, size["words"] / size["n"]))
        if index is not None:
            yield index


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks: (doc_id, item_id, score, question_overlap, answer_overlap)."""
    spark, out = docs.sparkSession, None
    for index in indexes(items):
        found = per_batch(docs.select("doc_id", "text"), _finder(spark, index), FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def _finder(spark: SparkSession, index: Index):
    sent = spark.sparkContext.broadcast(index)  # at most SLICE_CHARS of items
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index, ids = sent.value, batch.column(0).to_pylist()
        rows = [(ids[k], index.ids[i], *rest) for k, i, *rest in search(index, batch.column(1).to_pylist())]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return step


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no leak, with all their columns."""
    at = docs.columns.index("text")
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def step(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            hit = {k for k, *_ in search(sent.value, batch.column(at).to_pylist())}
            return batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))

        docs = per_batch(docs, step, docs.schema)
    return docs
