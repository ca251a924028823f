"""Quality rules by line labelling: a linear-chain conditional random field.

Every line with a word is content or boilerplate. Its shape (length, shares of
letters, capitals, digits, symbols and punctuation, repetition) scores
each label, a learned weight scores each pair of neighbouring labels, and Viterbi
decoding finds the best sequence. A document stays when content lines hold enough
of its word characters and the plain rules do not reject it.

The field is fitted on a bounded sample of labelled documents (``sample`` for
each class, ``train_lines`` successive lines of each) that the plain rules do not
reject. Labels are of documents, so lines are learned in turns: first each line takes
its document's label and stands alone, then the documents are decoded and the field
is fitted to the decoded lines (hard expectation maximisation). Judging reads
all lines of all documents.

Rows: null and empty texts have no words and fail the plain rules. Repeated rows
are judged each for itself; other columns are ignored by ``judge`` and kept by
``kept_rows``. Without labelled documents of both classes every line is content.
A label tie is content. Of several labels for a document the lowest counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.common import per_batch, window_hashes, words_of

SAMPLE = 1000
TRAIN_LINES = 200
ROUNDS = 2  # of decoding and fitting in turn
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = 12
BLANK, LOWER, UPPER, DIGIT, SYMBOL, POINT, OTHER, LETTER = range(8)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each character of the basic plane."""
    kind = np.full(1 << 16, OTHER, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.islower():
            kind[code] = LOWER
        elif c.isupper():
            kind[code] = UPPER
        elif c.isalpha():
            kind[code] = LETTER
        elif c.isdigit():
            kind[code] = DIGIT
    kind[[32, *range(9, 14)]] = BLANK
    kind[[ord(c) for c in SYMBOLS]] = SYMBOL
    kind[[ord(c) for c in ".,;:"]] = POINT
    return kind


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of five words that the text has twice or more."""
    if len(hashes) <= WINDOW:
        return 0
    windows = window_hashes(hashes, WINDOW)
    _, which, n = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[which] > 1)
    if not len(at):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[at] += 1
    np.subtract.at(edges, at + WINDOW, 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """The plain counts, and of the lines with a word their features and word characters."""
    words = words_of(text)
    if not words:
        return (0, 0, 0, 0, 0), np.empty((0, FEATURES)), np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds()[np.minimum(codes, 0xFFFF)]
    breaks = codes == 10
    line = np.cumsum(breaks)  # a line break counts with the line after it
    n_lines = int(line[-1]) + 1
    counts = np.bincount(line * 8 + kind, minlength=8 * n_lines).reshape(-1, 8).astype(float)
    blank = kind == BLANK
    starts = ~blank & np.concatenate(([True], blank[:-1]))
    of_word = line[starts]
    n_words = np.bincount(of_word, minlength=n_lines).astype(float)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    again = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    same = np.bincount(of_word[1:][again], minlength=n_lines)
    chars = counts.sum(axis=1) - counts[:, BLANK]
    seen: set[str] = set()
    dup = np.zeros(n_lines)
    used = np.flatnonzero(n_words)
    lines = text.split("\n")
    for k in used.tolist():
        if lines[k] in seen:
            dup[k] = 1
        else:
            seen.add(lines[k])
    stats = (
        len(words), int(chars.sum()), int(counts[:, SYMBOL].sum()), int(dup.sum()),
        repeated_words(hashes),
    )
    c, w, n, d = counts[used], n_words[used], chars[used], dup[used]
    features = np.column_stack(
        (
            np.ones(len(used)), np.log1p(w), np.log1p(n / w),
            c[:, LOWER] / n, c[:, UPPER] / n, c[:, DIGIT] / n, c[:, SYMBOL] / n,
            c[:, POINT] / w, np.minimum(c[:, OTHER] / w, 2), np.minimum(c[:, SYMBOL] / w, 2),
            d, same[used] / w,
        )
    )
    return stats, features, n.astype(np.int64)


@dataclass
class Field:
    """``weights`` per feature score content against boilerplate; ``moves`` label pairs."""

    weights: np.ndarray
    moves: np.ndarray  # [from, to], 0 boilerplate, 1 content
    mean: np.ndarray
    scale: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels, True for content."""
        n = len(features)
        if not n:
            return np.empty(0, bool)
        gain = (((features - self.mean) / self.scale) @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.moves.tolist()
        back, b, c = [], 0.0, gain[0]
        for g in gain[1:]:
            to_c, to_b = (c + cc >= b + bc), (c + cb >= b + bb)
            b, c = (c + cb if to_b else b + bb), (c + cc if to_c else b + bc) + g
            back.append((to_b, to_c))
        label = c >= b
        labels = [label]
        for from_b, from_c in reversed(back):
            label = from_c if label else from_b
            labels.append(label)
        return np.array(labels[::-1], bool)


def everything_content() -> Field:
    return Field(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES))


def alternate(sequences: list[tuple[np.ndarray, np.ndarray]], chars: list[np.ndarray]) -> Field:
    """Learn lines from labels of documents: hard expectation maximisation.

    The first field has no moves and takes all lines of a document to be of its label. Then
    decoding the documents and fitting their decoded lines take turns. A document that
    decoding would put on the wrong side keeps its own label for all lines.
    """
    if len({int(y[0]) for _, y in sequences}) < 2:
        return everything_content()
    field = fit(sequences, chained=False)
    for _ in range(ROUNDS):
        decoded = []
        for (x, y), n in zip(sequences, chars):
            labels = field.decode(x)
            right = (n[labels].sum() >= CONTENT_SHARE * n.sum()) == bool(y[0])
            decoded.append((x, labels.astype(int) if right else y))
        field = fit(decoded, good=[bool(y[0]) for _, y in sequences])
    return field


def fit(
    sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 250, ridge: float = 1.0,
    good: list[bool] | None = None, chained: bool = True,
) -> Field:
    """Maximum likelihood with a ridge penalty, by gradient steps with momentum (Adam).

    All sequences advance together, one line at a time, through the forward and
    backward sums. Documents of the two classes (``good`` or not; by default those of mostly
    content) weigh the same in total. Without ``chained`` lines stand alone: all moves weigh 0.
    """
    if len({int(label) for _, y in sequences for label in y}) < 2:
        return everything_content()
    every = np.concatenate([x for x, _ in sequences])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    mean[0], scale[scale < 1e-9] = 0, 1
    rows, longest = len(sequences), max(len(y) for _, y in sequences)
    x = np.zeros((longest, rows, FEATURES))
    y = np.zeros((longest, rows), int)
    there = np.zeros((longest, rows))
    for k, (features, labels) in enumerate(sequences):
        n = len(labels)
        x[:n, k], y[:n, k], there[:n, k] = (features - mean) / scale, labels, 1
    good = np.array([labels.mean() > 0.5 for _, labels in sequences] if good is None else good)
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    weight = weight / there.sum(axis=0) * rows
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pairs = there[1:]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = (weight * ((y[:-1] == a) & (y[1:] == b)) * pairs).sum()
    for step in range(1, steps + 1):
        moves = theta[FEATURES:].reshape(2, 2)
        score = np.stack((np.zeros((longest, rows)), x @ theta[:FEATURES]), axis=2)
        ahead = np.empty_like(score)
        ahead[0] = score[0]
        for t in range(1, longest):
            nxt = np.logaddexp(ahead[t - 1, :, :1] + moves[0], ahead[t - 1, :, 1:] + moves[1]) + score[t]
            ahead[t] = np.where(there[t][:, None] > 0, nxt, ahead[t - 1])
        behind = np.zeros_like(score)
        for t in range(longest - 2, -1, -1):
            nxt = score[t + 1] + behind[t + 1]
            prev = np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
            behind[t] = np.where(there[t + 1][:, None] > 0, prev, 0)
        total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
        content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total) * there
        off = (y * there - content) * weight
        grad = np.zeros_like(theta)
        grad[:FEATURES] = np.tensordot(off, x, axes=2)
        for a in (0, 1):
            for b in (0, 1):
                joint = ahead[:-1, :, a] + moves[a, b] + score[1:, :, b] + behind[1:, :, b] - total
                expected = (np.exp(np.minimum(joint, 0)) * pairs * weight).sum()
                grad[FEATURES + 2 * a + b] = seen[a, b] - expected
        if not chained:
            grad[FEATURES:] = 0
        grad = grad / rows - ridge * theta / rows
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), mean, scale)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_lines: int = TRAIN_LINES
) -> Field:
    """Fit on at most ``sample`` documents of each quality, drawn by a hash of the id, and of
    each at most ``train_lines`` successive lines, from a place that the id draws."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = None
    for quality in (0, 1):
        some = labels.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = some if drawn is None else drawn.unionByName(some)
    # at most 2 * sample rows are sent to the tasks
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, quality, values, chars = [], [], [], []
        for doc_id, text, q in zip(*(c.to_pylist() for c in batch.columns)):
            stats, features, n = measure(text)
            if not base_failed(stats):
                # of a long document one run of lines, drawn by its id
                at = doc_id % (len(n) - train_lines + 1) if len(n) > train_lines else 0
                ids.append(doc_id)
                quality.append(q)
                values.append(features[at : at + train_lines].ravel())
                chars.append(n[at : at + train_lines])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(quality, pa.int32()),
                pa.array(values, pa.list_(pa.float64())), pa.array(chars, pa.list_(pa.int64())),
            ],
            ["doc_id", "quality", "features", "chars"],
        )

    found = per_batch(
        rows.select("doc_id", "text", F.col("quality").cast("int")), step,
        "doc_id long, quality int, features array<double>, chars array<long>",
    ).toPandas()
    sequences, chars = [], []
    for _, quality, values, n in sorted(found.itertuples(index=False), key=lambda r: (r[0], r[1], len(r[2]))):
        features = np.asarray(values).reshape(-1, FEATURES)
        sequences.append((features, np.full(len(features), int(quality))))
        chars.append(np.asarray(n))
    return alternate(sequences, chars) if sequences else everything_content()


def base_failed(stats: tuple[int, ...]) -> bool:
    n_words, repeated = stats[0], stats[4]
    return n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words


def verdict(text: str | None, field: Field) -> tuple:
    """The plain counts, base_failed, kept and the content share of a text."""
    stats, features, chars = measure(text)
    failed = base_failed(stats)
    share = float(chars[field.decode(features)].sum() / chars.sum()) if len(chars) else 0.0
    return (*stats, failed, not failed and share >= CONTENT_SHARE, share)


def judge(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, content_share) of every document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [verdict(t.as_py(), field) for t in batch.column(1)]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], names)

    schema = f"doc_id long, {STATS}, base_failed boolean, kept boolean, content_share double"
    names = [x.split()[0] for x in schema.split(", ")]
    return per_batch(docs.select("doc_id", "text"), step, schema)


def kept_rows(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    at = docs.columns.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        stays = [verdict(t.as_py(), field)[6] for t in batch.column(at)]
        return batch.filter(pa.array(stays, pa.bool_()))

    return per_batch(docs, step, docs.schema)
