"""Token vectors for templates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import vectors
from cinderlog.session import parallelism

# A caller's model: made once per worker, it maps sentences to one float matrix
# (tokens x dims) each.
Embedder = Callable[[list[str]], list[np.ndarray]]


class HashEmbedder:
    """The built-in vectors through the plug-in door, as an example model."""

    def __call__(self, sentences: list[str]) -> list[np.ndarray]:
        out = []
        for sentence in sentences:
            words = sentence.split(" ")
            sums = np.array(
                [list(hashlib.md5(w.encode()).digest()) for w in words], dtype=np.int64
            ) * 2 - 255
            mean = sums.sum(axis=0) / (len(words) * 255)
            out.append(np.vstack([mean, sums / 255]).astype(np.float32))
        return out


def embed_builtin(table: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Add ``tokens`` (array of vectors) by column expressions alone."""
    return table.withColumn("tokens", vectors.hash_tokens(F.col(sentence)))


def embed_templates(
    table: DataFrame,
    make_embedder: Callable[[], Embedder],
    id_: str = "template_id",
    sentence: str = "sentence",
    batch: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """(id, sentence, tokens): a caller's model over distinct templates.

    The model is made once per task and fed ``batch`` sentences at a time; a
    task holds one batch of vectors. The few, costly sentences go to ``tasks`` tasks.
    """
    todo = table.select(id_, sentence).repartition(
        tasks or parallelism(table.sparkSession), id_
    )
    id_type = todo.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make_embedder()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                matrices = embed(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), nested(matrices)],
                    names=[id_, sentence, "tokens"],
                )

    return todo.mapInArrow(
        run, f"`{id_}` {id_type}, `{sentence}` string, tokens array<array<float>>"
    )


def nested(matrices: list[np.ndarray]) -> pa.Array:
    """Matrices as an Arrow list of lists, without a loop over numbers."""
    rows = np.cumsum([0] + [len(m) for m in matrices])
    flat = [np.ascontiguousarray(m, dtype=np.float32) for m in matrices]
    values = np.concatenate([m.ravel() for m in flat]) if flat else np.empty(0, np.float32)
    widths = np.concatenate(
        [np.zeros(1, np.int64)] + [np.full(len(m), m.shape[1], np.int64) for m in flat]
    )
    inner = pa.ListArray.from_arrays(
        pa.array(np.cumsum(widths), pa.int32()), pa.array(values, pa.float32())
    )
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), inner)


def with_first(embedded: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Slot 0 as its own column, so that a step which needs no more than it
    reads no token matrix from storage."""
    return embedded.withColumn("first", vectors.pool_first(F.col(tokens)))


POOLS = {"first": vectors.pool_first, "mean": vectors.pool_mean}


def pool(embedded: DataFrame, how: str, tokens: str = "tokens", out: str = "vector") -> DataFrame:
    return embedded.withColumn(out, POOLS[how](F.col(tokens)))
