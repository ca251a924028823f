"""A block of test rows meets a stream of bank rows.

A task holds one block of the test side, whose size is bounded (``blocks``), and reads
the bank rows sent to it in Arrow batches, so the bank side takes no room that grows with
it. The bank is read once per test block: there are no more of those than keep all
cores busy, unless size asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_TEST_ROWS = 16
TEST, BANK = 0, 1


def slots(spark: SparkSession) -> int:
    """Tasks of like length that keep every core busy. Not the number of shuffle
    partitions, which grows with the data: the bank is copied to each."""
    return 3 * spark.sparkContext.defaultParallelism


def cut(spark: SparkSession, rows: int) -> tuple[int, int]:
    """(blocks, parts): into how many blocks the test rows go, size aside, and how many
    tasks share the bank of each where test rows are few."""
    n = max(1, min(-(-rows // MIN_TEST_ROWS), slots(spark)))
    return n, max(1, slots(spark) // n)


def upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def streamed(rows: DataFrame, places: int, *order: str) -> DataFrame:
    """Rows (place, side, …) at their place, test side first."""
    return rows.repartitionById(places, F.col("place").cast("int")).sortWithinPartitions("place", "side", *order)


def runs(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Where rows with equal values begin and end."""
    n = batch.num_rows
    change = np.zeros(n, bool)
    change[:1] = True
    for name in names:
        column = batch.column(name).to_numpy(zero_copy_only=False)
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    yield from zip(starts.tolist(), np.append(starts[1:], n).tolist())


def walked(make: Callable, names: tuple[str, ...] = ()) -> Callable:
    """For ``mapInArrow``: ``make(batches)`` holds a place's test rows, its ``meet`` gets
    the bank rows, cut where ``names`` change, and its ``found`` gives the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            for start, stop in runs(batch, ("place", "side", *names)):
                part = batch.slice(start, stop - start)
                place = part.column("place")[0].as_py()
                if place != now:
                    if held:
                        yield from held.found()
                    now, waiting, held = place, [], None
                if part.column("side")[0].as_py() == TEST:
                    waiting.append(part)
                elif waiting or held:
                    if held is None:
                        held, waiting = make(waiting), []
                    held.meet(part)
        if held:
            yield from held.found()

    return run
