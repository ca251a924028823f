"""Nearest neighbours without a look at every pair.

A few pivots lie far apart in the bank. Bank and test rows go to
their nearest pivot, and blocks are cut along the distance to it, so a block is
a ring with known nearest and farthest distances to every pivot. By the triangle
inequality these bound the distance of a test block to a bank block from both sides.
The upper bounds of the nearest blocks that hold k rows together limit what a
test block can need; blocks beyond that are not even sent to it. The rest arrive
nearest first, in pieces, and the k-th best so far leaves out more of them, row by row. A
task holds one test block and its k best.

Exact; bounds allow for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.operators import blocks, streams

PIVOTS = 16
SAMPLE = 1024  # bank rows that pivots are chosen from
BANK_BLOCKS = 1024  # sent as a whole, looked into by pieces
TEST_FLOATS = 8_000_000  # that a task holds
TILE_BANK, TILE_PAIRS = 1024, 1_000_000
ROWS_OUT = 100_000


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal width, one to a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sampled(bank: DataFrame, column: str) -> pa.Table:
    """``SAMPLE`` rows at most, by a hash of the id."""
    return (
        bank.orderBy(F.xxhash64("bank_id"), "bank_id").limit(SAMPLE).select(column).toArrow().combine_chunks()
    )


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """The first row, then each time the one farthest from those taken."""
    taken = [0]
    near = np.linalg.norm(rows - rows[0], axis=1)
    while len(taken) < min(n, len(rows)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(rows - rows[taken[-1]], axis=1))
    return rows[taken]


def to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(rows - p, axis=1) for p in pivots], axis=1)


def _placed(side: DataFrame, prefix: str, pivots: np.ndarray, extra: int) -> DataFrame:
    """(id, values, _floats, cell, own, dist): the nearest pivot, the distance to it and to all."""
    kind = side.schema[f"{prefix}_values"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist = to_pivots(matrix(batch.column(1)), pivots)
                cell = dist.argmin(axis=1)
                flat = pa.array(dist.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)),
                        pa.array(dist[np.arange(len(cell)), cell]),
                        pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32) * len(pivots), flat),
                    ],
                    ["id", "values", "_floats", "cell", "own", "dist"],
                )

    plain = side.select(
        f"{prefix}_id", f"{prefix}_values", (F.col("_floats") + extra).cast("long").alias("_floats")
    )
    return plain.mapInArrow(
        run, f"id long, values {kind}, _floats long, cell int, own double, dist array<double>"
    )


def _rings(placed: DataFrame, bound: int) -> DataFrame:
    """Add ``block``: rows of a pivot, in order of their distance to it."""
    cut = blocks.packed(placed, F.struct("own", "id"), bound, by=("cell",))
    return cut.withColumn("block", F.shiftleft(F.col("cell").cast("long"), 40) + F.col("block"))


def _ranges(rings: DataFrame, n: int) -> DataFrame:
    """(block, rows, near, far): distances to every pivot, of the nearest and the farthest row."""
    dist = F.col("dist")
    return rings.groupBy("block").agg(
        F.count("*").alias("rows"),
        F.array(*(F.min(dist[i]) for i in range(n))).alias("near"),
        F.array(*(F.max(dist[i]) for i in range(n))).alias("far"),
    )


class Ranges:
    """What is known of the bank's blocks: 16 bytes a pivot and block."""

    def __init__(self, rows: pa.Table):
        self.at = {b: i for i, b in enumerate(rows.column("block").to_pylist())}
        self.rows = rows.column("rows").to_numpy()
        self.near, self.far = (matrix(rows.column(c).combine_chunks()) for c in ("near", "far"))

    def least(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """No row of a block is nearer than this to rows at near to far from the pivots."""
        gap = np.maximum(self.near - far, near - self.far).max(axis=1)
        return np.maximum(gap - _slack(self.far.max(axis=1)), 0)

    def needed(self, near: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that may hold one of the k nearest, and the bound of each."""
        most = (self.far + far).min(axis=1)
        most = most + _slack(most)
        order = np.argsort(most, kind="stable")
        enough = np.searchsorted(np.cumsum(self.rows[order]), k)
        limit = most[order[enough]] if enough < len(order) else np.inf
        least = self.least(near, far)
        found = np.flatnonzero(least <= limit)
        return found, least[found]


def _slack(size):
    return 1e-9 * (1.0 + size)


class Nearest:
    """The k nearest so far of the test vectors that a task holds, ties by id."""

    SCHEMA = "test_id long, bank_id long, distance double"

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        self.ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        self.rows = np.concatenate([matrix(p.column("values")) for p in parts])
        self.squares = (self.rows * self.rows).sum(axis=1)
        self.k = k
        self.best = np.full((len(self.rows), k), np.inf)
        self.who = np.zeros((len(self.rows), k), np.int64)

    def meet(self, part: pa.RecordBatch) -> None:
        self.compare(np.arange(len(self.rows)), part.column("id").to_numpy(), matrix(part.column("values")))

    def compare(self, todo: np.ndarray, ids: np.ndarray, bank: np.ndarray) -> None:
        """Some of the test rows with some bank rows, tile by tile."""
        width = max(TILE_BANK, 4 * self.k)
        height = max(1, TILE_PAIRS // min(width, len(ids)))
        for at in range(0, len(ids), width):
            some, own = bank[at : at + width], ids[at : at + width]
            squares = (some * some).sum(axis=1)
            for first in range(0, len(todo), height):
                self._tile(todo[first : first + height], own, some, squares)

    def _tile(self, todo: np.ndarray, ids: np.ndarray, bank: np.ndarray, squares: np.ndarray) -> None:
        """The product form of the distance picks candidates with a margin for its
        rounding; the distances themselves come from differences."""
        mine = self.squares[todo]
        margin = 1e-9 * (mine + squares.max() + 1.0)
        rough = squares[None, :] - 2.0 * (self.rows[todo] @ bank.T)
        limit = self.best[todo, -1] ** 2 - mine + margin
        if self.k == 1:
            limit = np.minimum(limit, rough.min(axis=1) + margin)
        else:
            many = np.flatnonzero((rough <= limit[:, None]).sum(axis=1) > 2 * self.k)
            if len(many):
                kth = np.partition(rough[many], self.k - 1, axis=1)[:, self.k - 1]
                limit[many] = np.minimum(limit[many], kth + margin[many])
        i, j = np.nonzero(rough <= limit[:, None])
        for at in range(0, len(i), TILE_PAIRS):
            self._take(todo[i[at : at + TILE_PAIRS]], ids, bank, j[at : at + TILE_PAIRS])

    def _take(self, at: np.ndarray, ids: np.ndarray, bank: np.ndarray, j: np.ndarray) -> None:
        """Merge pairs, in order of their test row, into the k best."""
        step = max(1, 8 * TILE_PAIRS // bank.shape[1])
        far = np.concatenate([
            np.sqrt(((bank[j[a : a + step]] - self.rows[at[a : a + step]]) ** 2).sum(axis=1))
            for a in range(0, len(at), step)
        ])
        rows = at[np.flatnonzero(np.diff(at, prepend=-1))]
        every = np.concatenate([np.repeat(rows, self.k), at])
        far = np.concatenate([self.best[rows].ravel(), far])
        who = np.concatenate([self.who[rows].ravel(), ids[j]])
        order = np.lexsort((who, far, every))
        starts = np.flatnonzero(np.diff(every[order], prepend=-1))
        first = order[starts[:, None] + np.arange(self.k)]
        target = every[order[starts]][:, None], np.arange(self.k)[None, :]
        self.best[target], self.who[target] = far[first], who[first]

    def found(self) -> Iterator[pa.RecordBatch]:
        for row, rank in self.filled():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (self.ids[row], self.who[row, rank], self.best[row, rank])],
                ["test_id", "bank_id", "distance"],
            )

    def filled(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place among its k best) of what was found, some at a time."""
        step = max(1, ROWS_OUT // self.k)
        for first in range(0, len(self.ids), step):
            row, rank = np.nonzero(np.isfinite(self.best[first : first + step]))
            if len(row):
                yield row + first, rank


FOUND = "test_block long, test_id long, rank int, bank_id long, distance double, visited int, offered int"


class Search(Nearest):
    """``Nearest`` that leaves out what the pivots rule out.

    A bank block comes in pieces of ``floats`` at most; of each the distances to the
    pivots tell which test rows may have something near in it.
    """

    def __init__(self, parts: list[pa.RecordBatch], k: int, pivots: np.ndarray, floats: int):
        super().__init__(parts, k)
        self.block = parts[0].column("block")[0].as_py()
        self.pivots, self.step = pivots, max(1, floats // self.rows.shape[1])
        self.dist = to_pivots(self.rows, pivots)
        self.visited, self.offered = set(), set()

    def meet(self, part: pa.RecordBatch) -> None:
        block = part.column("block")[0].as_py()
        self.offered.add(block)
        ids, bank = part.column("id").to_numpy(), matrix(part.column("values"))
        dist = to_pivots(bank, self.pivots)
        for at in range(0, len(ids), self.step):
            piece = slice(at, at + self.step)
            near, far = dist[piece].min(axis=0), dist[piece].max(axis=0)
            gap = np.maximum(near - self.dist, self.dist - far).max(axis=1) - _slack(far.max())
            todo = np.flatnonzero(gap <= self.best[:, -1])
            if len(todo):
                self.visited.add(block)
                self.compare(todo, ids[piece], bank[piece])

    def found(self) -> Iterator[pa.RecordBatch]:
        for row, rank in self.filled():
            counts = (np.full(len(row), len(x), np.int32) for x in (self.visited, self.offered))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(row), self.block)), pa.array(self.ids[row]),
                    pa.array((rank + 1).astype(np.int32)), pa.array(self.who[row, rank]),
                    pa.array(self.best[row, rank]), *(pa.array(x) for x in counts),
                ],
                ["test_block", "test_id", "rank", "bank_id", "distance", "visited", "offered"],
            )


def _routes(spark: SparkSession, test: pa.Table, ranges: Ranges, k: int, parts: int) -> DataFrame:
    """(bank_block, _to): the places that need a bank block, and its bound for each. Test
    blocks are as many as tasks, bank blocks at most some ``BANK_BLOCKS``."""
    names = np.array(list(ranges.at), np.int64)
    near, far = (matrix(test.column(c).combine_chunks()) for c in ("near", "far"))
    found = [ranges.needed(near[i], far[i], k) for i in range(test.num_rows)]
    rows = pa.table({
        "test_block": np.repeat(np.arange(test.num_rows), [len(at) for at, _ in found]),
        "bank_block": names[np.concatenate([at for at, _ in found])],
        "least": np.concatenate([least for _, least in found]),
    })
    part = F.pmod(F.xxhash64("bank_block"), F.lit(parts))
    return spark.createDataFrame(rows).groupBy("bank_block").agg(
        F.collect_list(F.struct((F.col("test_block") * parts + part).alias("place"), "least")).alias("_to")
    )


def searched(
    test: DataFrame, bank: DataFrame, k: int, block_floats: int, n_pivots: int = PIVOTS
) -> tuple[DataFrame, int]:
    """FOUND rows: the k nearest in each part of the bank that a test block's tasks
    have read, and how many blocks were offered and looked into there; and the number of
    parts, which is 1 where there are test blocks enough to keep all tasks busy.

    ``test`` and ``bank`` are (id, values, _floats). A bank block is sent to all test blocks
    that may need it, so both are few: a test block is what a task holds, a bank
    block at least ``block_floats``, the size of the pieces looked into.
    """
    spark = test.sparkSession
    pivots = far_apart(matrix(sampled(bank, "bank_values").column(0).combine_chunks()), n_pivots)
    whole = bank.agg(F.sum("_floats")).first()[0] or 0
    rings = _rings(_placed(bank, "bank", pivots, 0), max(block_floats, 2 * whole // BANK_BLOCKS))
    ranges = Ranges(_ranges(rings, len(pivots)).toArrow())
    # a test row's distances to the pivots and its k best take room too
    extra = len(pivots) + 2 * k
    size = test.agg(F.count("*"), F.coalesce(F.sum(F.col("_floats") + extra), F.lit(0))).first()
    wanted, parts = streams.cut(spark, size[0])
    test_rings = _rings(_placed(test, "test", pivots, extra), max(1, min(TEST_FLOATS, 2 * size[1] // wanted)))
    test_ranges = _ranges(test_rings, len(pivots)).toArrow()
    if not test_ranges.num_rows:
        return spark.createDataFrame([], FOUND), 1
    numbers = spark.createDataFrame(pa.table({"block": test_ranges.column("block"), "_n": np.arange(test_ranges.num_rows)}))
    left = test_rings.join(F.broadcast(numbers), "block").select(
        F.explode(F.transform(streams.upto(parts), lambda p: p + F.col("_n") * parts)).alias("place"),
        F.lit(streams.TEST).alias("side"), F.lit(-1.0).alias("least"), "block", "own", "id", "values",
    )
    routes = _routes(spark, test_ranges, ranges, k, parts)
    right = rings.join(F.broadcast(routes.withColumnRenamed("bank_block", "block")), "block").select(
        F.inline("_to"), F.lit(streams.BANK).alias("side"), "block", "own", "id", "values"
    ).select("place", "side", "least", "block", "own", "id", "values")
    stream = streams.streamed(left.unionByName(right), test_ranges.num_rows * parts, "least", "block", "own")
    make = streams.walked(lambda held: Search(held, k, pivots, block_floats), ("block",))
    return stream.drop("least", "own").mapInArrow(make, FOUND), parts


def merged(found: DataFrame, parts: int, k: int) -> DataFrame:
    """(test_id, rank, bank_id, distance) from the k best of each part. With one part
    they are final where they were found, and nothing is shuffled."""
    if parts == 1:
        return found.select("test_id", "rank", "bank_id", "distance")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(test_id, rank, bank_id, distance): the k nearest of each test row, ties by bank id."""
    order = Window.partitionBy("test_id").orderBy("distance", "bank_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("test_id", "rank", "bank_id", "distance")
    )
