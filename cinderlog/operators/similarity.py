"""Distance of test templates to a bank of normal ones.

Test rows are cut into blocks of bounded size (``blocks``). A task holds one of them while
the bank streams past (``streams``), and a dense kernel keeps, per test template, a
partial result: its k nearest (``pruned``), or the (max, sum, count) of its
similarities (``late``). Partials merge by an ordinary aggregate. No pair of templates is
ever a row. The k nearest of a bank of several blocks are found without a look at every
pair (``pruned``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.operators import blocks, late, pruned, streams

BLOCK_FLOATS = 8_000_000  # of a block: 32 MB of float32
ROW = ["side", "id", "values", "tokens"]


def _width(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, v: acc + F.size(v))


def _flat(df: DataFrame, id_: str, tokens: Column, prefix: str) -> DataFrame:
    """Token matrices as one flat array, its token lengths apart: the cheapest
    form to hand to Arrow."""
    return df.select(
        F.col(id_).cast("long").alias(f"{prefix}_id"),
        F.flatten(tokens).alias(f"{prefix}_values"),
        F.size(tokens).alias(f"{prefix}_tokens"),
        _width(tokens).alias("_floats"),
    )


def _sides(
    test: DataFrame, bank: DataFrame, block_floats: int, *columns: str
) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Both sides as (id, values, tokens), the test side with its place, and how many
    blocks, parts and places there are."""
    n, parts = streams.cut(test.sparkSession, test.count())
    test, n = blocks.dealt(test, "test_id", block_floats, n)
    parts = min(parts, max(1, streams.slots(test.sparkSession) // n))
    left = test.select(
        F.col("block").alias("_block"), F.lit(streams.TEST).alias("side"), F.col("test_id").alias("id"),
        F.col("test_values").alias("values"), F.col("test_tokens").alias("tokens"),
    )
    right = bank.select(
        F.pmod(F.xxhash64("bank_id"), F.lit(parts)).alias("_part"), F.lit(streams.BANK).alias("side"),
        F.col("bank_id").alias("id"), F.col("bank_values").alias("values"), F.col("bank_tokens").alias("tokens"),
    )
    return left, right, n, parts, n * parts


def _met(test: DataFrame, bank: DataFrame, block_floats: int) -> DataFrame:
    """Every test block beside the whole bank, as a stream (``streams``)."""
    left, right, n, parts, places = _sides(test, bank, block_floats)
    left = left.withColumn("_part", F.explode(streams.upto(parts)))
    right = right.withColumn("_block", F.explode(streams.upto(n)))
    place = (F.col("_block") * parts + F.col("_part")).alias("place")
    both = left.select(place, *ROW).unionByName(right.select(place, *ROW))
    return streams.streamed(both, places)


def _met_wanted(test: DataFrame, bank: DataFrame, block_floats: int, wanted: DataFrame) -> DataFrame:
    """As ``_met``, but a bank row goes only to the blocks that hold test rows which want it
    (test_id, bank_id), with their ids."""
    left, right, n, parts, places = _sides(test, bank, block_floats)
    left = left.withColumn("wanting", F.lit(None).cast("array<bigint>"))
    in_block = left.select(F.col("id").alias("test_id"), "_block").distinct()
    lists = wanted.join(in_block, "test_id").groupBy("_block", "bank_id").agg(F.collect_list("test_id").alias("wanting"))
    right = right.join(lists.withColumnRenamed("bank_id", "id"), "id")
    left = left.withColumn("_part", F.explode(streams.upto(parts)))
    place = (F.col("_block") * parts + F.col("_part")).alias("place")
    both = left.select(place, *ROW, "wanting").unionByName(right.select(place, *ROW, "wanting"))
    return streams.streamed(both, places)


# --- nearest neighbours ------------------------------------------------------


def core_set_size(bank_size: int, core_set: float) -> int:
    """0: no core set. A share: at least one. Above the bank: the bank."""
    if 0 < core_set < 1:
        return max(1, int(bank_size * core_set))
    return int(core_set) if core_set <= bank_size else bank_size


def nearest(
    test: DataFrame,
    bank: DataFrame,
    k: int = 1,
    test_id: str = "template_id",
    bank_id: str = "template_id",
    vector: str = "first",
    block_floats: int = BLOCK_FLOATS,
) -> DataFrame:
    """(test_id, rank, bank_id, distance): the k nearest bank vectors, Euclidean,
    nearest first, ties by bank id. Exact. A bank of more than one block is searched
    by pivots, and blocks that cannot matter are left out."""
    one = F.array(F.col(vector))
    test, bank = _flat(test, test_id, one, "test"), _flat(bank, bank_id, one, "bank")
    if blocks.sizes(bank, block_floats).floats > block_floats:
        return pruned.merged(*pruned.searched(test, bank, k, block_floats), k)
    # a test row's k best take room too
    held = test.withColumn("_floats", F.col("_floats") + 2 * k)
    partial = _met(held, bank, block_floats).mapInArrow(
        streams.walked(lambda parts: pruned.Nearest(parts, k)), pruned.Nearest.SCHEMA
    )
    if k == 1:
        return partial.groupBy("test_id").agg(
            F.min(F.struct("distance", "bank_id")).alias("_m")
        ).select(
            "test_id", F.lit(1).alias("rank"), F.col("_m.bank_id").alias("bank_id"),
            F.col("_m.distance").alias("distance"),
        )
    return pruned.ranked(partial, k)


def visits(
    test: DataFrame,
    bank: DataFrame,
    k: int = 1,
    test_id: str = "template_id",
    bank_id: str = "template_id",
    vector: str = "first",
    block_floats: int = BLOCK_FLOATS,
) -> DataFrame:
    """One row (test_blocks, bank_blocks, offered, visited): how many pairs of blocks a
    pivot search has sent to tasks and looked into, of all pairs on the grid."""
    one = F.array(F.col(vector))
    bank = _flat(bank, bank_id, one, "bank")
    found, _ = pruned.searched(_flat(test, test_id, one, "test"), bank, k, block_floats)
    each = found.groupBy("test_block").agg(F.max("visited").alias("visited"), F.max("offered").alias("offered"))
    return each.agg(
        F.count("*").alias("test_blocks"), F.sum("offered").alias("offered"), F.sum("visited").alias("visited")
    )


# --- late interaction --------------------------------------------------------


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero, so its cosine is 0."""
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


UNITS = {"cos": _unit, "dot": np.asarray}


def maxsim(
    test: DataFrame,
    bank: DataFrame,
    metric: str = "cos",
    neighbours: DataFrame | None = None,
    first_only: bool = False,
    test_id: str = "template_id",
    bank_id: str = "template_id",
    tokens: str = "tokens",
    block_floats: int = BLOCK_FLOATS,
    mean: bool = True,
) -> DataFrame:
    """(test_id, maxsim_max, maxsim_mean): per pair, the sum over test tokens of
    the best similarity to any bank token; then the largest and the mean over
    the bank, or over the test row's ``neighbours`` (test_id, bank_id).

    A zero vector has similarity 0. ``first_only`` keeps slot 0 of both sides. Without
    ``mean`` the largest alone is found, which takes less than half the time.
    """
    matrix = F.slice(tokens, 1, 1) if first_only else F.col(tokens)
    left, right = _flat(test, test_id, matrix, "test"), _flat(bank, bank_id, matrix, "bank")
    unit = UNITS[metric]
    if neighbours is not None:
        wanted = neighbours.select(F.col("test_id").cast("long"), F.col("bank_id").cast("long"))
        met, kernel = _met_wanted(left, right, block_floats, wanted), late.Chosen
    else:
        met, kernel = _met(left, right, block_floats), late.All if mean else late.Best
    partial = met.mapInArrow(streams.walked(lambda parts: kernel(parts, unit)), kernel.SCHEMA)
    largest = F.max("best").alias("maxsim_max")
    if not mean:
        return partial.groupBy("test_id").agg(largest)
    return partial.groupBy("test_id").agg(largest, (F.sum("total") / F.sum("n")).alias("maxsim_mean"))


def maxsim_best(
    test: DataFrame,
    bank: DataFrame,
    metric: str = "cos",
    first_only: bool = False,
    test_id: str = "template_id",
    bank_id: str = "template_id",
    tokens: str = "tokens",
    block_floats: int = BLOCK_FLOATS,
) -> DataFrame:
    """(test_id, maxsim_max, pairs, computed): ``maxsim_max`` alone, computed only for
    pairs whose upper bound, from single precision, may beat the best so far; how many
    pairs a test row had, and of how many the similarity was computed."""
    matrix = F.slice(tokens, 1, 1) if first_only else F.col(tokens)
    met = _met(_flat(test, test_id, matrix, "test"), _flat(bank, bank_id, matrix, "bank"), block_floats)
    unit = UNITS[metric]
    found = met.mapInArrow(streams.walked(lambda parts: late.Best(parts, unit)), late.Best.SCHEMA)
    return found.groupBy("test_id").agg(
        F.max("best").alias("maxsim_max"), F.sum("pairs").alias("pairs"), F.sum("computed").alias("computed")
    )
