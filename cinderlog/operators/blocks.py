"""Rows with vectors dealt into blocks of bounded size.

A block's vectors must fit a task. What a block holds is measured in floats. Rows go
to blocks by a hash of their id where the blocks, measured, keep the bound. Else they are
put one after the other by running totals, which no single task computes, and cut
where half of the bound is full. A row of more than half the bound is a block of
its own, so the others never overrun: a block has at most half a bound before its
last row, and the last row is at most half a bound.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.operators import ordered

FLOATS = "_floats"


class Sizes(NamedTuple):
    rows: int
    floats: int
    small: int  # floats of rows that share blocks
    large: int  # rows that have one of their own

    @property
    def blocks(self) -> int:
        return self.large + -(-self.small // self.half) if self.rows else 1

    half: int = 1


def _is_large(half: int) -> Column:
    return F.col(FLOATS) > half


def sizes(side: DataFrame, bound: int) -> Sizes:
    half = max(1, bound // 2)
    row = side.agg(
        F.count("*"), F.coalesce(F.sum(FLOATS), F.lit(0)),
        F.coalesce(F.sum(F.when(~_is_large(half), F.greatest(FLOATS, F.lit(1)))), F.lit(0)),
        F.count(F.when(_is_large(half), 1)),
    ).first()
    return Sizes(*row, half)


def packed(side: DataFrame, order: Column, bound: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``block``, a number from 0 within each value of ``by``, along ``order``,
    which must be unique and non-null."""
    half = max(1, bound // 2)
    marked = side.withColumns(
        {
            "_order": order,
            "_small": F.when(_is_large(half), 0).otherwise(F.greatest(FLOATS, F.lit(1))).cast("long"),
            "_large": _is_large(half).cast("long"),
        }
    )
    run = ordered.running_totals(marked, "_order", {"_small": "_upto", "_large": "_alone"}, by=by)
    shared = F.ceil(F.col("all__upto") / half)
    block = F.when(F.col("_large") == 1, shared + F.col("_alone") - 1).otherwise(
        F.floor((F.col("_upto") - 1) / half)
    )
    return run.select(*side.columns, block.cast("long").alias("block"))


def dealt(side: DataFrame, id_: str, bound: int, least: int = 1) -> tuple[DataFrame, int]:
    """Add ``block`` and tell how many there are. ``least`` asks for more blocks than
    size does, for the sake of more tasks."""
    size = sizes(side, bound)
    if size.floats <= bound:  # any share of the rows fits
        return side.withColumn("block", F.pmod(F.xxhash64(id_), F.lit(max(1, least)))), max(1, least)
    # rows of like size spread evenly by their hash: no need to put them in order
    n = max(least, -(-3 * size.floats // (2 * bound)))
    hashed = side.withColumn("block", F.pmod(F.xxhash64(id_), F.lit(n)))
    largest = hashed.groupBy("block").agg(F.sum(FLOATS).alias("n")).agg(F.max("n")).first()[0]
    if largest <= bound:
        return hashed, n
    if size.blocks < least:
        bound = max(1, 2 * size.floats // least)
        size = sizes(side, bound)
    return packed(side, F.struct(id_), bound), size.blocks
