"""Equi-joins that stay balanced when one key holds a large share of the rows.

Keys are compared by two 64-bit hashes, so a join moves the hashes and the columns that
are asked for; a text that is only a key is neither written nor shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.session import materialise

# A key is hot above this share of the rows; so fewer than HOT_PARTS keys are.
HOT_PARTS = 256
SALTS = 64
BROADCAST_BYTES = 32 << 20  # values of hot keys above this are not broadcast
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)

HASHES = ["_h1", "_h2"]
BITS_A_KEY = 32
BITMAP = 1 << 15  # bits of one bitmap
MOST_BITS = 1 << 27  # 16 MB to each executor


def hashes(key: str) -> dict[str, Column]:
    """Two hashes of a key; null where the key is."""
    there = F.col(key).isNotNull()
    return {
        "_h1": F.when(there, F.xxhash64(key)),
        "_h2": F.when(there, F.xxhash64(F.lit("second"), key)),
    }


def _any(column: str, values: list[int]) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def _fits(hot_values: DataFrame, payload: list[str]) -> bool:
    """Whether the values of the hot keys, fewer than HOT_PARTS rows, may be broadcast."""
    kinds = [hot_values.schema[c].dataType for c in payload]
    if all(isinstance(k, FIXED_WIDTH) for k in kinds):
        return True
    size = hot_values.agg(F.sum(F.length(F.to_json(F.struct(*payload))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    counts: DataFrame | None = None,
    hot_parts: int = HOT_PARTS,
    keep: list[str] | None = None,
    written: bool = False,
) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row per ``key``.

    The rows of hot keys, and rows without a key, are not shuffled: they meet the
    table's rows of these keys, fewer than ``hot_parts`` by definition, in a broadcast
    join; values too large for one are joined under a salt. Only the other rows take
    the shuffle join, where no key has more than a small share. Adds ``_found``.

    ``counts`` may pass a ready ``(key, _n)`` frame; else the rows are counted. ``keep``
    names the rows' columns that the result shall have. Rows are read by both branches,
    so they are written once, their kept columns and hashes, unless the caller says
    that they are ``written``.
    """
    payload = [c for c in table.columns if c != key]
    clash = set(payload) & set(rows.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keep = keep or rows.columns
    rows = rows.withColumns(hashes(key)).select(*keep, *HASHES)
    if not written:
        rows = materialise(rows, "lookup-rows")
    if counts is None:
        counts = rows.groupBy("_h1").agg(F.count("*").alias("_n"))
    else:
        counts = counts.select(hashes(key)["_h1"].alias("_h1"), "_n")
    total = counts.agg(F.sum("_n")).scalar()
    hot = [
        r["_h1"] for r in
        counts.where((F.col("_n") * hot_parts > total) & F.col("_h1").isNotNull()).select("_h1").collect()
    ]
    values = table.where(F.col(key).isNotNull()).withColumns(hashes(key))
    value = F.struct(F.lit(1).alias("_hit"), *payload).alias("_value")
    # rows without a key match nothing, and there may be many of them
    stays = _any("_h1", hot) | F.col("_h1").isNull()
    hot_values = values.where(_any("_h1", hot))
    if not hot or _fits(hot_values, payload):
        near = rows.where(stays).join(F.broadcast(hot_values.select(*HASHES, value)), HASHES, "left")
    else:
        salted = rows.where(stays).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        copies = hot_values.select(
            *HASHES, value, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt")
        )
        keyed = F.col("_h1").isNotNull()
        near = (
            salted.where(keyed).join(copies, [*HASHES, "_salt"], "left").drop("_salt")
            .unionByName(salted.where(~keyed).drop("_salt"), allowMissingColumns=True)
        )
    far = rows.where(~stays).join(values.where(~_any("_h1", hot)).select(*HASHES, value), HASHES, "left")
    return near.unionByName(far).select(
        *keep, *(F.col("_value")[c].alias(c) for c in payload), F.col("_value").isNotNull().alias("_found")
    )


def lookup_inner(rows: DataFrame, table: DataFrame, key: str, **kw) -> DataFrame:
    return lookup(rows, table, key, **kw).where("_found").drop("_found")


def _bit(bits: int) -> Column:
    return F.pmod("_h1", F.lit(bits))


def sieve(table: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(_bucket, _bits): which hashes the keys have, as bitmaps, and of how many bits.

    About one key in ``BITS_A_KEY`` that is not in the table looks as if it were, and
    more beyond ``MOST_BITS`` bits, the size that is broadcast at most.
    """
    n = table.select(F.approx_count_distinct(key)).first()[0]
    bits = BITMAP
    while bits < min(n * BITS_A_KEY, MOST_BITS):
        bits *= 2
    at = table.where(F.col(key).isNotNull()).select(hashes(key)["_h1"].alias("_h1")).select(_bit(bits).alias("_at"))
    maps = at.groupBy(F.floor(F.col("_at") / BITMAP).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.col("_at") % BITMAP).alias("_bits")
    )
    return maps, bits


def maybe_in(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Add ``_maybe``: false where the key is certainly not in the table. No row moves."""
    maps, bits = sieve(table, key)
    at = _bit(bits) % BITMAP
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    marked = rows.withColumns(hashes(key)).withColumn("_bucket", F.floor(_bit(bits) / BITMAP))
    joined = marked.join(F.broadcast(maps), "_bucket", "left")
    return joined.select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))


def lookup_missing(
    rows: DataFrame, table: DataFrame, key: str, written: bool = False, **kw
) -> DataFrame:
    """Rows whose key is not in the table. Only rows that bitmaps of the table's hashes
    cannot rule out are joined."""
    rows = rows if written else materialise(rows, "lookup-rows")
    marked = maybe_in(rows, table, key)
    joined = lookup(marked.where("_maybe").drop("_maybe"), table.select(key).distinct(), key, written=True, **kw)
    parts = [marked.where("NOT _maybe").drop("_maybe"), joined.where(~F.col("_found")).drop("_found")]
    return reduce(DataFrame.unionByName, parts)
