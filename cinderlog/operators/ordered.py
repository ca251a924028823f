"""Running totals and ranks over a global order, without a one-task window.

A window without a partition key would bring every row to one task. Here the
rows are dealt into ranges of the key, as many as ``spark.sql.shuffle.partitions``
says (fewer where they are small), and written with the number of their range.
Each range is totalled on its own, and the totals of the ranges before it are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.session import materialise


def running_totals(
    df: DataFrame, key: str, totals: dict[str, str], descending: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Inclusive running sums along ``key``, which must be unique and non-null.

    ``totals`` maps a numeric column to the name of its running sum; the sum over
    all rows comes along as ``all_<name>``. With ``by``, sums run for each of its
    (few) values on its own, in the same pass.
    """
    # the numbers are written with the rows, so they hold for every later read
    parts = materialise(
        df.repartitionByRange(*by, key).withColumn("_part", F.spark_partition_id()), "ordered"
    )
    # one row per range, and value of ``by`` in it
    per_part = parts.groupBy(*by, "_part").agg(
        *(F.sum(c).alias(f"_sum_{name}") for c, name in totals.items())
    )
    order = F.col("_part").desc() if descending else F.col("_part").asc()
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = per_part.select(
        *by,
        "_part",
        *(
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in totals.values()
        ),
        *(F.sum(f"_sum_{name}").over(whole).alias(f"all_{name}") for name in totals.values()),
    )
    inner = Window.partitionBy(*by, "_part").orderBy(
        F.col(key).desc() if descending else F.col(key).asc()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.select(
        "*", *(F.sum(c).over(inner).alias(f"_in_{name}") for c, name in totals.items())
    )
    # a row per range: as many as shuffle partitions, times the values of ``by``
    return local.join(F.broadcast(offsets), [*by, "_part"]).select(
        *(F.col(c) for c in df.columns),
        *(
            (F.col(f"_in_{name}") + F.col(f"_before_{name}")).alias(name)
            for name in totals.values()
        ),
        *(f"all_{name}" for name in totals.values()),
    )


SKETCH_K = 800  # a quantile sketch of this size is off by far less than RANK_ERROR
RANK_ERROR = 0.02


def _brackets(
    df: DataFrame, value: str, shares: dict[str, float]
) -> tuple[int, dict[str, tuple[float | None, float | None]]]:
    """The number of values, and for each share two of them that should lie around it."""
    x = F.col(value).cast("double")
    sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
    ends = {
        name: (share - RANK_ERROR, share + RANK_ERROR) for name, share in shares.items()
    }
    asked = {
        f"{name}_{k}": F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))
        for name, two in ends.items() for k, q in enumerate(two) if 0 < q < 1
    }
    some = F.count(value) > 0  # an empty sketch has no quantile
    row = df.agg(F.count(value).alias("n"), *(F.when(some, c).alias(name) for name, c in asked.items())).first()
    known = row.asDict()
    return row["n"], {name: (known.get(f"{name}_0"), known.get(f"{name}_1")) for name in shares}


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated percentiles.

    A quantile sketch brackets each one; a second pass counts the values below and
    inside, and only those inside, equal ones counted first, are put in order. A bracket that
    misses its percentile, which the counts tell, is opened to all values.
    """
    rows = df.where(F.col(value).isNotNull())
    x = F.col(value).cast("double")
    n, brackets = _brackets(rows, value, shares)
    at = {name: share * (n - 1) for name, share in shares.items()}

    def below(name: str) -> Column:
        low = brackets[name][0]
        return F.lit(False) if low is None else x < low

    def inside(name: str) -> Column:
        high = brackets[name][1]
        return ~below(name) & (F.lit(True) if high is None else x <= high)

    def tallied() -> dict[str, int]:
        return rows.agg(
            *(F.count_if(below(name)).alias(f"{name}_below") for name in shares),
            *(F.count_if(inside(name)).alias(f"{name}_inside") for name in shares),
        ).first().asDict()

    found = tallied() if n else dict.fromkeys([f"{name}_below" for name in shares], 0)
    lost = [
        name for name in shares if n
        and not found[f"{name}_below"] <= math.floor(at[name]) <= math.ceil(at[name])
        < found[f"{name}_below"] + found[f"{name}_inside"]
    ]
    if lost:
        brackets |= dict.fromkeys(lost, (None, None))
        found = tallied()
    own = F.array(*(F.when(inside(name), F.lit(name)) for name in shares))
    counts = (
        rows.select(value, F.explode(F.array_compact(own)).alias("_share"))
        .groupBy("_share", value).agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(counts, value, {"_n": "_upto"}, by=("_share",))
    exprs = []
    for name, position in at.items():
        mine, upto = F.col("_share") == name, F.col("_upto") + found[f"{name}_below"]
        low, high = (
            F.min(F.when(mine & (upto > rank), F.col(value)))
            for rank in (math.floor(position), math.ceil(position))
        )
        exprs.append((low + (high - low) * (position - math.floor(position))).alias(name))
    return ranked.agg(*exprs)
