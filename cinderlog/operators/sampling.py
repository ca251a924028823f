"""Exact, seeded samples and splits.

Rows are ordered by md5(seed|id), then id, and the first n of a class are
taken. A window per class would put a class into one task. Instead the slim table
(stratum, key, id) is written once, and histograms over the next hex digits of the
key narrow down the bucket where the cut lies, level by level until it is small.
Only that bucket is ranked, and the (key, id) found there is the cut for all rows: a
comparison, without a shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.session import materialise

DIGITS = 4  # of the key that a level looks at
BUCKET_ROWS = 100_000  # most rows of a stratum that are ranked in one task
MOST_STRATA = 1000


def seeded_key(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string")).cast("binary"))


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: total, abnormal, normal, ratio. Rows without label count in total only."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 1).alias("abnormal"),
        F.count_if(F.col(label) == 0).alias("normal"),
        F.avg(F.col(label).cast("double")).alias("abnormal_ratio"),
    )


def flag_first(
    rows: DataFrame,
    id_: str,
    key: Column,
    stratum: Column,
    want: Callable[[Column, Column], Column],
    flag: str = "picked",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add a boolean: is the row among the first ``want`` of its stratum?

    ``want(n, total)`` gives the number from the stratum's size and the size of
    all strata together; it is capped at the stratum's size. At most MOST_STRATA
    strata. Rows with a null stratum are never picked.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns({"_key": key, "_stratum": stratum})
    slim = keyed.select("_stratum", "_key", F.col(id_).alias("_id")).where(
        F.col("_stratum").isNotNull()
    )
    slim = materialise(slim, "sample-keys")
    sizes = slim.groupBy("_stratum").agg(F.count("*").alias("_size"))
    wanted = sizes.withColumn("_total", sizes.agg(F.sum("_size")).scalar()).select(
        "_stratum",
        F.lit("").alias("_prefix"),
        F.least(want(F.col("_size"), F.col("_total")).cast("long"), F.col("_size")).alias("_rest"),
        F.col("_size").alias("_n"),
    )
    kinds = f"_stratum {slim.schema['_stratum'].dataType.simpleString()}, _prefix string, _rest long, _n long"
    buckets = wanted.limit(MOST_STRATA + 1).collect()
    if len(buckets) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    buckets = [b for b in buckets if b["_rest"] > 0]
    longest = slim.agg(F.max(F.length("_key"))).first()[0] or 0
    while any(b["_n"] > bucket_rows and len(b["_prefix"]) < longest for b in buckets):
        buckets = _narrowed(slim, spark.createDataFrame(buckets, kinds)).collect()
    state = spark.createDataFrame(buckets, kinds)
    rank = Window.partitionBy("_stratum").orderBy("_key", "_id")
    cut = (
        _inside(slim, state)
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") == F.col("_rest"))
        .select(
            F.col("_stratum").alias("_of"), F.struct("_key", F.col("_id")).alias("_cut")
        )
    )
    # one row per stratum, found once however often the flagged rows are read
    cut = materialise(cut, "cut")
    return (
        keyed.join(F.broadcast(cut), F.col("_stratum") == F.col("_of"), "left")
        .withColumn(
            flag,
            F.coalesce(F.struct("_key", F.col(id_).alias("_id")) <= F.col("_cut"), F.lit(False)),
        )
        .drop("_key", "_stratum", "_of", "_cut")
    )


def _inside(slim: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of each stratum's bucket; ``state`` has a row per stratum."""
    return slim.join(F.broadcast(state), "_stratum").where(
        F.startswith(F.col("_key"), F.col("_prefix"))
    )


def _narrowed(slim: DataFrame, state: DataFrame) -> DataFrame:
    """The bucket, DIGITS longer, that holds the cut, and the rank wanted in it."""
    head = F.substr("_key", F.lit(1), F.length("_prefix") + DIGITS)
    histogram = (
        _inside(slim, state)
        .groupBy("_stratum", "_rest", head.alias("_head"))
        .agg(F.count("*").alias("_n"))
    )
    upto = Window.partitionBy("_stratum").orderBy("_head")  # 16 ** DIGITS rows at most
    return (
        histogram.withColumn("_upto", F.sum("_n").over(upto))
        .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest")))
        .select(
            "_stratum", F.col("_head").alias("_prefix"),
            (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"), "_n",
        )
    )


def normal_only_split(
    rows: DataFrame, test_size: float, id_: str, seed: int = 1234, label: str = "label"
) -> DataFrame:
    """Add ``split``: "test" for ceil(n * size) normal rows and all abnormal
    ones, "train" for the other normal rows. Rows without a label go."""
    flagged = flag_first(
        rows, id_, seeded_key(F.col(id_), seed),
        F.when(F.col(label) == 0, 0),
        lambda n, _: F.ceil(n * F.lit(float(test_size))),
        flag="_test",
    )
    return (
        flagged.where(F.col(label).isin(0, 1))
        .withColumn(
            "split", F.when((F.col(label) == 1) | F.col("_test"), "test").otherwise("train")
        )
        .drop("_test")
    )


def split_size_columns(label: str = "label") -> list[Column]:
    return [
        F.count_if(F.col("split") == "train").alias("train_normal"),
        F.count_if((F.col("split") == "test") & (F.col(label) == 0)).alias("test_normal"),
        F.count_if((F.col("split") == "test") & (F.col(label) == 1)).alias("test_abnormal"),
    ]


def split_sizes(split: DataFrame, label: str = "label") -> DataFrame:
    return split.agg(*split_size_columns(label))


def presample(
    rows: DataFrame, sample: float | int, id_: str, seed: int = 1234, label: str = "label"
) -> DataFrame:
    """Keep the class shares: a float is a share of each class, an int the
    number of rows over both, 1 means all."""
    if sample == 1:
        return rows
    if isinstance(sample, int):
        abnormal = rows.agg(
            F.count_if(F.col(label) == 1) / F.count_if(F.col(label).isin(0, 1))
        ).scalar()

        def want(n: Column, total: Column) -> Column:
            share = F.when(F.col("_stratum") == 1, abnormal).otherwise(F.lit(1.0) - abnormal)
            return F.floor(F.lit(sample) * share)
    else:
        def want(n: Column, total: Column) -> Column:
            return F.floor(n * F.lit(sample))
    return _keep(
        flag_first(rows, id_, seeded_key(F.col(id_), seed), F.col(label), want)
    )


def _keep(flagged: DataFrame) -> DataFrame:
    return flagged.where("picked").drop("picked")


def stratified_sample(
    rows: DataFrame, n: int | None, id_: str, seed: int = 42, label: str = "label"
) -> DataFrame:
    """max(1, int(n * abnormal share)) abnormal rows, the rest of n normal,
    each capped by its class. All rows unless 0 < n < rows."""
    if not n or n < 0:
        return rows

    def want(size: Column, total: Column) -> Column:
        abnormal = F.when(F.col("_stratum") == 1, size).otherwise(total - size)
        take = F.greatest(F.lit(1), F.floor(F.lit(n) * (abnormal / total)))
        picked = F.when(F.col("_stratum") == 1, take).otherwise(F.lit(n) - take)
        return F.when(total <= n, size).otherwise(F.greatest(picked, F.lit(0)))

    return _keep(flag_first(rows, id_, seeded_key(F.col(id_), seed), F.col(label), want))


def stratified_sample_exact(
    rows: DataFrame, n: int | None, id_: str, seed: int = 42, label: str = "label"
) -> DataFrame:
    """Per label max(1, half-even round of n * share), capped; then trimmed to
    n, or topped up to n from the rows left. All rows unless 0 < n < rows."""
    if not n or n < 0:
        return rows
    key = seeded_key(F.col(id_), seed)
    first = flag_first(
        rows, id_, key, F.col(label),
        lambda size, total: F.greatest(F.lit(1), F.bround(F.lit(n) * (size / total))),
        flag="_first",
    )
    # rows picked per label come first, so n of this order trims and tops up alike
    order = F.concat(F.when(F.col("_first"), "0").otherwise("1"), key)
    return _keep(
        flag_first(first, id_, order, F.lit(0), lambda size, total: F.lit(n))
    ).drop("_first")


def train_ratio_templates(
    rows: DataFrame, ratio: float, id_: str, key: str = "template_id", seed: int = 1234
) -> DataFrame:
    """Distinct templates of int(rows * ratio) rows drawn without replacement."""
    drawn = _keep(
        flag_first(
            rows.select(id_, key), id_, seeded_key(F.col(id_), seed), F.lit(0),
            lambda n, _: F.floor(n * F.lit(float(ratio))),
        )
    )
    return drawn.select(key).distinct()


def shuffle(rows: DataFrame, id_: str, seed: int = 42) -> DataFrame:
    """Seeded full shuffle: a range sort on the key, over all tasks."""
    return rows.orderBy(seeded_key(F.col(id_), seed), F.col(id_))


def preview(rows: DataFrame, id_: str, seed: int = 42, n: int = 10) -> DataFrame:
    return shuffle(rows, id_, seed).limit(n)
