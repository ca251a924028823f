"""Threshold search on scores, and decisions by threshold.

Rows are first merged per distinct score (combined on the map side); the
cumulative counts then come from ``ordered.running_totals``, so no step brings
the whole table to one task. ``weight`` names a column that says how many
rows a row stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.operators import ordered
from cinderlog.operators.metrics import count_where

F1_GUARD = 1e-10  # fixed value


By = tuple[str, ...]


def _cumulative(
    rows: DataFrame, score: str, label: str, weight: str | None, by: By = ()
) -> DataFrame:
    """Per distinct score: pos, neg, tp, fp (score >= it), and all_tp, all_fp.
    Rows without a score take no part. ``by`` (a method, say) keeps curves apart."""
    scored = rows.where(F.col(score).isNotNull())
    counts = scored.groupBy(*by, F.col(score).alias("score")).agg(
        count_where(F.col(label) == 1, weight).alias("pos"),
        count_where(F.col(label) == 0, weight).alias("neg"),
    )
    return ordered.running_totals(
        counts, "score", {"pos": "tp", "neg": "fp"}, descending=True, by=by
    )


def pr_curve(
    rows: DataFrame, score: str = "score", label: str = "label", weight: str | None = None,
    by: By = (),
) -> DataFrame:
    """(threshold, tp, fp, precision, recall); recall is 1 when nothing is positive."""
    c = _cumulative(rows, score, label, weight, by)
    return c.select(
        *by,
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("all_tp") > 0, F.col("tp") / F.col("all_tp"))
        .otherwise(1.0)
        .alias("recall"),
    )


def best_f1_threshold(
    rows: DataFrame, score: str = "score", label: str = "label", weight: str | None = None,
    by: By = (),
) -> DataFrame:
    """One row (threshold, f1, precision, recall); ties go to the lowest score."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.lit(2.0) * (p * r) / (p + r + F.lit(F1_GUARD))
    return (
        pr_curve(rows, score, label, weight, by)
        .select(*by, "threshold", "precision", "recall", f1.alias("f1"))
        .groupBy(*by)
        .agg(
            F.max_by(
                F.struct("threshold", "f1", "precision", "recall"),
                F.struct("f1", -F.col("threshold")),
            ).alias("b")
        )
        .select(*by, "b.*")
    )


def roc_curve(
    rows: DataFrame, score: str = "score", label: str = "label", weight: str | None = None,
    by: By = (),
) -> DataFrame:
    """(threshold, fpr, tpr) with the start point (+inf, 0, 0); a rate is null
    when its class has no rows."""
    points = _cumulative(rows, score, label, weight, by).select(
        *by,
        F.col("score").cast("double").alias("threshold"),
        F.try_divide("fp", "all_fp").alias("fpr"),
        F.try_divide("tp", "all_tp").alias("tpr"),
    )
    # a start point per curve
    first = rows.select(*by).distinct() if by else rows.sparkSession.range(1)
    start = first.select(
        *by,
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def youden_threshold(
    rows: DataFrame, score: str = "score", label: str = "label", weight: str | None = None,
    by: By = (),
) -> DataFrame:
    """One row (threshold, sensitivity, specificity, j); ties go to the highest
    score, which may be +inf: nothing is flagged."""
    points = roc_curve(rows, score, label, weight, by).where(
        F.col("tpr").isNotNull() & F.col("fpr").isNotNull()
    )
    return (
        points.withColumn("j", F.col("tpr") - F.col("fpr"))
        .groupBy(*by)
        .agg(
            F.max_by(
                F.struct(
                    "threshold",
                    F.col("tpr").alias("sensitivity"),
                    (1 - F.col("fpr")).alias("specificity"),
                    "j",
                ),
                F.struct("j", "threshold"),
            ).alias("b")
        )
        .select(*by, "b.*")
    )


def score_auc(
    rows: DataFrame, score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """One row (auc): area under the ROC curve, ties counted half; null with one class."""
    c = _cumulative(rows, score, label, weight)
    share = (F.col("neg") / F.col("all_fp")) * (
        (F.col("tp") - F.col("pos") / 2) / F.col("all_tp")
    )
    return c.agg(
        F.sum(F.when((F.col("all_fp") > 0) & (F.col("all_tp") > 0), share)).alias("auc")
    )


SEARCHES = {"prc": best_f1_threshold, "roc": youden_threshold}


def apply_threshold(
    rows: DataFrame, threshold: DataFrame, score: str = "score", out: str = "prediction",
    by: By = (),
) -> DataFrame:
    """Add the decision ``score >= threshold``; the threshold frame has one row, or one
    for each of the few values of ``by``."""
    if by:
        cuts = F.broadcast(threshold.select(*by, F.col("threshold").alias("_cut")))
        return rows.join(cuts, list(by)).withColumn(
            out, (F.col(score) >= F.col("_cut")).cast("int")
        ).drop("_cut")
    cut = threshold.select("threshold").scalar()
    return rows.withColumn("_cut", cut).withColumn(
        out, (F.col(score) >= F.col("_cut")).cast("int")
    ).drop("_cut")


def invert_scores(rows: DataFrame, score: str = "score", by: By = ()) -> DataFrame:
    """Similarity to anomaly score: the largest one (of its ``by`` value) minus each."""
    if by:
        tops = F.broadcast(rows.groupBy(*by).agg(F.max(score).alias("_top")))  # few values
        return rows.join(tops, list(by)).withColumn(score, F.col("_top") - F.col(score)).drop("_top")
    return rows.withColumn("_top", rows.agg(F.max(score)).scalar()).withColumn(
        score, F.col("_top") - F.col(score)
    ).drop("_top")
