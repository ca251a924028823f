"""Classification metrics: one pass of conditional counts, then arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ("tn", "fp", "fn", "tp")


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where that is undefined."""
    return F.when(b != 0, a / b).otherwise(0.0)


def count_where(condition: Column, weight: str | None = None) -> Column:
    """Rows that meet the condition, each counted ``weight`` times."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def _cells(label: Column, pred: Column, weight: str | None = None) -> list[Column]:
    pairs = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return [
        count_where((label == y) & (pred == p), weight).alias(name)
        for name, (y, p) in pairs.items()
    ]


def confusion_matrix(
    df: DataFrame, label: str = "label", pred: str = "prediction",
    by: tuple[str, ...] = (), weight: str | None = None,
) -> DataFrame:
    """tn, fp, fn, tp over labels and predictions 0 and 1."""
    return df.groupBy(*by).agg(*_cells(F.col(label), F.col(pred), weight))


def _scores(c: dict[str, Column]) -> dict[str, Column]:
    tn, fp, fn, tp = (c[x] for x in CELLS)
    return {
        "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": _ratio(fp, fp + tn),
        "false_negative_rate": _ratio(fn, fn + tp),
        # of hard labels; null when only one class occurs
        "hard_auc": F.when(
            (tp + fn > 0) & (fp + tn > 0), (_ratio(tp, tp + fn) + _ratio(tn, fp + tn)) / 2
        ),
    }


def from_counts(counts: DataFrame) -> DataFrame:
    """Add the metrics to a frame that has tn, fp, fn, tp."""
    return counts.withColumns(_scores({x: F.col(x) for x in CELLS}))


def binary_metrics(
    df: DataFrame, label: str = "label", pred: str = "prediction",
    by: tuple[str, ...] = (), weight: str | None = None,
) -> DataFrame:
    return from_counts(confusion_matrix(df, label, pred, by, weight))


def hard_label_auc(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return binary_metrics(df, label, pred).select(F.col("hard_auc").alias("auc"))


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "prediction",
    names: tuple[str, str] = ("normal", "anomaly"),
) -> DataFrame:
    """(row, precision, recall, f1, support) per class, and for accuracy, macro
    and support-weighted averages. Accuracy fills the three score columns."""
    c = confusion_matrix(df, label, pred)
    m = {x: F.col(x) for x in CELLS}
    flipped = {"tn": m["tp"], "fp": m["fn"], "fn": m["fp"], "tp": m["tn"]}
    wide = c.select(
        *(_scores(m)[s].alias(f"{s}_1") for s in ("precision", "recall", "f1", "accuracy")),
        *(_scores(flipped)[s].alias(f"{s}_0") for s in ("precision", "recall", "f1")),
        (m["tp"] + m["fn"]).alias("n1"),
        (m["tn"] + m["fp"]).alias("n0"),
    )
    n0, n1 = F.col("n0"), F.col("n1")

    def entry(name: str, score) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            *(score(s).alias(s) for s in ("precision", "recall", "f1")),
        )

    rows = [
        (entry(names[0], lambda s: F.col(f"{s}_0")), n0),
        (entry(names[1], lambda s: F.col(f"{s}_1")), n1),
        (entry("accuracy", lambda s: F.col("accuracy_1")), n0 + n1),
        (entry("macro avg", lambda s: (F.col(f"{s}_0") + F.col(f"{s}_1")) / 2), n0 + n1),
        (
            entry(
                "weighted avg",
                lambda s: _ratio(F.col(f"{s}_0") * n0 + F.col(f"{s}_1") * n1, n0 + n1),
            ),
            n0 + n1,
        ),
    ]
    lines = F.array(*(F.struct(e.alias("e"), n.alias("support")) for e, n in rows))
    return wide.select(F.explode(lines).alias("x")).select("x.e.*", "x.support")


def valid_only_metrics(
    df: DataFrame, label: str = "label", pred: str = "prediction",
    ms: str | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """Metrics over rows with prediction 0 or 1; the others are counted. The
    anomaly counts are over all rows. Rates are rounded to 4 places."""
    y, p = F.col(label), F.col(pred)
    valid = F.coalesce(p.isin(0, 1), F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("total_samples"),
        F.count_if(valid).alias("valid_predictions"),
        F.count_if(~valid).alias("invalid_predictions"),
        F.count_if(y == 1).alias("anomaly_count"),
        F.count_if(p == 1).alias("predicted_anomaly_count"),
        *_cells(y, p),
        *(_latency(F.col(ms)) if ms else []),
    )
    s = _scores({x: F.col(x) for x in CELLS})
    s["invalid_rate"] = _ratio(F.col("invalid_predictions"), F.col("total_samples"))
    del s["hard_auc"]
    return counts.withColumns({k: F.round(v, 4) for k, v in s.items()})


def fallback_metrics(
    df: DataFrame, label: str = "label", pred: str = "prediction",
    fallback: str = "parse_fallback", ms: str | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """Metrics over all rows, and how many answers needed the fallback parse."""
    y, p = F.col(label), F.col(pred)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("total_samples"),
        F.count_if(y == 1).alias("anomaly_count"),
        F.count_if(p == 1).alias("predicted_anomaly_count"),
        F.sum(F.col(fallback).cast("long")).alias("parse_fallback_count"),
        *_cells(y, p),
        *(_latency(F.col(ms)) if ms else []),
    )
    s = _scores({x: F.col(x) for x in CELLS})
    keep = ("accuracy", "precision", "recall", "f1", "hard_auc")
    return counts.withColumns({k: F.round(s[k], 4) for k in keep})


def _latency(ms: Column) -> list[Column]:
    return [
        F.round(F.avg(ms), 2).alias("avg_inference_time_ms"),
        F.round(F.sum(ms) / 1000, 2).alias("total_inference_time_s"),
    ]


def latency_summary(df: DataFrame, ms: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *_latency(F.col(ms)))


def method_comparison(
    predictions: DataFrame, timings: dict[str, float] | None = None, weight: str | None = None
) -> DataFrame:
    """One row of metrics per method over (method, label, prediction) rows;
    measured stage times, where given, become constant columns."""
    out = binary_metrics(predictions, by=("method",), weight=weight)
    times = timings or {}
    out = out.withColumns({f"{k}_s": F.lit(float(v)) for k, v in times.items()})
    if times:
        rows = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        out = out.withColumn("avg_response_s", _ratio(F.lit(float(sum(times.values()))), rows))
    return out
