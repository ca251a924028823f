"""Statistics of runs, and runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.operators import ordered


def run_stats(
    results: DataFrame, label: str = "label_text", ms: str = "inference_time_ms",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Per run: rows, time, throughput, and counts and shares of "0" and "1".
    Other labels count in the total only."""
    stats = results.groupBy(*by).agg(
        F.count("*").alias("total_logs"),
        (F.sum(ms) / 1000).alias("time_taken_seconds"),
        F.count_if(F.col(label) == "0").alias("normal_count"),
        F.count_if(F.col(label) == "1").alias("abnormal_count"),
    )
    total, seconds = F.col("total_logs"), F.col("time_taken_seconds")
    return stats.withColumns(
        {
            "avg_time_per_log_ms": F.try_divide(seconds, total) * 1000,
            "throughput_logs_per_second": F.try_divide(total, seconds),
            "normal_percentage": F.try_divide("normal_count", total) * 100,
            "abnormal_percentage": F.try_divide("abnormal_count", total) * 100,
        }
    )


def latency_percentiles(results: DataFrame, ms: str = "inference_time_ms") -> DataFrame:
    """One row: p50, p95, p99 latency, exact, and the throughput each one means."""
    p = ordered.percentiles(results, ms, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return p.withColumns(
        {f"{q}_logs_per_second": F.try_divide(F.lit(1000.0), f"{q}_ms") for q in ("p50", "p95", "p99")}
    )


def config_pivot(
    stats: DataFrame, value: str, caps: list[int], mix: str = "mix", cap: str = "cap"
) -> DataFrame:
    """One row per example mix, one column per token cap."""
    wide = stats.groupBy(mix).pivot(cap, caps).agg(F.first(value))
    return wide.select(mix, *(F.col(str(c)).alias(f"cap_{c}") for c in caps))


def best_config(
    stats: DataFrame, metrics: dict[str, bool], mix: str = "mix", cap: str = "cap"
) -> DataFrame:
    """(metric, mix, cap, value): the best run per metric; the flag says whether
    larger is better. Ties go to the first mix, then the smallest cap."""
    long = stats.select(
        mix,
        cap,
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col(m).cast("double").alias("value"),
                        (F.col(m) * (-1 if larger else 1)).cast("double").alias("_order"),
                    )
                    for m, larger in metrics.items()
                )
            )
        ).alias("x"),
    ).select(mix, cap, "x.*")
    rank = Window.partitionBy("metric").orderBy("_order", mix, cap)
    return (
        long.withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") == 1)
        .select("metric", mix, cap, "value")
    )
