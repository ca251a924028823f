"""Prompted classification: lines to prompts, replies, labels and metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import answers, prompts
from cinderlog.functions import text as tx
from cinderlog.operators import metrics, parse, runstats, sampling, scoring
from cinderlog.session import materialise


def judged(
    records: DataFrame,
    make_scorer: Callable[[], scoring.Scorer],
    examples: DataFrame | None = None,
    style: str = "strict",
    parser: str = "strict",
    batch: int = 8,
) -> DataFrame:
    """Score parsed records and add response, prediction and its flags.

    ``examples`` (line_id, log, label) makes the prompt few-shot.
    """
    if examples is None:
        def build(text):
            return prompts.zero_shot_prompt(text, style)
    else:
        block = scoring.folded(examples, style).scalar()

        def build(text):
            return prompts.few_shot_prompt(text, block, style)

    replied = scoring.batch_score(records, make_scorer, "log_text", build, batch=batch)
    read = answers.PARSERS[parser]
    return parse.prediction_flags(
        replied.withColumns(
            {
                "prediction": read(F.col("response")).cast("int"),
                "parse_fallback": answers.used_fallback(F.col("response")),
            }
        )
    )


def report(predictions: DataFrame) -> DataFrame:
    """One row: metrics of valid answers, counts, and latency."""
    return metrics.valid_only_metrics(predictions, ms="inference_time_ms")


def benchmark(
    records: DataFrame,
    make_scorer: Callable[[], scoring.Scorer],
    n: int | None,
    examples: DataFrame,
    style: str = "strict",
    seed: int = 42,
) -> DataFrame:
    """A stratified sample judged zero-shot and few-shot: the judged lines with ``mode``.

    Zero-shot answers are read strictly, few-shot ones with the fallback.
    """
    sample = materialise(
        sampling.stratified_sample_exact(records, n, "line_id", seed), "sample"
    )
    zero = judged(sample, make_scorer, None, style, "strict").withColumn("mode", F.lit("zero_shot"))
    few = judged(sample, make_scorer, examples, style, "first").withColumn("mode", F.lit("few_shot"))
    return materialise(zero.unionByName(few), "judged")


def benchmark_report(predictions: DataFrame) -> DataFrame:
    """One row per mode: metrics of valid answers, and of all answers with how many
    needed the fallback."""
    valid = metrics.valid_only_metrics(predictions, by=("mode",))
    whole = metrics.fallback_metrics(predictions, by=("mode",)).select(
        "mode", "parse_fallback_count", F.col("accuracy").alias("all_accuracy"),
        F.col("f1").alias("all_f1"),
    )
    return valid.join(whole, "mode")


def sweep_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(line_id, text): blank lines skipped, ends stripped, the label in front removed."""
    text = tx.drop_leading_tokens(F.col(line), 1)
    return lines.where(tx.strip(F.col(line)) != "").select("line_id", text.alias("text"))


def sweep(
    lines: DataFrame,
    pool: DataFrame,
    mixes: dict[str, tuple[int, int]],
    caps: list[int],
    make_scorer: Callable[[int], scoring.Scorer],
    style: str = "rules",
    zero_caps: list[int] = (),
    zero_style: str = "json",
) -> DataFrame:
    """Every line under every setting, as one job: the rows (line_id, mode, mix, cap,
    response, label_text, inference_time_ms, error).

    ``lines`` has (line_id, text); ``pool`` the labelled examples (line_id, log,
    label). Few-shot settings are mixes x caps, zero-shot ones have the mix "none"
    and answer in JSON. A scorer is made per cap.
    """
    most = {1: max((a for a, _ in mixes.values()), default=0), 0: max((n for _, n in mixes.values()), default=0)}
    examples = scoring.first_examples(pool, most)
    spark = lines.sparkSession
    # a short list that the caller wrote, with each mix's examples folded into a text
    blocks = reduce(
        DataFrame.unionByName,
        (
            scoring.folded(scoring.mix_of(examples, a, n), style).select(F.lit(mix).alias("mix"), "block")
            for mix, (a, n) in mixes.items()
        ),
        spark.createDataFrame([("none", "")], "mix string, block string"),
    )
    grid = [("few_shot", m, c) for m in mixes for c in caps] + [("zero_shot", "none", c) for c in zero_caps]
    settings = spark.createDataFrame(grid, "mode string, mix string, cap int").join(blocks, "mix")
    settings = materialise(settings.select("mode", "mix", "cap", "block"), "settings")

    def build(text):
        few = prompts.few_shot_prompt(text, F.col("block"), style)
        return F.when(F.col("mode") == "few_shot", few).otherwise(prompts.zero_shot_prompt(text, zero_style))

    slim = lines.select("line_id", "text")
    replied = scoring.score_settings(
        slim, settings, make_scorer, build, "text", "cap", prompt_by=["mode", "block"]
    ).drop("block")
    reply = F.col("response")
    # both parsers read a reply that is just the digit as that digit: no pattern is tried
    label = (
        F.when(reply.isin("0", "1"), reply)
        .when(F.col("mode") == "few_shot", answers.parse_last(reply))
        .otherwise(answers.json_label(reply))
    )
    return replied.withColumn("label_text", label).drop("text")


def sweep_stats(replied: DataFrame) -> DataFrame:
    return runstats.run_stats(replied, by=("mode", "mix", "cap"))
