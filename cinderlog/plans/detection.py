"""Nearest-normal detection: lines to templates, vectors, scores, decisions.

Lines are read to count their shapes (the line without its digits' values); masks,
scores, thresholds and metrics then work on shapes and templates, each standing for
its number of lines. Only per-line predictions go back to the lines.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.operators import (
    embedding, metrics, parse, sampling, sessions, similarity, templates, thresholds,
)
from cinderlog.session import materialise, parallelism
from cinderlog.sources.sinks import stage

SCORE_DIGITS = 6


def split_lines(lines: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Lines with their ``split``, which follows the raw label."""
    split = sampling.normal_only_split(parse.label_lines(lines), test_size, "line_id")
    return split.drop("label")


def split_records(
    lines: DataFrame, test_size: float = 0.2, dataset: str = "bgl", folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) records: split on the raw label, then mask. With a folder
    both are kept there, so that later steps do not mask the lines again, as long as the
    files of ``lines`` and the settings stay the same."""
    split = split_lines(lines, test_size)

    def side(name: str, labelled: bool) -> DataFrame:
        part = split.where(F.col("split") == name).drop("split")
        done = parse.usable(parse.preprocess(part, dataset, labelled)).drop("line")
        settings = {"test": test_size, "dataset": dataset}
        return stage(done, f"{folder}/{name}", settings, lines.inputFiles()) if folder else done

    return side("train", False), side("test", True)


def merged_records(split: DataFrame, dataset: str = "bgl") -> tuple[DataFrame, DataFrame]:
    """(train, test) records of split lines, the lines of one shape as one record that
    stands for ``n``: the lines are read once, and only their shapes are masked. The
    shapes are written, dealt over all tasks for the case that they are many."""
    shapes = parse.shape_counts(split, dataset, ("split",))
    shapes = materialise(shapes.repartition(parallelism(split.sparkSession), "line"), "shapes")

    def side(name: str, labelled: bool) -> DataFrame:
        part = shapes.where(F.col("split") == name).drop("split")
        return parse.preprocess(part, dataset, labelled).drop("line", "ts", "session_id", "reject")

    return side("train", False), side("test", True)


def counted(test: DataFrame, weight: str | None = None) -> DataFrame:
    """(sentence, label, n): the test lines, merged on the map side."""
    n = F.sum(weight) if weight else F.count("*")
    return test.groupBy("sentence", "label").agg(n.alias("n"))


def split_sessions(
    lines: DataFrame, labels: DataFrame, test_size: float = 0.2, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) records of whole sessions: each session's text is one labelled
    line, split and preprocessed like the lines of a log. Sessions without a label go."""
    texts = sessions.session_text(sessions.session_parse(lines), labels).where("label IS NOT NULL")
    texts = texts.select(F.col("session_id").alias("line_id"), F.col("text").alias("line"), "label")
    split = sampling.normal_only_split(materialise(texts, "session-texts"), test_size, "line_id").drop("label")

    def side(name: str, labelled: bool) -> DataFrame:
        part = split.where(F.col("split") == name).drop("split")
        done = parse.usable(parse.preprocess(part, "hdfs", labelled)).drop("line")
        files = [*lines.inputFiles(), *labels.inputFiles()]
        return stage(done, f"{folder}/{name}", {"test": test_size}, files) if folder else done

    return side("train", False), side("test", True)


def embedded(
    table: DataFrame, make_embedder: Callable[[], embedding.Embedder] | None, name: str
) -> DataFrame:
    """Templates with ``tokens`` and ``first``, written once: the lines are masked
    in one pass, a caller's model runs once, and slot 0 is a column of its own."""
    if make_embedder is None:
        out = embedding.embed_builtin(table)
    else:
        out = embedding.embed_templates(table, make_embedder)
    return materialise(embedding.with_first(out), name)


METHODS = ("knn", "maxsim_max", "maxsim_mean")


def template_scores(
    train: DataFrame,
    test_counts: DataFrame,
    make_embedder: Callable[[], embedding.Embedder] | None = None,
    core_set: float = 0,
    methods: tuple[str, ...] = METHODS,
    novel_only: bool = False,
    first_only: bool = False,
    train_ratio: float = 1,
    weight: str | None = None,
) -> DataFrame:
    """(method, sentence, score): distance of each test template to normal ones.

    ``test_counts`` (sentence, label, n) should be a written table: it is read more
    than once. ``train_ratio`` draws a share of the training lines (line_id, sentence)
    for the bank, ``first_only`` compares first vectors alone. Training records may stand
    for ``weight`` lines each, but not where lines are drawn.
    """
    if train_ratio < 1:
        if weight:
            raise ValueError("a share of the training lines is drawn from lines, not from merged records")
        train = sampling.train_ratio_templates(train, train_ratio, "line_id", "sentence")
    bank = embedded(templates.templates(train, weight=weight), make_embedder, "bank")
    test = embedded(templates.templates(test_counts.select("sentence").distinct()), make_embedder, "test")
    if novel_only:
        test = templates.only_in_test(test, bank, written=True)
    if core_set:
        core_set = similarity.core_set_size(bank.count(), core_set)
    near = similarity.nearest(test, bank, int(core_set) or 1)
    if core_set:
        near = materialise(near, "neighbours")
    parts = []
    if "knn" in methods:
        parts.append(near.where("rank = 1").select(F.lit("knn").alias("method"), "test_id", F.col("distance").alias("score")))
    sims = [m for m in methods if m != "knn"]
    if sims:
        if sims == ["maxsim_max"] and not core_set:
            found = similarity.maxsim_best(test, bank, first_only=first_only)
        else:
            found = similarity.maxsim(
                test, bank, neighbours=near if core_set else None, first_only=first_only
            )
        long = found.select("test_id", F.inline(F.array(*(
            F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in sims
        )))).select("method", "test_id", "score")
        parts.append(thresholds.invert_scores(materialise(long, "similarities"), by=("method",)))
    long = reduce(
        DataFrame.unionByName,
        (p.select("method", "test_id", F.round("score", SCORE_DIGITS).alias("score")) for p in parts),
    )
    names = test.select(F.col("template_id").alias("test_id"), "sentence")
    # both sides have one row per template (and method)
    joined = long.join(names, "test_id").select("method", "sentence", "score")
    return materialise(joined, "scores")


def decide(scored: DataFrame, search: str = "prc", weight: str | None = None) -> DataFrame:
    """Add each method's own threshold decision to (method, label, score, …) rows.

    The threshold is tuned on the rows it judges, as in the published runs. All methods
    share one pass.
    """
    cuts = thresholds.SEARCHES[search](scored, weight=weight, by=("method",))
    return thresholds.apply_threshold(scored, cuts, by=("method",))


def evaluate(
    test_counts: DataFrame, scores: DataFrame, search: str = "prc",
    timings: dict[str, float] | None = None,
) -> DataFrame:
    """One row of metrics per method, every template weighted by its lines."""
    rows = scores.join(test_counts, "sentence")
    return metrics.method_comparison(decide(rows, search, "n"), timings, weight="n")


def detection_report(
    train: DataFrame, test: DataFrame, search: str = "prc", timed: bool = False,
    weight: str | None = None, **options
) -> DataFrame:
    """One row of metrics per method from (train, test) records, which may stand for
    ``weight`` lines each. ``timed`` adds the seconds that counting, scoring and deciding
    took."""
    clock = [time.perf_counter()]
    counts = materialise(counted(test, weight), "test-counts")
    clock.append(time.perf_counter())
    scores = template_scores(train, counts, weight=weight, **options)
    clock.append(time.perf_counter())
    spent = {"count": clock[1] - clock[0], "score": clock[2] - clock[1]} if timed else None
    return evaluate(counts, scores, search, spent)


def nearest_normal_report(
    lines: DataFrame, test_size: float = 0.2, search: str = "prc", dataset: str = "bgl",
    methods: tuple[str, ...] = ("knn",), **options,
) -> DataFrame:
    """Which lines look unlike anything normal, and how good is that? A row per method.

    Lines of one shape are masked once, unless ``train_ratio`` draws the bank from lines;
    with ``timed`` the seconds of splitting and merging them are not in the report.
    """
    weight = None
    if options.get("train_ratio", 1) < 1:
        train, test = split_records(lines, test_size, dataset)
    else:
        train, test = merged_records(split_lines(lines, test_size), dataset)
        weight = "n"
    return detection_report(train, test, search, methods=methods, weight=weight, **options)


def predict_lines(
    test: DataFrame, test_counts: DataFrame, scores: DataFrame, threshold: DataFrame
) -> DataFrame:
    """Per-line predictions of one method from its template scores. ``test`` should be a
    written table: it is read more than once."""
    counts = test_counts.groupBy("sentence").agg(F.sum("n").alias("_n"))
    rows = templates.score_rows(
        test, scores.select("sentence", "score"), "sentence", counts, written=True
    )
    return thresholds.apply_threshold(rows, threshold)
