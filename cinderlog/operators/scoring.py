"""Prompts through a caller's scorer, in batches."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.operators import joins
from cinderlog.session import materialise, parallelism

# A caller's model: made once per task, it maps prompts to replies.
Scorer = Callable[[list[str]], list[str]]

# Words that make the built-in scorer answer "1".
# taken from the fixture's own lines
ALARM_WORDS = ("halted", "lost", "fault")
_ALARM = "(?i)\\b(" + "|".join(ALARM_WORDS) + ")\\b"


def keyword_score(text: Column) -> Column:
    """Built-in scorer as a column: "1" when an alarm word occurs, else "0"."""
    return F.when(F.rlike(text, F.lit(_ALARM)), "1").otherwise("0")


class KeywordScorer:
    """The same rule through the plug-in door; judges a prompt's last entry, all of it.

    ``max_new_tokens`` is the cap a model would get: the reply holds no more words.
    """

    def __init__(self, max_new_tokens: int = 512):
        self._alarm = re.compile(_ALARM)
        self._cap = max_new_tokens

    def __call__(self, prompts: list[str]) -> list[str]:
        # a prompt ends with the entry and, on a line of its own, the answer cue
        entries = (p.rsplit("\n\n", 1)[-1].rsplit("\n", 1)[0] for p in prompts)
        replies = ("1" if self._alarm.search(e) else "0" for e in entries)
        return [" ".join(r.split()[: self._cap]) for r in replies]


def text_key(text: Column) -> Column:
    """Stands for a text in joins, so that no text is shuffled twice."""
    return F.md5(text.cast("binary"))


# a text's replies: arrays, one entry for each setting
REPLIES = {"_setting": "int", "response": "string", "inference_time_ms": "double", "error": "string"}


def batch_score(
    table: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "prompt",
    build: Callable[[Column], Column] | None = None,
    batch: int = 8,
    tasks: int | None = None,
    error_reply: str = "0",
) -> DataFrame:
    """Add ``response``, ``inference_time_ms`` (batch time over batch size) and
    ``error``. Each distinct text is scored once; copies share its answer.

    ``build`` makes the prompt from the text, in the scoring tasks: prompts never
    take part in a shuffle. When a batch fails, its prompts are tried one by one; a
    prompt that fails alone keeps its row, with ``error_reply`` and the message.
    """
    settings = table.sparkSession.createDataFrame([(0,)], "_setting int")
    found = score_settings(
        table, settings, lambda _: make_scorer(), lambda t: build(t) if build else t,
        text, "_setting", batch, tasks, error_reply,
    )
    return found.drop("_setting")


def score_settings(
    table: DataFrame,
    settings: DataFrame,
    make_scorer: Callable[[int], Scorer],
    build: Callable[[Column], Column],
    text: str,
    cap: str,
    batch: int = 8,
    tasks: int | None = None,
    error_reply: str = "0",
    prompt_by: list[str] | None = None,
) -> DataFrame:
    """Every row of ``table`` under every setting, with response, time and error.

    ``settings`` is a short list that the caller wrote; ``build`` makes the prompt from
    the text's column and the settings' columns, or those in ``prompt_by`` alone: then
    settings that differ in others share a prompt. ``cap`` names the column that a
    scorer is made for. A distinct text goes to one task, once, whatever the number
    of settings; a row meets the replies to its text in one join on the text's key.
    Replies carry the number of their setting, not its values.
    """
    names = settings.columns
    prompt_by = prompt_by or names
    numbered = settings.withColumns({
        "_setting": F.row_number().over(Window.orderBy(*names)),  # a short list
        "_form": F.dense_rank().over(Window.orderBy(*prompt_by)),
    })
    asks: dict[int, list[tuple[int, int]]] = {}
    for row in numbered.select("_form", "_setting", cap).collect():
        asks.setdefault(row["_form"], []).append((row["_setting"], row[cap]))
    forms = numbered.select("_form", *prompt_by).distinct()
    keyed = materialise(table.withColumn("_key", text_key(F.col(text))), "asked")
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    texts = keyed.select("_key", F.col(text).alias("_text")).distinct()
    texts = texts.repartition(tasks or parallelism(table.sparkSession), "_key")
    # a text's prompts stay together: the grid unfolds in place
    asked = experiment_grid(texts, forms).select("_key", "_form", build(F.col("_text")).alias("_prompt"))
    kinds = ", ".join(f"{c} array<{kind}>" for c, kind in REPLIES.items())
    replies = asked.mapInPandas(_scoring(make_scorer, asks, batch, error_reply), f"_key string, {kinds}")
    # written once: the model is costly
    replies = materialise(replies, "replies").select(
        "_key", F.arrays_zip(*REPLIES).alias("_replies")
    )
    joined = joins.lookup_inner(keyed, replies, "_key", counts=counts, written=True)
    rows = joined.select(*table.columns, F.inline("_replies"))
    return rows.join(F.broadcast(numbered.drop("_form")), "_setting").select(
        *table.columns, *names, *(c for c in REPLIES if c != "_setting")
    )


def _scoring(make_scorer, asks: dict[int, list[tuple[int, int]]], batch: int, error_reply: str):
    """``asks`` tells for each form of prompt the settings (number, cap) that share it."""
    by_cap: dict[int, dict[int, list[int]]] = {}
    for form, pairs in asks.items():
        for setting, value in pairs:
            if value is None:  # no scorer for it
                continue
            by_cap.setdefault(value, {}).setdefault(form, []).append(setting)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers: dict[int, Scorer] = {}
        # the last text of a frame may have prompts in the next
        key, mine = None, []
        for frame in frames:
            prompts, forms = frame["_prompt"].tolist(), frame["_form"].tolist()
            replies = [[] for _ in prompts]
            for value in sorted(by_cap):
                if value not in scorers:
                    scorers[value] = make_scorer(value)
                places = [(i, s) for i, form in enumerate(forms) for s in by_cap[value].get(form, ())]
                score = scorers[value]
                for at in range(0, len(places), batch):
                    part = places[at : at + batch]
                    asked = [prompts[i] for i, _ in part]
                    began = time.perf_counter()
                    try:
                        results = [(r, None) for r in score(asked)]
                    except Exception:
                        results = [_alone(score, p, error_reply) for p in asked]
                    each = (time.perf_counter() - began) * 1000 / len(part)
                    for (i, setting), (reply, error) in zip(part, results, strict=True):
                        replies[i].append((setting, reply, each, error))
            done = []
            for name, some in zip(frame["_key"].tolist(), replies):
                if name != key:
                    if mine:
                        done.append((key, *map(list, zip(*mine))))
                    key, mine = name, []
                mine.extend(some)
            if done:
                yield pd.DataFrame(done, columns=["_key", *REPLIES])
        if mine:
            yield pd.DataFrame([(key, *map(list, zip(*mine)))], columns=["_key", *REPLIES])

    return run


def _alone(score: Scorer, prompt: str, error_reply: str) -> tuple[str, str | None]:
    try:
        return score([prompt])[0], None
    except Exception as e:
        return error_reply, str(e)


def experiment_grid(lines: DataFrame, configs: DataFrame) -> DataFrame:
    """Every line with every setting. The settings are a short list that the
    caller wrote; it becomes one array value that each line unfolds in place,
    so no line moves."""
    names = configs.columns
    settings = configs.agg(F.array_sort(F.collect_list(F.struct(*names)))).scalar()
    return (
        lines.withColumn("_settings", settings)
        .withColumn("_s", F.explode("_settings"))
        .select(*lines.columns, *(F.col("_s")[n].alias(n) for n in names))
    )


def first_examples(
    pool: DataFrame, most: dict[int, int], id_: str = "line_id", label: str = "label"
) -> DataFrame:
    """The first ``most[label]`` examples of each label by id, with their ``rank`` from 1.

    Each label is a top-n by id, so tasks hand over at most n rows. Written: all
    mixes of a sweep take their examples from here.
    """
    parts = [
        pool.where(F.col(label) == value).orderBy(id_).limit(n) for value, n in most.items() if n
    ]
    some = reduce(DataFrame.unionByName, parts) if parts else pool.limit(0)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(id_))  # n rows
    return materialise(some.withColumn("rank", rank), "examples")


def mix_of(
    examples: DataFrame, n_abnormal: int, n_normal: int, label: str = "label"
) -> DataFrame:
    """A mix from ``first_examples``, abnormal ones first."""
    wanted = F.when(F.col(label) == 1, n_abnormal).otherwise(n_normal)
    return examples.where(F.col("rank") <= wanted).drop("rank").orderBy(F.desc(label), "line_id")


def example_mix(
    pool: DataFrame, n_abnormal: int, n_normal: int, id_: str = "line_id", label: str = "label"
) -> DataFrame:
    """The first examples of each label by id, abnormal ones first."""
    some = first_examples(pool, {1: n_abnormal, 0: n_normal}, id_, label)
    return some.drop("rank").orderBy(F.desc(label), id_)


def folded(examples: DataFrame, style: str, id_: str = "line_id") -> DataFrame:
    """One value: the examples' text block, abnormal ones first, then by id."""
    from cinderlog.functions.prompts import examples_block

    order = F.array_sort(
        F.collect_list(F.struct((-F.col("label")).alias("_o"), id_, "log", "label"))
    )
    return examples.agg(order.alias("e")).select(examples_block(F.col("e"), style).alias("block"))
