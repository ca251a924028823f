"""Prompt texts as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PromptStyle:
    """Wording of one prompt: instructions, then entries, then the answer cue."""

    instructions: str
    entry: str
    answer: str
    examples_head: str = "Solved entries:"
    final_head: str = "Now the entry to judge."


STYLES = {
    "strict": PromptStyle(
        "Judge one entry of a supercomputer log.\n"
        "The entry gives its type, component, level and content.\n"
        "Write 0 if it is normal and 1 if it is abnormal; write that digit alone.\n"
        "A severe level by itself proves nothing: go by the content.",
        "Entry:",
        "Digit:",
    ),
    "detailed": PromptStyle(
        "Below is a record that a large machine wrote about itself.\n"
        "Would an operator on duty have to act on it? Then it is abnormal: 1.\n"
        "Can it wait, or did the machine cope alone? Then it is normal: 0.\n"
        "Your whole reply is that one character.",
        "Entry:",
        "Verdict:",
    ),
    "short": PromptStyle(
        "Is this log entry normal (0) or abnormal (1)? One digit, please.",
        "Entry:",
        "Label:",
    ),
    "rules": PromptStyle(
        "One unedited line from a machine's journal follows.\n"
        "Say 1 if somebody's job was harmed by what it tells, 0 if nobody's was.\n"
        "Words such as FATAL are used freely there and decide nothing.\n"
        "Reply with 0 or 1.",
        "Line:",
        "Verdict:",
    ),
    "json": PromptStyle(
        "Judge one raw line of a supercomputer log: 0 normal, 1 abnormal.\n"
        'Reply in JSON: {"Label": "0" or "1", "line": "<the line>"}',
        "Line:",
        "Reply:",
    ),
}


def zero_shot_prompt(log_text: Column, style: str = "strict") -> Column:
    s = STYLES[style]
    return F.concat(
        F.lit(f"{s.instructions}\n\n{s.entry} "), log_text, F.lit(f"\n{s.answer}")
    )


def examples_block(examples: Column, style: str = "strict") -> Column:
    """Fold an array of (log, label) structs into one text, in array order."""
    s = STYLES[style]
    return F.array_join(
        F.transform(
            examples,
            lambda e: F.concat(
                F.lit(f"{s.entry} "), e["log"], F.lit(f"\n{s.answer} "), e["label"].cast("string")
            ),
        ),
        "\n\n",
    )


def few_shot_prompt(log_text: Column, block: Column, style: str = "strict") -> Column:
    """Instructions, the folded examples, then the entry."""
    s = STYLES[style]
    return F.concat(
        F.lit(f"{s.instructions}\n\n{s.examples_head}\n\n"),
        block,
        F.lit(f"\n\n{s.final_head}\n\n{s.entry} "),
        log_text,
        F.lit(f"\n{s.answer}"),
    )
