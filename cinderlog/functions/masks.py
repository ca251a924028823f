"""Masking of the variable parts of log lines.

Text patterns give digits, letters and whitespace their Unicode meaning. On a
line that is all ASCII the plain classes mean the same, so every chain exists in
both forms and the line picks one.

Whole tokens are matched from their start: where a token fails there, it fails
at every later position too, and the pattern need not try them. Classes list
their characters one by one, which the regex engine turns into a bit set.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions import text as tx

Steps = list[tuple[str, str]]


class Classes:
    """Character classes in one of the two forms."""

    def __init__(self, ascii_only: bool):
        self.flags = "(?d)" if ascii_only else "(?Ud)"
        self.digit = f"[{string.digits}]" if ascii_only else r"\d"
        self.word = f"[{string.ascii_letters}{string.digits}_]" if ascii_only else r"\w"
        self.space = tx.ASCII_SPACE if ascii_only else tx.ANY_SPACE
        self.solid = self.space.replace("[", "[^", 1)
        self.blank = self.space.replace("\\\n", "", 1)

    def fill(self, pattern: str) -> str:
        """Put the classes in: D digit, W word, S whitespace, N anything else, and
        B whitespace that ends no line."""
        for name, value in (
            ("D", self.digit), ("W", self.word), ("S", self.space), ("N", self.solid),
            ("B", self.blank),
        ):
            pattern = pattern.replace(f"<{name}>", value)
        return self.flags + pattern


# --- fixed values: what counts as variable, in order: (pattern, mask) --------
_LETTER = f"[{string.ascii_letters}]"
_ALNUM = f"[{string.ascii_letters}{string.digits}]"
_UPPER_DIGIT = f"[{string.ascii_uppercase}{string.digits}]"
_HEX = f"[{string.hexdigits}]"
_PATH_CHAR = rf"[{string.ascii_letters}{string.digits}_\-./]"
_IP = r"<D>{1,3}\.<D>{1,3}\.<D>{1,3}\.<D>{1,3}(?::<D>{1,5})?"
_STAMP = r"<D>{1,4}-<D>{1,2}-<D>{1,2}-<D>{1,2}\.<D>{1,2}\.<D>{1,2}\.<D>{1,6}"
_MONTH = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    "|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_NAME = r"<W>(?:<W>|\.)*"
_CLOCK = r"<D>{1,2}:<D>{1,2}:<D>{1,2}"
_DOTTED_DATE = r"<D>{2,4}\.<D>{1,2}\.<D>{1,2}<S>"
_BLOCK = r"blk_.<D>+"

BGL_STEPS: Steps = [
    (_STAMP, " TIME "),
    (_IP, " IP "),
    (r"<D>{1,4}\.<D>{1,2}\.<D>{1,2}", " TIME "),
    # a token, with the blank before it, that has /x past its start
    (rf"(?m)(?:<B>|^<N>)<N>+/{_ALNUM}<N>*", " PATH "),
    # a token with a colon (hyphen) past its start, when a digit and a letter
    # come later in the line
    (rf"(?<!<N>)<N>+(?=:)(?=.*[0-9])(?=.*{_LETTER})<N>+", " SERVER "),
    (rf"(?<!<N>)<N>+(?=-)(?=.*[0-9])(?=.*{_LETTER})<N>+", " SERVER "),
    (rf"{_UPPER_DIGIT}{{28}}", " ECID "),
    (rf"{_ALNUM}{{48}}", " SERIAL "),
    (rf"0[xX]{_HEX}<N>+", " MEMORY "),
    (rf"{_HEX}{{8}}", " IAR "),
    (r"<D>+", " NUM "),
]

THUNDERBIRD_STEPS: Steps = [
    (_DOTTED_DATE, "DATE "),
    (rf"{_MONTH}<S>+<D>{{1,2}}<S>+", "DATE "),
    (r"DATE<S>.*<S>DATE", "DATE ID DATE"),
    (_CLOCK, "TIME"),
    (r"TIME<S><N>+", "TIME ACCOUNT"),
    (rf"{_NAME}@{_NAME}-{_NAME}", "ACCOUNT"),
    (rf"{_NAME}@{_NAME}", "ACCOUNT"),
    (rf"{_PATH_CHAR}+/{_PATH_CHAR}+/{_PATH_CHAR}*", " DIR "),
    (rf"/{_PATH_CHAR}+/{_PATH_CHAR}*", " DIR "),
    (_IP, "IP"),
    (rf"{_HEX}{{10}}", "IAR"),
    (r"\[<D>+\]", " NUM "),
]

HDFS_STEPS: Steps = [
    (_BLOCK, "BLK"),
    (_IP, "IP"),
    (r"<D>+", "NUM"),
]

HEADER_LINE = "label timestamp date node time node_repeat type component level content"
# --- end of fixed values ----------------------------------------------------


def _either(text: Column, build: Callable[[Classes], Column]) -> Column:
    return F.when(tx.is_ascii(text), build(Classes(True))).otherwise(build(Classes(False)))


def _apply(line: Column, steps: Steps) -> Column:
    def chain(classes: Classes) -> Column:
        return reduce(
            lambda acc, step: F.regexp_replace(acc, classes.fill(step[0]), step[1]), steps, line
        )

    return _either(line, chain)


def _first(text: Column, pattern: str) -> Column:
    """First match, or an empty text."""
    return _either(text, lambda c: F.regexp_extract(text, c.fill(pattern), 0))


def mask_bgl(line: Column) -> Column:
    return _apply(tx.strip(line), BGL_STEPS)


def mask_thunderbird(line: Column) -> Column:
    return _apply(line, THUNDERBIRD_STEPS)


def mask_hdfs(line: Column) -> Column:
    return _apply(line, HDFS_STEPS)


def bgl_timestamp(line: Column) -> Column:
    """First full time stamp of the line as TIMESTAMP_NTZ; null if none or not a date."""
    iso = F.regexp_replace(
        _first(line, _STAMP),
        r"^(\d{4})-(\d+)-(\d+)-(\d+)\.(\d+)\.(\d+)\.(\d+)$",
        "$1-$2-$3 $4:$5:$6.$7",
    )
    return iso.try_cast("timestamp_ntz")


def thunderbird_timestamp(line: Column) -> Column:
    """First dotted date joined with the first clock time, as TIMESTAMP_NTZ."""
    day = F.regexp_replace(
        _first(line, _DOTTED_DATE), r"^(\d{4})\.(\d+)\.(\d+).*$", "$1-$2-$3"
    )
    return F.concat_ws(" ", day, _first(line, _CLOCK)).try_cast("timestamp_ntz")


def first_block_id(line: Column) -> Column:
    """Block id as the mask sees it: any one character, then digits."""
    return F.nullif(_first(line, _BLOCK), F.lit(""))
