"""Whitespace, tokens and normalised text."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace in text logs, by rule; and as a
# pattern class, for ASCII text and for any text.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
ASCII_SPACE = "[" + "".join(re.escape(c) for c in WHITESPACE if c < "\x80") + "]"
ANY_SPACE = "[" + "".join(re.escape(c) for c in WHITESPACE) + "]"


# listed one by one: the regex engine makes a bit set of that
_NOT_KEPT = f"[^{string.ascii_letters}<>]+"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends, without a regex."""
    return F.btrim(text, F.lit(WHITESPACE))


def _split(text: Column) -> Column:
    return F.when(is_ascii(text), F.split(text, ASCII_SPACE + "+")).otherwise(
        F.split(text, ANY_SPACE + "+")
    )


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens; a blank line has none."""
    return F.array_remove(_split(strip(text)), "")


def drop_leading_tokens(text: Column, k: int) -> Column:
    """The tokens from number k on, joined by single spaces."""
    return F.array_join(F.slice(_split(strip(text)), k + 1, 2**31 - 1 - k), " ")


def drop_leading_words(text: Column, k: int) -> Column:
    """The same for text whose tokens are one space apart already."""
    return F.regexp_replace(text, f"^(?:[^ ]* ?){{{k}}}", "")


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """``translate`` arguments that strip accents.

    A character maps to its decomposition without combining marks when that
    is one of the characters normalised text keeps; the marks themselves have
    no counterpart and so are deleted. All else becomes a gap afterwards, so
    the table gives the same text as full decomposition would.
    """
    kept = re.compile("[a-zA-Z<>]")
    source, target, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"
        )
        if len(base) == 1 and base != char and kept.match(base):
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


def normalise(text: Column) -> Column:
    """Lower case, no accents, every run outside ASCII letters and <> one space."""
    source, target = accent_table()
    lowered = F.lower(strip(text))
    plain = F.when(is_ascii(lowered), lowered).otherwise(F.translate(lowered, source, target))
    return F.trim(F.regexp_replace(plain, _NOT_KEPT, " "))


def repair_utf8(text: Column, drop_bad: bool = False) -> Column:
    """Bad bytes become U+FFFD, or vanish (then a U+FFFD of the file itself goes too)."""
    fixed = F.make_valid_utf8(text)
    return F.replace(fixed, F.lit("�"), F.lit("")) if drop_bad else fixed
