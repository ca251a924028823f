"""Exact token ids of whole texts, with a cache of encoded pieces.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
Both vocabularies split a text into pieces that are encoded on their own, so a
piece met before need not be encoded again. That holds for texts of common
Latin characters, single blanks and line breaks; any other text goes through the
tokenizer as a whole. The cache is emptied when it is full, which costs time
only.
"""

from __future__ import annotations

import re
import sys
from array import array
from types import ModuleType

from tokenizers import Tokenizer

CACHE_PIECES = 700_000
LETTER = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff"
COMMON = bytes(
    [10, *range(32, 127), 0xA1, 0xAB, 0xBB, 0xBF, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
)


def unusual(text: str) -> bool:
    """Other characters, runs of blanks, a blank at the end, marks of special tokens."""
    try:
        rest = text.encode("latin-1").translate(None, COMMON)
    except UnicodeEncodeError:
        return True
    return bool(rest) or text[-1:].isspace() or any(x in text for x in ("  ", " \n", "\n ", "\n\n", "<|"))


def _byte_names() -> dict[int, int]:
    """Byte -> code point of the character that byte-level vocabularies use for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder(dict):
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    The dictionary itself is the cache, from a piece to the bytes of its ids.
    """

    split = None

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.names = _byte_names()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        shown = piece.encode().decode("latin-1").translate(self.names)
        found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self[piece] = found
        return found

    def prepared(self, text: str) -> str:
        return text

    def encode(self, text: str) -> bytes:
        if unusual(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        return b"".join(map(self.__getitem__, self.split(self.prepared(text))))


class LowerWords(Encoder):
    """Vocabulary with word ends: lower case, white space dropped."""

    split = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+"
    ).findall

    def prepared(self, text: str) -> str:
        return text.lower()


class SpacedBytes(Encoder):
    """Byte-level vocabulary: a blank belongs to the word after it."""

    split = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s"
    ).findall


def encoder(kind: str, path: str) -> Encoder:
    """One encoder per Python worker, kept from task to task.

    The functions of this package travel with each job, so what shall outlive a task
    is kept in a module of its own in the worker.
    """
    kept = sys.modules.setdefault("_kept_encoders", ModuleType("_kept_encoders")).__dict__
    if (kind, path) not in kept:
        kept[kind, path] = {"lower": LowerWords, "spaced": SpacedBytes}[kind](path)
    return kept[kind, path]
