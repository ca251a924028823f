"""Reading a 0/1 answer out of a model's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.functions import text as tx

# --- fixed values: what an answer looks like --------------------------------
_REASONING = r"(?s)<think>.*?</think>"
_FIRST_ALONE = r"(?U)\b([01])\b"
_LAST_ALONE = r"(?Us)^.*\b([01])\b"
_FIRST_ANY = r"([01])"
_LAST_ANY = r"(?s)^.*([01])"
_FLAT_LABEL_OBJECT = r'\{[^{}]*"Label"[^{}]*\}'
_STRICT_JSON = {
    "allowSingleQuotes": "false", "allowUnquotedFieldNames": "false",
    "allowNumericLeadingZeros": "false", "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": "_bad",
}
# --- end of fixed values ----------------------------------------------------


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def strip_reasoning(reply: Column) -> Column:
    """Delete closed reasoning spans; an unclosed tag stays."""
    return tx.strip(F.regexp_replace(reply, _REASONING, ""))


def parse_strict(reply: Column) -> Column:
    """First standalone 0/1, else -1."""
    return F.coalesce(
        _group(strip_reasoning(reply), _FIRST_ALONE).cast("int"), F.lit(-1)
    )


def parse_first(reply: Column) -> Column:
    """First standalone 0/1, else the first one anywhere, else 0."""
    bare = strip_reasoning(reply)
    return F.coalesce(
        _group(bare, _FIRST_ALONE), _group(bare, _FIRST_ANY), F.lit("0")
    ).cast("int")


def used_fallback(reply: Column) -> Column:
    """1 unless the reply holds a standalone 0/1."""
    return F.when(F.rlike(strip_reasoning(reply), F.lit(_FIRST_ALONE)), 0).otherwise(1)


def parse_last(reply: Column) -> Column:
    """Last standalone 0/1, else the last one anywhere, else "0".

    A reply that is just the digit is the simplest case of the first rule.
    """
    bare = strip_reasoning(reply)
    return F.coalesce(_group(bare, _LAST_ALONE), _group(bare, _LAST_ANY), F.lit("0"))


def parse_json_label(reply: Column, line: Column) -> Column:
    """Struct (label, line): the first flat JSON object with a ``Label`` wins,
    with its own ``line``; else any "0", else any "1", else "1". The object must be
    strict JSON (double quotes, no raw control characters); of repeated keys the
    last counts."""
    found = F.nullif(F.regexp_extract(reply, _FLAT_LABEL_OBJECT, 0), F.lit(""))
    read = F.from_json(found, "Label string, line string, _bad string", _STRICT_JSON)
    usable = F.coalesce(
        F.array_contains(F.json_object_keys(found), "Label") & read["_bad"].isNull(),
        F.lit(False),
    )
    return F.struct(
        F.when(usable, read["Label"])
        .when(F.contains(reply, F.lit("0")), "0")
        .otherwise("1")
        .alias("label"),
        F.when(usable, read["line"])
        .otherwise(tx.strip(line))
        .alias("line"),
    )


def json_label(reply: Column) -> Column:
    return parse_json_label(reply, F.lit(""))["label"]


PARSERS = {
    "strict": parse_strict,
    "first": parse_first,
    "last": parse_last,
    "json": json_label,
}
