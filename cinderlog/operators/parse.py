"""From raw lines to parsed, masked and labelled records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import masks
from cinderlog.functions import text as tx

# fixed values: field positions of a log line (from 0), the tag of a normal line
# and of any other, and columns to drop
MIN_TOKENS = 10
NORMAL_TAG = rf"^-(?:{tx.ANY_SPACE}|\z)"
ALERT_TAG = rf"^(?!-(?:{tx.ANY_SPACE}|\z)){tx.ANY_SPACE.replace('[', '[^', 1)}+"
LEADING_TOKENS = {"bgl": 3, "thunderbird": 3, "hdfs": 1}
# digits that a shape shows as 1; with a mark of hexadecimal numbers, which a mask looks
# for, all but the 0 of the mark
LIKE_ONE, HEX_MARKS = "023456789", ("0x", "0X")
LIKE_ONE_BUT_MARKS = "0(?![xX])|[2-9]"


def label_from_first_token(line: Column) -> Column:
    """0 for "-", 1 for anything else, null for a blank line."""
    bare = tx.strip(line)
    return F.when(bare != "", 1 - F.rlike(bare, F.lit(NORMAL_TAG)).cast("int"))


def label_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.withColumn("label", label_from_first_token(F.col(line)))


def drop_malformed(
    lines: DataFrame, line: str = "line", min_tokens: int = MIN_TOKENS
) -> DataFrame:
    """Keep lines with enough tokens; ``min_tokens=1`` skips blank lines only."""
    return lines.where(F.size(tx.tokens(F.col(line))) >= min_tokens)


def drop_header(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(F.lower(tx.strip(F.col(line))) != masks.HEADER_LINE)


def format_log_text(type_: Column, component: Column, level: Column, content: Column) -> Column:
    return F.concat(
        F.lit("TYPE="), type_, F.lit(" COMPONENT="), component,
        F.lit(" LEVEL="), level, F.lit(" CONTENT="), content,
    )


def parse_fields(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """Structured records of well-formed lines.

    Columns: line_id, alert_tag, label, type, component, level, content,
    log_text, raw_line.
    """
    t = F.col("_t")
    parts = lines.select(
        F.col(line_id).alias("line_id"),
        tx.tokens(F.col(line)).alias("_t"),
        tx.strip(F.col(line)).alias("raw_line"),
    ).where(F.size("_t") >= MIN_TOKENS)
    fields = parts.select(
        "line_id",
        t[0].alias("alert_tag"),
        F.when(t[0] == "-", 0).otherwise(1).alias("label"),
        t[6].alias("type"),
        t[7].alias("component"),
        t[8].alias("level"),
        F.array_join(F.slice(t, 10, F.size(t) - 9), " ").alias("content"),
        "raw_line",
    )
    return fields.withColumn(
        "log_text",
        format_log_text(*(F.col(c) for c in ("type", "component", "level", "content"))),
    )


def extract_timestamp(lines: DataFrame, line: str = "line", dataset: str = "bgl") -> DataFrame:
    """Add ``ts`` (TIMESTAMP_NTZ); null where the line has no valid one."""
    find = {"bgl": masks.bgl_timestamp, "thunderbird": masks.thunderbird_timestamp}[dataset]
    return lines.withColumn("ts", find(F.col(line)))


def preprocess(
    lines: DataFrame, dataset: str = "bgl", labelled: bool = True, line: str = "line"
) -> DataFrame:
    """Mask, label and normalise raw lines.

    Adds ``ts`` (null for hdfs), ``session_id`` (hdfs only), ``sentence``,
    ``label`` (when ``labelled``) and ``reject``: null for a usable line, else
    why it is not ("blank", "no_timestamp", "no_block_id"); its label and sentence
    then mean nothing. Header lines go.
    The masks run once per line, in one pass without a shuffle.
    """
    text = F.col("_text")
    df = drop_header(lines, line).withColumn("_text", tx.strip(F.col(line)))
    if dataset == "hdfs":
        df = df.withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn(
            "session_id", masks.first_block_id(text)
        )
        found, lack, mask = F.col("session_id"), "no_block_id", masks.mask_hdfs
    else:
        find, mask = {
            "bgl": (masks.bgl_timestamp, masks.mask_bgl),
            "thunderbird": (masks.thunderbird_timestamp, masks.mask_thunderbird),
        }[dataset]
        df = df.withColumn("ts", find(text)).withColumn(
            "session_id", F.lit(None).cast("string")
        )
        found, lack = F.col("ts"), "no_timestamp"
    df = df.withColumn(
        "reject", F.when(text == "", "blank").when(found.isNull(), lack)
    ).withColumn("_masked", tx.strip(mask(text)))
    if labelled:
        # each step names its input once: Catalyst may write steps into each other
        df = df.withColumn(
            "label", 1 - F.rlike(F.col("_masked"), F.lit(NORMAL_TAG)).cast("int")
        )
        if dataset != "hdfs":
            df = df.withColumn("_masked", F.regexp_replace("_masked", ALERT_TAG, ""))
    # never null: else a join on it would add a null check, which Catalyst
    # pushes below and so masks every line twice
    sentence = tx.drop_leading_words(tx.normalise(F.col("_masked")), LEADING_TOKENS[dataset])
    df = df.withColumn("sentence", F.coalesce(sentence, F.lit("")))
    return df.drop("_text", "_masked")


def usable(records: DataFrame) -> DataFrame:
    return records.where(F.col("reject").isNull()).drop("reject")


def line_shape(line: Column) -> Column:
    """The line with its ASCII digits as 1, but for the 0 of 0x.

    Masks know digits as a class only, and sentences have none, so lines of one shape have
    one sentence, one label and one mask at each place. Whether a time stamp is a date is
    the line's own.
    """
    marked = reduce(Column.__or__, (F.contains(line, F.lit(m)) for m in HEX_MARKS))
    return F.when(marked, F.regexp_replace(line, LIKE_ONE_BUT_MARKS, "1")).otherwise(
        F.translate(line, LIKE_ONE, "1" * len(LIKE_ONE))
    )


def shape_counts(
    lines: DataFrame, dataset: str = "bgl", by: tuple[str, ...] = (), line: str = "line"
) -> DataFrame:
    """(by, line, n): the usable lines, those of one shape merged into it on the map side.

    ``preprocess`` gives a shape the label and sentence of its lines; its ``ts``,
    ``session_id`` and ``reject`` mean nothing.
    """
    ready = usable(preprocess(lines, dataset, labelled=False, line=line))
    return ready.groupBy(*by, line_shape(F.col(line)).alias(line)).agg(F.count("*").alias("n"))


def rejected(records: DataFrame) -> DataFrame:
    return records.where(F.col("reject").isNotNull())


def prediction_flags(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.withColumns(
        {
            "is_valid_prediction": F.coalesce(F.col(pred).isin(0, 1), F.lit(False)),
            "correct": F.coalesce(F.col(label) == F.col(pred), F.lit(False)),
        }
    )
