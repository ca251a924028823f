"""Sessions: log lines that name the same block id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import masks
from cinderlog.functions import text as tx

# fixed values: session key in a line, and fields in front of the content
SESSION_KEY = r"blk_-?[0-9]+"
LEADING_FIELDS = 3


def _keys(line: str):
    return F.array_distinct(F.regexp_extract_all(F.col(line), F.lit(SESSION_KEY), F.lit(0)))


def sessionise(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """(session_id, line_id, line): a line goes to every session it names.

    Kept one row per line, in line order by ``line_id``: a session may hold
    a large share of all lines, so its lines are never put into one row.
    """
    return lines.select(
        F.explode(_keys(line)).alias("session_id"),
        F.col(line_id).alias("line_id"),
        F.col(line).alias("line"),
    )


def session_sizes(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("session_id").agg(
        F.count("*").alias("n_lines"), F.min("line_id").alias("first_line_id")
    )


def session_parse(lines: DataFrame, line_id: str = "line_id", line: str = "line") -> DataFrame:
    """(session_id, line_id, block_id, parsed): each line is masked once, before
    it goes to its sessions. ``block_id`` is the first one in the content; it is
    null, and the line unusable, when the mask's stricter pattern finds none."""
    content = lines.select(
        F.col(line_id).alias("line_id"),
        _keys(line).alias("_keys"),
        tx.drop_leading_tokens(F.col(line), LEADING_FIELDS).alias("_content"),
    ).where(F.size("_keys") > 0)
    parsed = content.select(
        "line_id",
        "_keys",
        masks.first_block_id(F.col("_content")).alias("block_id"),
        tx.normalise(masks.mask_hdfs(F.col("_content"))).alias("parsed"),
    )
    return parsed.select(F.explode("_keys").alias("session_id"), "line_id", "block_id", "parsed")


def session_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label`` (0/1, null for a session without one). Of repeated ids the last by
    ``label_no`` counts; where there is no such column, the highest label. Both sides
    then hold one row per session, so the shuffle join is balanced."""
    label = F.col("label").cast("int")
    number = F.col("label_no") if "label_no" in labels.columns else F.lit(0)
    known = labels.groupBy("session_id").agg(F.max(F.struct(number.alias("no"), label.alias("label")))["label"].alias("label"))
    return sessions.join(known, "session_id", "left")


def session_pieces(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, label, piece): what a session's text is made of, one row each: its
    distinct masked lines and its first line's block id. Nothing is gathered."""
    usable = parsed.where(F.col("block_id").isNotNull())
    first = usable.groupBy("session_id").agg(F.min(F.struct("line_id", "block_id"))["block_id"].alias("piece"))
    pieces = usable.select("session_id", F.col("parsed").alias("piece")).unionByName(first).distinct()
    sessions = session_labels(first.select("session_id"), labels)
    # one row per session on the right, many on the left
    return pieces.join(sessions, "session_id").select("session_id", "label", "piece")


def session_text(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, label, text): the session's sorted distinct masked lines and
    its first line's block id, joined; "- " in front when normal.

    Copies of a masked line are merged per session before lines are gathered,
    so a row holds the distinct masked lines of one session, not its lines.
    """
    distinct = (
        parsed.where(F.col("block_id").isNotNull())
        .groupBy("session_id", "parsed")
        .agg(F.min(F.struct("line_id", "block_id")).alias("_first"))
    )
    gathered = distinct.groupBy("session_id").agg(
        F.collect_list("parsed").alias("_parsed"), F.min("_first").alias("_first")
    )
    text = F.array_join(
        F.array_sort(
            F.array_distinct(F.concat(F.array(F.col("_first.block_id")), F.col("_parsed")))
        ),
        " ",
    )
    labelled = session_labels(gathered, labels)
    return labelled.select(
        "session_id",
        "label",
        F.when(F.col("label") == 0, F.concat(F.lit("- "), text)).otherwise(text).alias("text"),
    )
