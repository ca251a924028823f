"""Lines judged as they arrive: Structured Streaming with the scored templates as static side.

Masking needs no state, and a line's decision needs its template's score alone, so a
stream of lines is masked, joined to the scores and cut at the threshold, without a
watermark or a shuffle of the lines' text. Each trigger reads files not read before; what
has been read is kept with the output, so a stopped stream goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderlog.operators import joins, parse

LINES = "line_id long, line string"


def line_stream(
    spark: SparkSession, path: str, schema: str = LINES, fmt: str = "parquet", files: int = 1000
) -> DataFrame:
    """Files of lines as a stream, at most ``files`` new ones at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def judge_stream(
    lines: DataFrame, scores: DataFrame, threshold: float, dataset: str = "bgl", labelled: bool = True
) -> DataFrame:
    """Usable lines with their template's ``score`` and the ``prediction`` at the threshold.

    ``scores`` (sentence, score) is a table with a row per template. A line of a template
    that it lacks has neither, and ``novel`` is true: it waits for the next scoring run.
    """
    records = parse.usable(parse.preprocess(lines, dataset, labelled))
    keys = joins.hashes("sentence")
    known = scores.withColumns(keys).select(*keys, "score")
    found = records.withColumns(keys).join(known, list(keys), "left").drop(*keys)
    return found.withColumns(
        {
            "prediction": (F.col("score") >= F.lit(float(threshold))).cast("int"),
            "novel": F.col("score").isNull(),
        }
    )


def run_available(rows: DataFrame, folder: str) -> StreamingQuery:
    """Judge what is there, append it to ``folder/rows`` and stop; started again, go on
    with what is new. ``folder`` must be one that all executors share."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
