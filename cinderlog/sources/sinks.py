"""Writers. ``once`` leaves finished output alone, so a job can be resumed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cinderlog.operators import sampling


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job wrote ``path`` to its end: the marker is the last thing it writes.
    What a failed run left behind does not count."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_split(
    split: DataFrame, path: str, id_: str = "line_id", line: str = "line", once: bool = True
) -> DataFrame:
    """Write ``path/lines/split=train`` and ``split=test`` as text, and ``path/sizes`` as
    JSON; returns the sizes. One pass: the sizes are counted on the way, and rows
    keep the order they come in."""
    spark = split.sparkSession
    if not (once and finished(spark, f"{path}/sizes")):
        seen = Observation()
        counted = split.observe(seen, *sampling.split_size_columns("label"))
        counted.select("split", line).write.mode("overwrite").partitionBy("split").text(
            f"{path}/lines"
        )
        sizes = spark.createDataFrame([seen.get])
        write_metrics(sizes.select("train_normal", "test_normal", "test_abnormal"), f"{path}/sizes")
    return spark.read.json(f"{path}/sizes")


def escaped(text: Column) -> Column:
    """Line breaks as ``\\n`` and ``\\r``, so that a row of text stays one line."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _csv(df: DataFrame, path: str, **options: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options,
    )


def write_predictions(
    df: DataFrame, path: str, fmt: str = "json", once: bool = False, escape_breaks: bool = True
) -> None:
    """JSON lines, or CSV with a header. CSV keeps outer blanks; line breaks in its
    values are escaped (a missing value is ``\\\\N``), or with ``escape_breaks=False`` stay as they are in quotes."""
    if fmt not in ("json", "csv"):
        raise ValueError("predictions are written as json or csv")
    if once and finished(df.sparkSession, path):
        return
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif escape_breaks:
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        _csv(df.withColumns({c: escaped(F.col(c)) for c in texts}), path, nullValue="\\N")
    else:
        _csv(df, path)


def write_metrics(
    metrics: DataFrame, path: str, once: bool = False, fmt: str = "json",
    **metadata: str | int | float,
) -> None:
    """A few rows of metrics, with the run's settings as columns, as JSON or CSV."""
    if once and finished(metrics.sparkSession, path):
        return
    out = metrics.withColumns({k: F.lit(v) for k, v in metadata.items()}).coalesce(1)
    if fmt == "csv":
        _csv(out, path)
    else:
        out.write.mode("overwrite").json(path)


def stage(
    df: DataFrame, path: str, settings: dict | None = None, files: Sequence[str] | None = None
) -> DataFrame:
    """Parquet between the steps of a job; finished work is read back, unfinished
    work is done again. With ``settings`` the folder is named by them and by the state of
    the ``files`` it comes from (by default those that ``df`` reads), so that changed
    inputs or settings are new work."""
    if settings is not None:
        files = df.inputFiles() if files is None else files
        path = f"{path}/{fingerprint(df.sparkSession, files, settings)}"
    if not finished(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- stages of several parts ----------------------------------------------------


def _status(spark: SparkSession, files: Sequence[str]) -> list[list]:
    """Name, size and time of change of each file, as the file system has them."""
    out = []
    for name in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append([name, status.getLen(), status.getModificationTime()])
    return out


def fingerprint(spark: SparkSession, files: Sequence[str], settings: dict) -> str:
    """Stands for the state of input files and a step's settings."""
    state = json.dumps([_status(spark, files), settings], sort_keys=True, default=str)
    return hashlib.sha256(state.encode()).hexdigest()[:32]


def stage_parts(
    spark: SparkSession,
    files: Sequence[str],
    build: Callable[[list[str]], DataFrame],
    path: str,
    settings: dict | None = None,
    files_per_part: int = 64,
) -> DataFrame:
    """A stage that is written part by part and resumed where it stopped.

    A part is what ``build`` makes of ``files_per_part`` input files; its folder is named by
    the fingerprint of these files and the ``settings``. Finished parts are read back;
    missing ones, and those whose files or settings have changed, are built. What
    earlier inputs left behind is not read. ``path/manifest`` has a row (part, fingerprint,
    files, built) for each part of the latest run.
    """
    names, rows = sorted(files), []
    for k, at in enumerate(range(0, len(names), files_per_part)):
        own = names[at : at + files_per_part]
        mark = fingerprint(spark, own, settings or {})
        built = not finished(spark, f"{path}/part-{mark}")
        if built:
            build(own).write.mode("overwrite").parquet(f"{path}/part-{mark}")
        rows.append((k, mark, own, built))
    if not rows:
        raise ValueError("a stage needs input files")
    manifest = spark.createDataFrame(rows, "part int, fingerprint string, files array<string>, built boolean")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.parquet(*(f"{path}/part-{mark}" for _, mark, *_ in rows))


# --- long texts -----------------------------------------------------------------


def write_session_texts(pieces: DataFrame, path: str) -> None:
    """Sessions as lines ``session_id<TAB>label<TAB>text`` from pieces (session_id, label,
    piece); the text is "- " for a normal session, then its pieces in order, joined.

    Pieces are sorted by session and streamed: each is a row up to the file, where a blank
    ends it. Only there they become one line, so a session may be larger than a task's memory.
    """
    head = F.concat_ws("\t", "session_id", F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit(""))
    mark = F.when(F.col("label") == 0, "- ").otherwise("")
    ordered = (
        pieces.select("session_id", F.concat(head, mark).alias("head"), "piece")
        .repartition("session_id")
        .sortWithinPartitions("session_id", "piece")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = waiting = None
        for batch in batches:
            out = []
            for name, head, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if name == session:
                    out.append(waiting)
                    waiting = piece
                else:
                    waiting = f"{head}{piece}" if session is None else f"{waiting}\n{head}{piece}"
                    session = name
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{waiting}\n"])], ["value"])

    ordered.mapInArrow(run, "value string").write.mode("overwrite").text(path, lineSep=" ")


def read_session_texts(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, label, text) as ``write_session_texts`` left them."""
    fields = F.split("value", "\t", 3)
    # the last separator of a file stands on a line of its own
    return spark.read.text(path, lineSep="\n").where(F.contains("value", F.lit("\t"))).select(
        fields[0].alias("session_id"), F.nullif(fields[1], F.lit("")).cast("int").alias("label"),
        fields[2].alias("text"),
    )
