"""Raw log text and labelled tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.functions import text as tx
from cinderlog.operators import ordered
from cinderlog.session import materialise
from cinderlog.sources import sinks

SPLIT_SETTINGS = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum", "maxPartitionNum")


def split_index(df: DataFrame, folder: str | None = None) -> DataFrame:
    """(_file_key, _split_start, _shift): what to add to the generated ids of an input
    split's rows to get their numbers in the files.

    One pass that reads no column counts the rows per split; running sums over a file's
    splits, and over the files, give the shifts. With a ``folder`` the index is kept
    there, under the state of the files and of the settings that cut them into splits,
    and read back as long as both are the same.
    """
    spark = df.sparkSession
    path = None
    if folder:
        conf = {x: spark.conf.get(f"spark.sql.files.{x}", None) for x in SPLIT_SETTINGS}
        conf["parallelism"] = spark.sparkContext.defaultParallelism
        path = f"{folder}/lines-{sinks.fingerprint(spark, df.inputFiles(), conf)}"
        if sinks.finished(spark, path):
            return spark.read.parquet(path)
    counted = df.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    ).groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = materialise(counted, "splits")
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    files = ordered.running_totals(files, "_file", {"_rows": "_upto"})
    in_file = Window.partitionBy("_file").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        splits.withColumn("_before", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
        .join(files.select("_file", (F.col("_upto") - F.col("_rows")).alias("_files")), "_file")
        .select(
            F.xxhash64("_file").alias("_file_key"), F.col("_start").alias("_split_start"),
            (F.col("_files") + F.col("_before") - F.col("_first")).alias("_shift"),
        )
    )
    return sinks.stage(shifts, path) if path else shifts


def number_rows(df: DataFrame, name: str = "line_id", index: str | None = None) -> DataFrame:
    """Add the physical row number, from 0, to a frame read straight from files
    in path order.

    Rows of one input split carry consecutive generated ids, which the ``split_index``
    shifts. No sort, no shuffle of the rows: each task gets the index, 24 bytes for a
    split of 128 MB, a five-millionth of the text. A row whose split
    the index lacks is an error, not a lost row.
    """
    shifts = split_index(df, index)
    marked = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    found = marked.join(
        F.broadcast(shifts),
        (F.xxhash64("_file") == F.col("_file_key")) & (F.col("_start") == F.col("_split_start")),
        "left",
    )
    shift = F.coalesce("_shift", F.raise_error(F.lit("the index lacks a split of the input")).cast("long"))
    return found.select((F.col("_at") + shift).alias(name), *df.columns)


def read_log_lines(
    spark: SparkSession, path: str, drop_bad: bool = False, index: str | None = None
) -> DataFrame:
    """(line_id, line): every physical line, blank ones too. Bad bytes become
    U+FFFD, or are dropped. ``index`` names a folder where line offsets are kept, so that
    the same files are not counted again."""
    numbered = number_rows(spark.read.text(path).withColumnRenamed("value", "line"), index=index)
    return numbered.withColumn("line", tx.repair_utf8(F.col("line"), drop_bad))


def _need(df: DataFrame, columns: set[str], what: str) -> None:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")


def unescaped(text: Column) -> Column:
    """Undo ``sinks.escaped``: ``\\n``, ``\\r`` and ``\\\\`` stand for themselves again."""
    mark = F.lit("\ufffe")  # not a character, so in no text
    out = F.replace(text, F.lit("\\\\"), mark)
    for code, char in (("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, mark, F.lit("\\"))


def read_csv(
    spark: SparkSession, path: str, escaped: bool = False, multi_line: bool = False
) -> DataFrame:
    """A CSV file with a header, all columns as text, outer blanks kept.

    Line breaks in values: ``escaped`` reads what ``sinks.write_predictions`` wrote, file
    parts at a time; ``multi_line`` reads quoted breaks, a whole file in one task.
    """
    df = _raw_csv(spark, path, escaped, multi_line)
    return df.select(*(unescaped(F.col(c)).alias(c) for c in df.columns)) if escaped else df


def _raw_csv(spark: SparkSession, path: str, escaped: bool, multi_line: bool) -> DataFrame:
    # escaped files tell an empty text from a missing one
    null = {"nullValue": "\\N"} if escaped else {}
    return spark.read.csv(
        path, header=True, escape='"', multiLine=multi_line,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **null,
    )


def read_labelled_csv(
    spark: SparkSession, path: str, escaped: bool = False, multi_line: bool = False
) -> DataFrame:
    """(id, log_text, label); a running id is added where the file has none."""
    df = _raw_csv(spark, path, escaped, multi_line)
    _need(df, {"log_text", "label"}, "labelled CSV")
    if "id" not in df.columns:
        df = number_rows(df, "id")
    text = F.col("log_text")
    return df.select(
        F.col("id").cast("long"), (unescaped(text) if escaped else text).alias("log_text"),
        F.trim("label").cast("int").alias("label"),
    )


def read_examples(
    spark: SparkSession, path: str, escaped: bool = False, multi_line: bool = False
) -> DataFrame:
    """(log, label) from a JSON array or a CSV file."""
    if path.lower().endswith(".json"):
        df = spark.read.json(path, multiLine=True)
    elif path.lower().endswith(".csv"):
        df = read_csv(spark, path, escaped, multi_line)
    else:
        raise ValueError("examples must be a .json or .csv file")
    _need(df, {"log", "label"}, "examples")
    return df.select("log", F.col("label").cast("int").alias("label"))


def read_session_labels(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, label, label_no) from BlockId,Label; "Anomaly" is 1, all else 0.
    ``label_no`` is the row's number in the files."""
    df = spark.read.csv(path, header=True, schema="BlockId string, Label string")
    return session_labels_of(number_rows(df, "label_no"))


def session_labels_of(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("BlockId").alias("session_id"),
        F.when(F.col("Label") == "Anomaly", 1).otherwise(0).alias("label"),
        *(c for c in df.columns if c == "label_no"),
    )


# fixed values: the fields of a run's statistics file
RUN_STATS_SCHEMA = (
    "mode string, total_logs long, time_taken_seconds double, avg_time_per_log_ms double, "
    "throughput_logs_per_second double, memory_consumed_mb double, peak_cpu_memory_mb double, "
    "gpu_memory_mb double, normal_count long, abnormal_count long, normal_percentage double, "
    "abnormal_percentage double, model_used string, batch_size long, temperature double, "
    "gpu_available boolean"
)


# fixed values: file names that spell a mix of one kind differently
MIX_SPELLINGS = {"4abn": "4ab", "4nor": "4n"}


def read_run_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row per run; ``mix`` and ``cap`` come from the name of the file, or of
    the folder a Spark job wrote it to, as in ``…_2ab2nmt50_stats.json`` (few-shot)
    or ``…maxToken50_stats.json`` (zero-shot)."""
    df = spark.read.json(
        path, schema=RUN_STATS_SCHEMA, multiLine=True,
        pathGlobFilter="*.json", recursiveFileLookup=True,
    )
    name = F.col("_metadata.file_path")
    few = F.regexp_extract(name, r"_([0-9a-z]+?)mt([0-9]+)_stats\b", 1)
    cap = F.regexp_extract(name, r"(?:mt|maxToken)([0-9]+)_stats\b", 1)
    spelled = F.create_map(*(F.lit(x) for pair in MIX_SPELLINGS.items() for x in pair))
    return df.select(
        F.when(few == "", "zero")
        .otherwise(F.coalesce(F.try_element_at(spelled, few), few))
        .alias("mix"),
        F.nullif(cap, F.lit("")).cast("int").alias("cap"),
        "*",
    )
