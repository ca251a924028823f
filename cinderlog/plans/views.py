"""Inputs of the registered queries, derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.session import materialise, parallelism
from cinderlog.sources.logs import session_labels_of

_written: dict[tuple[str, str, str], DataFrame] = {}


def written(df: DataFrame, sf_dir: str, name: str, key_column: str = "line_id") -> DataFrame:
    """A fixture as a table dealt over all tasks, written once per application: the
    operators then read it as they would a raw log, from a column and not an expression."""
    key = (df.sparkSession.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        tasks = parallelism(df.sparkSession)
        _written[key] = materialise(df.repartition(tasks, key_column), name)
    return _written[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return written(docs, sf_dir, "documents", "doc_id")


def _text(c: Column) -> Column:
    return c.cast("string")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line): one log-shaped line per event, some 20 % abnormal."""
    e = F.col("event_id")
    u = F.col("user_id")
    # from the text of the zone-less time, so that no session zone matters
    ts = F.col("ts").cast("string")
    day, clock = F.substring(ts, 1, 10), F.substring(ts, 12, 8)
    micros = F.rpad(F.substring(ts, 21, 6), 6, "0")
    epoch = (
        F.datediff(F.to_date(day), F.lit("1970-01-01").cast("date")).cast("long") * 86400
        + F.substring(ts, 12, 2).cast("long") * 3600
        + F.substring(ts, 15, 2).cast("long") * 60
        + F.substring(ts, 18, 2).cast("long")
    )
    node = F.concat(
        F.lit("R"), _text(10 + u % 64), F.lit("-M"), _text(e % 2), F.lit("-N"), _text(e % 10),
        F.lit("-C:J"), _text(10 + e % 18), F.lit("-U01"),
    )
    kind = F.col("event_type")
    content = (
        F.when(kind == "view", F.concat(
            F.lit("read block blk_"), _text(100 + u), F.lit(" from 10.0."), _text(u % 256),
            F.lit("."), _text(e % 256), F.lit(":"), _text(5000 + e % 1000)))
        .when(kind == "click", F.concat(
            F.lit("opened /srv/u"), _text(u), F.lit("/f"), _text(e % 7), F.lit(" in "),
            _text(e % 90), F.lit(" ms")))
        .when(kind == "signup", F.concat(
            F.lit("unit u-"), _text(u), F.lit(" joined, word 0x"), _text(1000 + e % 9000),
            F.lit("ab")))
        .when(kind == "purchase", F.concat(
            F.lit("moved blk_"), _text(100 + u), F.lit(" to blk_-"), _text(100 + e % 50),
            F.lit(" ok")))
        .when(e % 3 == 0, F.concat(
            F.lit("gate closed at addr 00"), _text(100000 + e % 1000), F.lit(", halted")))
        .when(e % 3 == 1, F.concat(F.lit("lost peer u-"), _text(u), F.lit(": no answer")))
        .otherwise("halted without cause")
    )
    line = F.concat_ws(
        " ",
        F.when(kind != "error", "-").when(e % 2 == 0, "EVTFAIL").otherwise("EVTSTOP"),
        _text(epoch),
        F.replace(day, F.lit("-"), F.lit(".")),
        node,
        F.concat(day, F.lit("-"), F.replace(clock, F.lit(":"), F.lit(".")), F.lit("."), micros),
        node,
        F.lit("RAS"),
        F.when(e % 3 == 0, "KERNEL").when(e % 3 == 1, "APP").otherwise("MMCS"),
        F.when((kind == "error") | (e % 7 == 0), "FATAL").otherwise("INFO"),
        content,
    )
    lines = table(spark, sf_dir, "events").select(e.alias("line_id"), line.alias("line"))
    return written(lines, sf_dir, "log-lines")


def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, line): the second log family, with accounts, month names and paths."""
    e, u = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("string")
    day, clock = F.substring(ts, 1, 10), F.substring(ts, 12, 8)
    month = F.element_at(
        F.array(*(F.lit(m) for m in (
            "Jan", "Feb", "Mar", "Apr", "May", "Jun",
            "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"))),
        F.substring(ts, 6, 2).cast("int"),
    )
    line = F.concat(
        F.when(F.col("event_type") != "error", "-").otherwise("VAPI"), F.lit(" "),
        _text(1_100_000_000 + e), F.lit(" "), F.replace(day, F.lit("-"), F.lit(".")),
        F.lit(" n"), _text(u), F.lit(" "), month, F.lit(" "),
        _text(F.substring(ts, 9, 2).cast("int")), F.lit(" "), clock,
        F.lit(" u"), _text(u), F.lit("@host-"), _text(e % 9), F.lit(" "),
        F.when(e % 4 == 0, F.concat(F.lit("crond["), _text(e), F.lit("]: run /etc/cron.d/x job")))
        .when(e % 4 == 1, F.concat(F.lit("sshd from 10.1."), _text(u % 256), F.lit(".7:22 key ab"),
                                   _text(10_000_000 + e), F.lit("ff")))
        .when(e % 4 == 2, F.concat(F.lit("mail to bob.x@site.org via lib/a/b"), _text(e % 5)))
        .otherwise(F.concat(F.lit("disk /dev["), _text(e % 8), F.lit("] fault"))),
    )
    lines = table(spark, sf_dir, "events").select(e.alias("line_id"), line.alias("line"))
    return written(lines, sf_dir, "cluster-lines")


def sessions_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines that name a block; purchases name two."""
    return log_lines(spark, sf_dir).where(F.contains("line", F.lit("blk_")))


def session_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(BlockId, Label) of the blocks users name; one number in ten has no label."""
    number = F.col("user_id") + 100
    return (
        table(spark, sf_dir, "events")
        .select(number.alias("n"))
        .distinct()
        .where(F.col("n") % 10 != 3)
        .select(
            F.concat(F.lit("blk_"), _text(F.col("n"))).alias("BlockId"),
            F.when(F.col("n") % 7 == 0, "Anomaly").otherwise("Normal").alias("Label"),
        )
    )


def session_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_labels_of(session_label_table(spark, sf_dir))


def vec_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, tokens): a 64-wide vector as 8 token vectors of 8."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.transform(
            F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)
        ).alias("tokens"),
    )


IN_BANK = "label < 8 AND vec_id % 5 <> 0"


def bank(df: DataFrame) -> DataFrame:
    return df.where(IN_BANK)


def test_side(df: DataFrame) -> DataFrame:
    return df.where(f"NOT ({IN_BANK})")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score, pred, ms): scores with ties and overlapping classes."""
    e = F.col("event_id")
    label = F.when(F.col("event_type") == "error", 1).otherwise(0)
    base = table(spark, sf_dir, "events").select(
        e.alias("id"),
        label.alias("label"),
        (((e * 7919) % 100 + 30 * label) / F.lit(100.0)).alias("score"),
        (F.col("value") * 10).alias("ms"),
    )
    pred = F.when(F.col("id") % 11 == 0, -1).otherwise((F.col("score") >= 0.6).cast("int"))
    return base.withColumn("pred", pred)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, response, line): model replies of every shape the parsers know, each around
    a whole text; ``line`` is that text with blanks at its ends."""
    c, t = F.col("conv_id"), F.col("turn")
    shape, text = (c + t) % 10, F.col("text")
    reply = (
        F.when(shape == 0, "0")
        .when(shape == 1, F.concat(F.lit("1\n"), text))
        .when(shape == 2, F.concat(F.lit("<think>"), text, F.lit("\n0</think> so 1")))
        .when(shape == 3, F.concat(F.lit("<think> not closed 1 "), text))
        .when(shape == 4, F.concat(text, F.lit(" so 1, not 0")))
        .when(shape == 5, F.lit("x10y"))
        .when(shape == 6, F.to_json(F.struct(F.lit("1").alias("Label"), text.alias("line"))))
        .when(shape == 7, F.concat(F.lit("{'Label': '1'} "), text))
        .when(shape == 8, F.lit('{"Label": "1", "Label": "0", "line": "x"}'))
        .otherwise(text)
    )
    padded = F.concat(F.lit("  "), text, F.lit(" \t"))
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("id"), reply.alias("response"), padded.alias("line")
    )


# fixed values: the sweep's example mixes and token caps
MIXES = {"4ab": (4, 0), "3ab1n": (3, 1), "2ab2n": (2, 2), "1ab3n": (1, 3), "4n": (0, 4)}
CAPS = {"few_shot": [10, 50, 75, 100, 512], "zero_shot": [10, 25, 50, 75, 100]}


def configs(spark: SparkSession) -> DataFrame:
    """(mode, mix, cap): the settings of the sweep, 5 x 5 few-shot and 5 zero-shot."""
    few = [("few_shot", m, c) for m in MIXES for c in CAPS["few_shot"]]
    zero = [("zero_shot", "none", c) for c in CAPS["zero_shot"]]
    return spark.createDataFrame(few + zero, "mode string, mix string, cap int")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, mix, cap, label_text, ms): few-shot answers and times per setting."""
    from cinderlog.operators.scoring import experiment_grid

    e = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(e.alias("line_id"), "event_type")
    grid = experiment_grid(lines, configs(spark).where("mode = 'few_shot'").select("mix", "cap"))
    draw = (F.col("line_id") * 7 + F.col("cap") + F.length("mix")) % 13
    return grid.select(
        "line_id",
        "mix",
        "cap",
        F.when(draw < 9, "0").when(draw < 12, "1").otherwise("?").alias("label_text"),
        ((F.col("line_id") % 97 + F.col("cap")) / F.lit(4.0)).alias("ms"),
    )
