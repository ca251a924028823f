"""The registered queries: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions import answers, masks, prompts, vectors
from cinderlog.functions import text as tx
from cinderlog.operators import (
    embedding, metrics, parse, runstats, sampling, scoring, sessions, similarity, templates,
    thresholds,
)
from cinderlog.plans import detection, prompting, streaming, views
from cinderlog.plans import oracles as o
from cinderlog.session import materialise, parallelism, shared_folder
from cinderlog.sources import logs, sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        REGISTRY[name] = (query, sql)
        return query

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label) of every document, null without one. Both sides have unique ids."""
    docs = views.table(spark, sf, "documents").select("doc_id")
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(labels, "doc_id", "left")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, pos, line): the lines of every document."""
    return views.documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).withColumn("pos", F.col("pos").cast("long") + 1)


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_fields(views.log_lines(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return parse.label_lines(views.log_lines(spark, sf))


def records(spark: SparkSession, sf: str) -> DataFrame:
    return parse.usable(parse.preprocess(views.log_lines(spark, sf)))


def examples_of(spark: SparkSession, sf: str, abnormal: int, normal: int) -> DataFrame:
    pool = fields(spark, sf).select("line_id", F.col("log_text").alias("log"), "label")
    return scoring.example_mix(pool, abnormal, normal)


# --- sources and sinks ----------------------------------------------------------


@register("read_log_lines", o.ctes(o.LINES) + "SELECT row_number() OVER (ORDER BY line_id)-1 AS line_id, line FROM log_lines")
def read_log_lines(spark, sf):
    path = shared_folder(spark, "raw")
    views.log_lines(spark, sf).orderBy("line_id").select("line").write.text(path)
    return logs.read_log_lines(spark, path)


@register("read_labelled_csv", o.ctes(*o.FIELDS) + "SELECT row_number() OVER (ORDER BY line_id)-1 AS id, log_text, label FROM fields")
def read_labelled_csv(spark, sf):
    path = shared_folder(spark, "csv")
    ready = fields(spark, sf).orderBy("line_id").select("log_text", "label")
    sinks.write_predictions(ready, path, "csv")
    return logs.read_labelled_csv(spark, path)


@register("read_examples", o.ctes(*o.FIELDS, ("mix", o.mix(2, 2))) + "SELECT log, label FROM mix")
def read_examples(spark, sf):
    path = shared_folder(spark, "examples") + "/examples.csv"
    sinks.write_predictions(examples_of(spark, sf, 2, 2).select("log", "label"), path, "csv")
    return logs.read_examples(spark, path)


@register("read_run_stats", o.ctes(*o.RUN_CTES) + "SELECT mix, cap, total_logs, normal_count, abnormal_count, round(time_taken_seconds,6) AS time_taken_seconds FROM stats UNION ALL SELECT 'zero', cap, sum(total_logs)::BIGINT, sum(normal_count)::BIGINT, sum(abnormal_count)::BIGINT, round(sum(time_taken_seconds),6) FROM stats GROUP BY cap")
def read_run_stats(spark, sf):
    path = shared_folder(spark, "runs")
    stats = runstats.run_stats(views.runs(spark, sf), ms="ms", by=("mix", "cap"))
    name = F.format_string("few_%smt%d_stats", "mix", "cap")
    stats.withColumn("run", name).drop("mix", "cap").write.partitionBy("run").json(path)
    # runs without examples are named by their cap alone
    zero = stats.groupBy("cap").agg(*(F.sum(c).alias(c) for c in ("total_logs", "normal_count", "abnormal_count", "time_taken_seconds")))
    name = F.format_string("zero_prompt_maxToken%d_stats", "cap")
    zero.withColumn("run", name).drop("cap").write.mode("append").partitionBy("run").json(path)
    back = logs.read_run_stats(spark, path)
    return rounded(
        back.select("mix", "cap", "total_logs", "normal_count", "abnormal_count", "time_taken_seconds"),
        "time_taken_seconds",
    )


SPLIT_SIZES = """SELECT sum(CASE WHEN split='train' THEN 1 ELSE 0 END)::BIGINT AS train_normal,
  sum(CASE WHEN split='test' AND label=0 THEN 1 ELSE 0 END)::BIGINT AS test_normal,
  sum(CASE WHEN split='test' AND label=1 THEN 1 ELSE 0 END)::BIGINT AS test_abnormal FROM split"""


def split_of(spark, sf):
    return sampling.normal_only_split(labelled(spark, sf), 0.2, "line_id")


@register("split_sizes", o.ctes(*o.split()) + SPLIT_SIZES)
def split_sizes(spark, sf):
    return sampling.split_sizes(split_of(spark, sf))


@register("write_split", o.ctes(*o.split()) + "SELECT split, line FROM split")
def write_split(spark, sf):
    path = shared_folder(spark, "split")
    sinks.write_split(split_of(spark, sf), path)
    return spark.read.text(f"{path}/lines").select("split", F.col("value").alias("line"))


@register("write_predictions", o.ctes(("answers", o.ANSWERS)) + f"SELECT {o.LAST} AS Label, trim(line,{o.WS}) AS line FROM answers")
def write_predictions(spark, sf):
    path = shared_folder(spark, "predictions")
    out = views.answers(spark, sf).select(
        answers.parse_last(F.col("response")).alias("Label"), tx.strip(F.col("line")).alias("line")
    )
    sinks.write_predictions(out, path)
    return spark.read.schema("Label string, line string").json(path)


@register("write_predictions_csv", o.ctes(("answers", o.ANSWERS)) + "SELECT id::VARCHAR AS id, response, line FROM answers")
def write_predictions_csv(spark, sf):
    path = shared_folder(spark, "predictions")
    sinks.write_predictions(views.answers(spark, sf), path, "csv")
    return logs.read_csv(spark, path, escaped=True)


@register("write_metrics_csv", o.ctes(("scored", o.SCORED), ("c", f"SELECT {o.cells('pred')} FROM scored")) + f"SELECT '42' AS seed, tn::VARCHAR AS tn, fp::VARCHAR AS fp, fn::VARCHAR AS fn, tp::VARCHAR AS tp, {o.rates(6, 'accuracy', 'f1')} FROM c")
def write_metrics_csv(spark, sf):
    path = shared_folder(spark, "metrics")
    found = metrics.binary_metrics(views.scored(spark, sf), pred="pred")
    sinks.write_metrics(found, path, fmt="csv", seed=42)
    back = logs.read_csv(spark, path).select(
        "seed", "tn", "fp", "fn", "tp", F.col("accuracy").cast("double"), F.col("f1").cast("double")
    )
    return rounded(back, "accuracy", "f1")


@register("write_metrics", o.ctes(("scored", o.SCORED), ("c", f"SELECT {o.cells('pred')} FROM scored")) + f"SELECT 42 AS seed, tn, fp, fn, tp, {o.rates(6, 'accuracy', 'precision', 'recall', 'f1')} FROM c")
def write_metrics(spark, sf):
    path = shared_folder(spark, "metrics")
    found = metrics.binary_metrics(views.scored(spark, sf), pred="pred")
    sinks.write_metrics(found, path, seed=42)
    back = spark.read.schema(
        "seed int, tn long, fp long, fn long, tp long, "
        "accuracy double, precision double, recall double, f1 double"
    ).json(path)
    return rounded(back, "accuracy", "precision", "recall", "f1")


@register("stage_store", o.ctes(o.LINES, *o.preprocessed("log_lines")) + "SELECT sentence, label, count(*) AS n FROM records GROUP BY ALL")
def stage_store(spark, sf):
    path = shared_folder(spark, "stage")
    done = records(spark, sf).select("line_id", "label", "sentence")
    sinks.stage(done, path)
    return sinks.stage(done, path).groupBy("sentence", "label").agg(F.count("*").alias("n"))


@register("stage_parts", o.ctes(o.LINES, *o.preprocessed("log_lines")) + "SELECT sentence, label, count(*) AS n FROM records GROUP BY ALL")
def stage_parts(spark, sf):
    """Files of lines preprocessed part by part; the second run finds all parts."""
    path = shared_folder(spark, "stage")

    def build(files):
        return parse.usable(parse.preprocess(spark.read.parquet(*files))).select("line_id", "label", "sentence")

    files = views.log_lines(spark, sf).inputFiles()
    sinks.stage_parts(spark, files, build, path, {"dataset": "bgl"}, files_per_part=4)
    done = sinks.stage_parts(spark, files, build, path, {"dataset": "bgl"}, files_per_part=4)
    return done.groupBy("sentence", "label").agg(F.count("*").alias("n"))


# --- parsing, masks, text ---------------------------------------------------------


@register("label_lines", o.ctes(o.LINES, o.RAW_LABELLED) + "SELECT line_id, label FROM labelled")
def label_lines(spark, sf):
    return labelled(spark, sf).select("line_id", "label")


@register("drop_malformed", o.ctes(("l", o.DOC_LINES), ("t", f"SELECT *, {o.tokens('line')} AS t FROM l")) + "SELECT doc_id, pos, line FROM t WHERE len(t)>=10")
def drop_malformed(spark, sf):
    return parse.drop_malformed(doc_lines(spark, sf))


@register("drop_blank", o.ctes(("l", o.DOC_LINES)) + f"SELECT doc_id, pos, line FROM l WHERE trim(line,{o.WS})<>''")
def drop_blank(spark, sf):
    return parse.drop_malformed(doc_lines(spark, sf), min_tokens=1)


@register("drop_header", o.ctes(o.LINES) + "SELECT line_id, line FROM log_lines WHERE line_id%500<>0")
def drop_header(spark, sf):
    lines = views.log_lines(spark, sf).withColumn(
        "line",
        F.when(F.col("line_id") % 1000 == 0, F.lit(f"  {masks.HEADER_LINE.upper()} "))
        .when(F.col("line_id") % 500 == 0, F.lit(masks.HEADER_LINE))
        .otherwise(F.col("line")),
    )
    return parse.drop_header(lines)


@register("parse_fields", o.ctes(*o.FIELDS) + "SELECT * EXCLUDE (log_text) FROM fields")
def parse_fields(spark, sf):
    return fields(spark, sf).drop("log_text")


@register("format_log_text", o.ctes(*o.FIELDS) + "SELECT line_id, log_text FROM fields")
def format_log_text(spark, sf):
    return fields(spark, sf).select("line_id", "log_text")


@register("extract_ts", o.ctes(o.LINES) + f"""SELECT line_id, strftime(strptime(regexp_extract(line,'{o.STAMP}'),
  '%Y-%m-%d-%H.%M.%S.%f'),'%Y-%m-%d %H:%M:%S') AS ts_second, rpad(regexp_extract(line,'{o.STAMP}')[21:],6,'0')
  AS micros FROM log_lines""")
def extract_ts(spark, sf):
    ts = F.col("ts").cast("string")
    return parse.extract_timestamp(views.log_lines(spark, sf)).select(
        "line_id", F.substring(ts, 1, 19).alias("ts_second"),
        F.rpad(F.substring(ts, 21, 6), 6, "0").alias("micros"),
    )


@register("mask_bgl", o.ctes(o.LINES, *o.mask_bgl("log_lines")) + "SELECT line_id, t AS masked FROM masked")
def mask_bgl(spark, sf):
    return views.log_lines(spark, sf).select(
        "line_id", masks.mask_bgl(F.col("line")).alias("masked")
    )


@register("mask_thunderbird", o.ctes(("lines", o.CLUSTER_LINES)) + f"SELECT line_id, {o.THUNDERBIRD} AS masked FROM lines")
def mask_thunderbird(spark, sf):
    return views.cluster_lines(spark, sf).select(
        "line_id", masks.mask_thunderbird(F.col("line")).alias("masked")
    )


@register("mask_hdfs", o.ctes(o.LINES) + f"SELECT line_id, nullif(regexp_extract(line,'blk_.\\d+'),'') AS block_id, {o.hdfs('line')} AS masked FROM log_lines")
def mask_hdfs(spark, sf):
    line = F.col("line")
    return views.log_lines(spark, sf).select(
        "line_id", masks.first_block_id(line).alias("block_id"), masks.mask_hdfs(line).alias("masked")
    )


@register("normalise_text", f"SELECT doc_id, {o.normalised('text')} AS plain FROM documents")
def normalise_text(spark, sf):
    return views.documents(spark, sf).select(
        "doc_id", tx.normalise(F.col("text")).alias("plain")
    )


@register("preprocess_lines", o.ctes(o.LINES, *o.preprocessed("log_lines")) + "SELECT line_id, label, sentence FROM records")
def preprocess_lines(spark, sf):
    return records(spark, sf).select("line_id", "label", "sentence")


@register("preprocess_thunderbird", o.ctes(
    ("lines", o.CLUSTER_LINES),
    ("m", f"SELECT line_id, {o.THUNDERBIRD} AS t, regexp_extract(line,'\\d{{2,4}}\\.\\d\\d\\.\\d\\d') AS d, regexp_extract(line,'\\d{{1,2}}:\\d\\d:\\d\\d') AS c FROM lines"),
    ("p", f"SELECT *, t[1:2]='- ' AS normal, {o.normalised('CASE WHEN t[1:2]=chr(45)||chr(32) THEN t ELSE substr(t,strpos(t,chr(32))) END')} AS p FROM m"),
) + "SELECT line_id, replace(d,'.','-')||' '||c AS ts, CASE WHEN normal THEN 0 ELSE 1 END AS label, array_to_string(string_split(p,' ')[4:],' ') AS sentence FROM p")
def preprocess_thunderbird(spark, sf):
    done = parse.usable(parse.preprocess(views.cluster_lines(spark, sf), "thunderbird"))
    return done.select("line_id", F.substring(F.col("ts").cast("string"), 1, 19).alias("ts"), "label", "sentence")


@register("preprocess_hdfs", o.ctes(
    o.LINES,
    ("m", f"SELECT line_id, {o.hdfs(f'trim(line,{o.WS})')} AS t, nullif(regexp_extract(line,'blk_.\\d+'),'') AS session_id FROM log_lines"),
    ("p", f"SELECT *, {o.normalised('t')} AS p FROM m WHERE session_id IS NOT NULL"),
) + "SELECT line_id, session_id, CASE WHEN regexp_extract(t,'^\\S+')='-' THEN 0 ELSE 1 END AS label, array_to_string(string_split(p,' ')[2:],' ') AS sentence FROM p")
def preprocess_hdfs(spark, sf):
    done = parse.usable(parse.preprocess(views.log_lines(spark, sf), "hdfs"))
    return done.select("line_id", "session_id", "label", "sentence")


@register("rejected_lines", o.ctes(o.LINES) + "SELECT line_id, 'no_block_id' AS reject FROM log_lines WHERE NOT regexp_matches(line,'blk_.\\d+')")
def rejected_lines(spark, sf):
    done = parse.preprocess(views.log_lines(spark, sf), "hdfs")
    return parse.rejected(done).select("line_id", "reject")


@register("prediction_flags", o.ctes(("scored", o.SCORED)) + "SELECT id, label, pred, pred IN (0,1) AS is_valid_prediction, label=pred AS correct FROM scored")
def prediction_flags(spark, sf):
    return parse.prediction_flags(
        views.scored(spark, sf).select("id", "label", "pred"), pred="pred"
    )


# --- sessions --------------------------------------------------------------------


@register("sessionise", o.ctes(*o.SESSIONS) + "SELECT session_id, line_id, line FROM sessions")
def sessionise(spark, sf):
    return sessions.sessionise(views.sessions_src(spark, sf))


@register("session_sizes", o.ctes(*o.SESSIONS) + "SELECT session_id, count(*) AS n_lines, min(line_id) AS first_line_id FROM sessions GROUP BY ALL")
def session_sizes(spark, sf):
    return sessions.session_sizes(sessions.sessionise(views.sessions_src(spark, sf)))


@register("session_labels", o.ctes(*o.SESSIONS) + "SELECT DISTINCT session_id, label FROM sessions LEFT JOIN slabels USING (session_id)")
def session_labels(spark, sf):
    path = shared_folder(spark, "session-labels")
    sinks.write_predictions(views.session_label_table(spark, sf), path, "csv")
    found = sessions.sessionise(views.sessions_src(spark, sf)).select("session_id").distinct()
    return sessions.session_labels(found, logs.read_session_labels(spark, path))


@register("session_labels_repeated", o.ctes(*o.SESSIONS) + "SELECT DISTINCT session_id, 1-label AS label FROM sessions LEFT JOIN slabels USING (session_id)")
def session_labels_repeated(spark, sf):
    """Every id twice in the file, the second time with the other label: the last counts."""
    path = shared_folder(spark, "session-labels")
    known = views.session_label_table(spark, sf)
    other = known.withColumn("Label", F.when(F.col("Label") == "Anomaly", "Normal").otherwise("Anomaly"))
    both = known.withColumn("n", F.lit(0)).unionByName(other.withColumn("n", F.lit(1)))
    ordered = both.orderBy("n", "BlockId").drop("n").coalesce(1)
    sinks.write_predictions(ordered, path, "csv")
    found = sessions.sessionise(views.sessions_src(spark, sf)).select("session_id").distinct()
    return sessions.session_labels(found, logs.read_session_labels(spark, path))


@register("session_parse", o.ctes(*o.SESSIONS) + "SELECT session_id, line_id, block_id, parsed FROM sparsed")
def session_parse(spark, sf):
    return sessions.session_parse(views.sessions_src(spark, sf))


TEXTS = o.ctes(
    *o.SESSIONS,
    ("g", "SELECT session_id, list(DISTINCT parsed) AS l, arg_min(block_id, line_id) AS b FROM sparsed WHERE block_id IS NOT NULL GROUP BY session_id"),
) + """SELECT session_id, label, CASE WHEN label=0 THEN '- ' ELSE '' END ||
  array_to_string(list_sort(list_distinct(list_append(l,b))),' ') AS text FROM g LEFT JOIN slabels USING (session_id)"""


@register("session_text", TEXTS)
def session_text(spark, sf):
    parsed = sessions.session_parse(views.sessions_src(spark, sf))
    return sessions.session_text(parsed, views.session_label_rows(spark, sf))


@register("session_text_streamed", TEXTS)
def session_text_streamed(spark, sf):
    """No task holds a session: pieces are sorted and become a text in the file."""
    parsed = materialise(sessions.session_parse(views.sessions_src(spark, sf)), "session-lines")
    path = shared_folder(spark, "session-texts")
    sinks.write_session_texts(sessions.session_pieces(parsed, views.session_label_rows(spark, sf)), path)
    return sinks.read_session_texts(spark, path)


# --- templates and joins ------------------------------------------------------------

TEMPLATES = [
    o.LINES, *o.preprocessed("log_lines"),
    ("templates", "SELECT row_number() OVER (ORDER BY sentence)-1 AS template_id, sentence, n FROM (SELECT sentence, count(*) AS n FROM records GROUP BY ALL)"),
]


@register("templates", o.ctes(*TEMPLATES) + "SELECT * FROM templates")
def template_table(spark, sf):
    return templates.templates(records(spark, sf))


@register("templates_of_text", o.ctes(("l", o.DOC_LINES), ("s", f"SELECT {o.normalised('line')} AS sentence FROM l"), ("c", "SELECT sentence, count(*) AS n FROM s GROUP BY ALL")) + "SELECT row_number() OVER (ORDER BY sentence)-1 AS template_id, sentence, n FROM c")
def templates_of_text(spark, sf):
    plain = doc_lines(spark, sf).select(
        F.coalesce(tx.normalise(F.col("line")), F.lit("")).alias("sentence")
    )
    return templates.templates(plain)


@register("template_lookup", o.ctes(*TEMPLATES) + "SELECT line_id, template_id FROM records JOIN templates USING (sentence)")
def template_lookup(spark, sf):
    # masked once, read by both sides
    rows = materialise(records(spark, sf).select("line_id", "sentence"), "records")
    table = materialise(templates.templates(rows), "templates")
    return templates.template_lookup(rows, table, keep=["line_id"], written=True)


@register("score_rows", o.ctes(*TEMPLATES) + "SELECT line_id, (template_id*37)%101/100.0::DOUBLE AS score FROM records JOIN templates USING (sentence)")
def score_rows(spark, sf):
    # masked once, read by both sides
    rows = materialise(records(spark, sf).select("line_id", "sentence"), "records")
    table = materialise(templates.templates(rows), "templates")
    scores = table.select(
        "sentence", ((F.col("template_id") * 37) % 101 / F.lit(100.0)).alias("score")
    )
    counts = table.select("sentence", F.col("n").alias("_n"))
    return templates.score_rows(rows, scores, "sentence", counts, keep=["line_id"], written=True)


@register("only_in_test", o.ctes(*o.DETECT) + "SELECT sentence FROM asked WHERE first NOT IN (SELECT first FROM bank)")
def only_in_test(spark, sf):
    train, test = detection.split_records(views.log_lines(spark, sf))
    bank = detection.embedded(templates.templates(train), None, "bank")
    asked = detection.embedded(templates.templates(test), None, "test")
    return templates.only_in_test(asked, bank, written=True).select("sentence")


@register("only_in_test_rows", o.ctes(*o.DETECT, ("novel", "SELECT sentence FROM asked WHERE first NOT IN (SELECT first FROM bank)")) + "SELECT r.line_id, r.label FROM records r JOIN split s USING (line_id) SEMI JOIN novel USING (sentence) WHERE s.split='test'")
def only_in_test_rows(spark, sf):
    _, test = detection.split_records(views.log_lines(spark, sf))
    return templates.rows_of(
        test.select("line_id", "label", "sentence"), only_in_test(spark, sf), "sentence"
    ).select("line_id", "label")


@register("experiment_grid", o.ctes(("configs", o.CONFIGS)) + "SELECT event_id AS line_id, mode, mix, cap FROM events, configs")
def experiment_grid(spark, sf):
    lines = views.table(spark, sf, "events").select(F.col("event_id").alias("line_id"))
    return scoring.experiment_grid(lines, views.configs(spark))


# --- counts, samples, splits -----------------------------------------------------------


@register("class_counts", o.ctes(o.DOCS) + "SELECT count(*) AS total, sum(label)::BIGINT AS abnormal, sum(1-label)::BIGINT AS normal, round(avg(label::DOUBLE),6) AS abnormal_ratio FROM docs")
def class_counts(spark, sf):
    return rounded(sampling.class_counts(labelled_docs(spark, sf)), "abnormal_ratio")


@register("split_train", o.ctes(*o.split()) + "SELECT line_id FROM split WHERE split='train'")
def split_train(spark, sf):
    return split_of(spark, sf).where("split = 'train'").select("line_id")


@register("split_test", o.ctes(*o.split()) + "SELECT line_id, label FROM split WHERE split='test'")
def split_test(spark, sf):
    return split_of(spark, sf).where("split = 'test'").select("line_id", "label")


@register("presample", o.ctes(o.DOCS, o.docs_ranked(1234)) + "SELECT doc_id, label FROM ranked WHERE rn<=floor(n*0.3::DOUBLE)")
def presample(spark, sf):
    return sampling.presample(labelled_docs(spark, sf), 0.3, "doc_id")


@register("presample_count", o.ctes(o.DOCS, o.docs_ranked(1234)) + """SELECT doc_id, label FROM ranked
  WHERE rn<=floor(50*CASE WHEN label=1 THEN share ELSE 1.0::DOUBLE-share END)""")
def presample_count(spark, sf):
    return sampling.presample(labelled_docs(spark, sf), 50, "doc_id")


@register("stratified_v1", o.ctes(o.DOCS, o.docs_ranked(42), (
    "w", "SELECT *, greatest(1,floor(60*(CASE WHEN label=1 THEN n ELSE total-n END)::DOUBLE/total::DOUBLE)) AS a FROM ranked",
)) + "SELECT doc_id, label FROM w WHERE rn<=CASE WHEN label=1 THEN a ELSE 60-a END")
def stratified_v1(spark, sf):
    return sampling.stratified_sample(labelled_docs(spark, sf), 60, "doc_id")


@register("stratified_v2", o.ctes(o.DOCS, o.docs_ranked(42), (
    "f", "SELECT *, rn<=least(n,greatest(1,round_even(61*(n::DOUBLE/total::DOUBLE),0))) AS first FROM ranked",
), ("r", "SELECT *, row_number() OVER (ORDER BY first DESC, k, doc_id) AS pos FROM f")) + "SELECT doc_id, label FROM r WHERE pos<=61")
def stratified_v2(spark, sf):
    return sampling.stratified_sample_exact(labelled_docs(spark, sf), 61, "doc_id")


@register("train_ratio_bank", o.ctes(*TEMPLATES, ("r", f"SELECT *, row_number() OVER (ORDER BY {o.key(1234, 'line_id')}, line_id) AS rn, count(*) OVER () AS n FROM records WHERE label=0")) + "SELECT DISTINCT sentence FROM r WHERE rn<=floor(n*0.05::DOUBLE)")
def train_ratio_bank(spark, sf):
    # the raw label: then the histogram pass does not need the masked lines
    rows = parse.label_lines(views.log_lines(spark, sf)).where("label = 0").drop("label")
    rows = parse.usable(parse.preprocess(rows, labelled=False)).select("line_id", "sentence")
    return sampling.train_ratio_templates(rows, 0.05, "line_id", "sentence")


@register("preview", o.ctes(o.LINES) + f"SELECT line_id, line FROM log_lines ORDER BY {o.key(42, 'line_id')}, line_id LIMIT 10")
def preview(spark, sf):
    return sampling.preview(views.log_lines(spark, sf), "line_id")


# --- vectors and similarity --------------------------------------------------------------


@register("embed_templates", o.ctes(*TEMPLATES, *o.hash_vectors("templates"), (
    "e", "SELECT template_id, unnest(range(0,len(words)+1)) AS slot, CASE WHEN slot=0 THEN first ELSE words[slot] END AS v FROM embedded",
)) + "SELECT template_id, slot, unnest(range(1,17)) AS dim, round(unnest(v),6) AS value FROM e")
def embed_templates(spark, sf):
    table = templates.templates(records(spark, sf))
    done = embedding.embed_templates(table, embedding.HashEmbedder)
    slots = done.select("template_id", F.posexplode("tokens").alias("slot", "v")).withColumn(
        "slot", F.col("slot").cast("long")
    )
    values = slots.select("template_id", "slot", F.posexplode("v").alias("dim", "value"))
    return values.select(
        "template_id", "slot", (F.col("dim") + 1).cast("long").alias("dim"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


def long_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(vector).alias("dim", "value")).select(
        "vec_id", (F.col("dim") + 1).cast("long").alias("dim"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


@register("pool_first", o.ctes(("vec", o.VEC)) + "SELECT vec_id, unnest(range(1,9)) AS dim, round(unnest(first),6) AS value FROM vec")
def pool_first(spark, sf):
    return long_vector(embedding.pool(views.vec_tokens(spark, sf), "first"), "vector")


@register("pool_mean", o.ctes(("vec", o.VEC)) + "SELECT vec_id, dim, round((tokens[1][dim]+tokens[2][dim]+tokens[3][dim]+tokens[4][dim]+tokens[5][dim]+tokens[6][dim]+tokens[7][dim]+tokens[8][dim])/8,6) AS value FROM (SELECT *, unnest(range(1,9)) AS dim FROM vec)")
def pool_mean(spark, sf):
    return long_vector(embedding.pool(views.vec_tokens(spark, sf), "mean"), "vector")


def vec_sides(spark, sf):
    both = embedding.with_first(views.vec_tokens(spark, sf))
    return views.test_side(both), views.bank(both)


VEC_IDS = {"test_id": "vec_id", "bank_id": "vec_id"}


@register("nearest_normal", o.ctes(*o.VEC_SIDES, ("dist", o.distances())) + "SELECT test_id, round(min(d),6) AS distance FROM dist GROUP BY ALL")
def nearest_normal(spark, sf):
    test, bank = vec_sides(spark, sf)
    return similarity.nearest(test, bank, 1, **VEC_IDS).select(
        "test_id", F.round("distance", 6).alias("distance")
    )


@register("core_set", o.ctes(*o.VEC_SIDES, ("dist", o.distances()), o.CORE) + "SELECT test_id, rank::INT AS rank, bank_id, round(d,6) AS distance FROM core")
def core_set(spark, sf):
    test, bank = vec_sides(spark, sf)
    return rounded(similarity.nearest(test, bank, 5, **VEC_IDS), "distance")


SMALL_BLOCK = 512  # floats; so these tables have several blocks


@register("nearest_pruned", o.ctes(*o.VEC_SIDES, ("dist", o.distances())) + "SELECT test_id, round(min(d),6) AS distance FROM dist GROUP BY ALL")
def nearest_pruned(spark, sf):
    """Blocks that cannot hold the nearest are not read."""
    test, bank = vec_sides(spark, sf)
    return similarity.nearest(test, bank, 1, **VEC_IDS, block_floats=SMALL_BLOCK).select(
        "test_id", F.round("distance", 6).alias("distance")
    )


@register("core_set_pruned", o.ctes(*o.VEC_SIDES, ("dist", o.distances()), o.CORE) + "SELECT test_id, rank::INT AS rank, bank_id, round(d,6) AS distance FROM core")
def core_set_pruned(spark, sf):
    test, bank = vec_sides(spark, sf)
    return rounded(similarity.nearest(test, bank, 5, **VEC_IDS, block_floats=SMALL_BLOCK), "distance")


def _sims(spark, sf, name, **kw):
    test, bank = vec_sides(spark, sf)
    return similarity.maxsim(test, bank, **VEC_IDS, **kw).select(
        "test_id", F.round(name, 6).alias("score")
    )


SIMS = ("sims", o.sims())


@register("maxsim_max", o.ctes(*o.VEC_SIDES, SIMS) + "SELECT test_id, round(max(s),6) AS score FROM sims GROUP BY ALL")
def maxsim_max(spark, sf):
    return _sims(spark, sf, "maxsim_max", mean=False)


@register("maxsim_best", o.ctes(*o.VEC_SIDES, SIMS) + "SELECT test_id, round(max(s),6) AS score FROM sims GROUP BY ALL")
def maxsim_best(spark, sf):
    """Pairs whose upper bound is below the best so far are not compared."""
    test, bank = vec_sides(spark, sf)
    return similarity.maxsim_best(test, bank, **VEC_IDS).select("test_id", F.round("maxsim_max", 6).alias("score"))


UNEVEN = "list_slice(tokens, 1, 1 + CASE WHEN vec_id%50=0 THEN 7 ELSE vec_id%3 END)"


@register("maxsim_uneven", o.ctes(
    *o.VEC_SIDES[:1], ("uneven", f"SELECT * REPLACE ({UNEVEN} AS tokens) FROM vec"),
    ("bank", "SELECT * FROM uneven WHERE in_bank"), ("test", "SELECT * FROM uneven WHERE NOT in_bank"), SIMS,
) + "SELECT test_id, round(max(s),6) AS best, round(avg(s),6) AS mean FROM sims GROUP BY ALL")
def maxsim_uneven(spark, sf):
    """Matrices of one to eight tokens, in blocks cut by measured size."""
    length = F.when(F.col("vec_id") % 50 == 0, 8).otherwise(F.col("vec_id") % 3 + 1).cast("int")
    vec = views.vec_tokens(spark, sf).withColumn("tokens", F.slice("tokens", F.lit(1), length))
    return similarity.maxsim(
        views.test_side(vec), views.bank(vec), **VEC_IDS, block_floats=8 * SMALL_BLOCK
    ).select("test_id", F.round("maxsim_max", 6).alias("best"), F.round("maxsim_mean", 6).alias("mean"))


@register("maxsim_mean", o.ctes(*o.VEC_SIDES, SIMS) + "SELECT test_id, round(avg(s),6) AS score FROM sims GROUP BY ALL")
def maxsim_mean(spark, sf):
    return _sims(spark, sf, "maxsim_mean")


@register("maxsim_dot", o.ctes(*o.VEC_SIDES, ("sims", o.sims(metric="dot"))) + "SELECT test_id, round(max(s),6) AS score FROM sims GROUP BY ALL")
def maxsim_dot(spark, sf):
    return _sims(spark, sf, "maxsim_max", metric="dot", mean=False)


@register("maxsim_cls", o.ctes(*o.VEC_SIDES, ("sims", o.sims(only_first=True))) + "SELECT test_id, round(max(s),6) AS score FROM sims GROUP BY ALL")
def maxsim_cls(spark, sf):
    return _sims(spark, sf, "maxsim_max", first_only=True, mean=False)


@register("maxsim_core_set", o.ctes(*o.VEC_SIDES, ("dist", o.distances()), o.CORE, (
    "s", f"SELECT test_id, {o.sim()} AS s FROM core JOIN test t ON t.vec_id=test_id JOIN bank b ON b.vec_id=bank_id",
)) + "SELECT test_id, round(max(s),6) AS best, round(avg(s),6) AS mean FROM s GROUP BY ALL")
def maxsim_core_set(spark, sf):
    test, bank = vec_sides(spark, sf)
    near = similarity.nearest(test, bank, 5, **VEC_IDS)
    return similarity.maxsim(test, bank, neighbours=near, **VEC_IDS).select(
        "test_id", F.round("maxsim_max", 6).alias("best"), F.round("maxsim_mean", 6).alias("mean")
    )


@register("invert_scores", o.ctes(*o.VEC_SIDES, SIMS, ("m", "SELECT test_id, max(s) AS s FROM sims GROUP BY ALL")) + "SELECT test_id, round((SELECT max(s) FROM m)-s,6) AS score FROM m")
def invert_scores(spark, sf):
    test, bank = vec_sides(spark, sf)
    sims = materialise(similarity.maxsim(test, bank, **VEC_IDS, mean=False), "similarities")
    return rounded(
        thresholds.invert_scores(sims, "maxsim_max").select(
            "test_id", F.col("maxsim_max").alias("score")
        ),
        "score",
    )


# --- thresholds ------------------------------------------------------------------------------

S = ("scored", o.SCORED)
PR_CTES = [S, *o.curve(), ("pr", o.PR.format(x="")), ("best", o.BEST)]
ROC_CTES = [S, *o.curve(), ("roc", o.ROC)]


@register("pr_curve", o.ctes(*PR_CTES) + "SELECT threshold, tp, fp, round(precision,6) AS precision, round(recall,6) AS recall FROM pr")
def pr_curve(spark, sf):
    return rounded(thresholds.pr_curve(views.scored(spark, sf)), "precision", "recall")


@register("best_f1_threshold", o.ctes(*PR_CTES) + "SELECT threshold, round(f1,6) AS f1, round(precision,6) AS precision, round(recall,6) AS recall FROM best ORDER BY best.f1 DESC, threshold LIMIT 1")
def best_f1_threshold(spark, sf):
    return rounded(
        thresholds.best_f1_threshold(views.scored(spark, sf)), "f1", "precision", "recall"
    )


@register("roc_curve", o.ctes(*ROC_CTES) + "SELECT threshold, round(fpr,6) AS fpr, round(tpr,6) AS tpr FROM roc")
def roc_curve(spark, sf):
    return rounded(thresholds.roc_curve(views.scored(spark, sf)), "fpr", "tpr")


@register("youden_threshold", o.ctes(*ROC_CTES) + "SELECT threshold, round(tpr,6) AS sensitivity, round(1-fpr,6) AS specificity, round(tpr-fpr,6) AS j FROM roc ORDER BY tpr-fpr DESC, threshold DESC LIMIT 1")
def youden_threshold(spark, sf):
    return rounded(
        thresholds.youden_threshold(views.scored(spark, sf)), "sensitivity", "specificity", "j"
    )


@register("apply_threshold", o.ctes(*PR_CTES) + "SELECT id, CASE WHEN score>=(SELECT threshold FROM best ORDER BY f1 DESC, threshold LIMIT 1) THEN 1 ELSE 0 END AS prediction FROM scored")
def apply_threshold(spark, sf):
    rows = views.scored(spark, sf)
    return thresholds.apply_threshold(rows, thresholds.best_f1_threshold(rows)).select(
        "id", "prediction"
    )


@register("score_auc", o.ctes(S, *o.curve()) + "SELECT round(sum((neg::DOUBLE/all_neg)*((tp-pos/2)/all_pos)),6) AS auc FROM cum")
def score_auc(spark, sf):
    return rounded(thresholds.score_auc(views.scored(spark, sf)), "auc")


# --- evaluation -----------------------------------------------------------------------------

CELLS = ("c", f"SELECT {o.cells('pred')} FROM scored")


@register("confusion_matrix", o.ctes(S, CELLS) + "SELECT * FROM c")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(views.scored(spark, sf), pred="pred")


@register("binary_metrics", o.ctes(S, CELLS) + f"SELECT tn, fp, fn, tp, {o.rates(6)} FROM c")
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(views.scored(spark, sf), pred="pred"), *o.RATES)


@register("hard_label_auc", o.ctes(S, CELLS) + f"SELECT round({o.RATES['hard_auc']},6) AS auc FROM c")
def hard_label_auc(spark, sf):
    return rounded(metrics.hard_label_auc(views.scored(spark, sf), pred="pred"), "auc")


def _report_sql() -> str:
    two = {s: (o.RATES[s].replace("tp", "@").replace("tn", "tp").replace("@", "tn")
               .replace("fp", "@").replace("fn", "fp").replace("@", "fn"), o.RATES[s])
           for s in ("precision", "recall", "f1")}
    wide = "SELECT tp+fn AS n1, tn+fp AS n0, " + o.RATES["accuracy"] + " AS acc, " + ", ".join(
        f"{a} AS {s}_0, {b} AS {s}_1" for s, (a, b) in two.items()
    ) + " FROM c"
    def line(name, score, support):
        cols = ", ".join(f"round({score(s)},6) AS {s}" for s in two)
        return f"SELECT '{name}' AS row, {cols}, ({support})::BIGINT AS support FROM wide"
    rows = [
        line("normal", lambda s: f"{s}_0", "n0"), line("anomaly", lambda s: f"{s}_1", "n1"),
        line("accuracy", lambda s: "acc", "n0+n1"),
        line("macro avg", lambda s: f"({s}_0+{s}_1)/2", "n0+n1"),
        line("weighted avg", lambda s: f"({s}_0*n0+{s}_1*n1)/(n0+n1)", "n0+n1"),
    ]
    return o.ctes(S, CELLS, ("wide", wide)) + " UNION ALL ".join(rows)


@register("classification_report", _report_sql())
def classification_report(spark, sf):
    return rounded(
        metrics.classification_report(views.scored(spark, sf), pred="pred"),
        "precision", "recall", "f1",
    )


VALID = ("accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate")


@register("valid_only_metrics", o.ctes(S, ("c", f"""SELECT count(*) AS total_samples,
  sum(CASE WHEN pred IN (0,1) THEN 1 ELSE 0 END)::BIGINT AS valid_predictions,
  sum(CASE WHEN pred IN (0,1) THEN 0 ELSE 1 END)::BIGINT AS invalid_predictions,
  sum(label)::BIGINT AS anomaly_count, sum(CASE WHEN pred=1 THEN 1 ELSE 0 END)::BIGINT AS predicted_anomaly_count,
  {o.cells('pred')}, round(avg(ms),2) AS avg_inference_time_ms, round(sum(ms)/1000,2) AS total_inference_time_s
  FROM scored""")) + f"SELECT *, round(invalid_predictions::DOUBLE/total_samples,4) AS invalid_rate, {o.rates(4, *VALID)} FROM c")
def valid_only_metrics(spark, sf):
    return metrics.valid_only_metrics(views.scored(spark, sf), pred="pred", ms="ms")


@register("fallback_metrics", o.ctes(S, ("p", "SELECT label, greatest(pred,0) AS pred, CASE WHEN pred<0 THEN 1 ELSE 0 END AS fb FROM scored"), ("c", f"""SELECT count(*) AS total_samples,
  sum(label)::BIGINT AS anomaly_count, sum(pred)::BIGINT AS predicted_anomaly_count, sum(fb)::BIGINT AS parse_fallback_count,
  {o.cells('pred')} FROM p""")) + f"SELECT *, {o.rates(4, 'accuracy', 'precision', 'recall', 'f1', 'hard_auc')} FROM c")
def fallback_metrics(spark, sf):
    rows = views.scored(spark, sf).select(
        "label", F.greatest("pred", F.lit(0)).alias("pred"),
        (F.col("pred") < 0).cast("int").alias("parse_fallback"),
    )
    return metrics.fallback_metrics(rows, pred="pred")


METHODS = [
    *o.VEC_SIDES, ("dist", o.distances()), SIMS,
    ("agg", "SELECT test_id, max(s) AS mx, avg(s) AS mn FROM sims GROUP BY ALL"),
    ("scores", """SELECT 'knn' AS method, test_id, round(min(d),6) AS score FROM dist GROUP BY ALL
      UNION ALL SELECT 'maxsim_max', test_id, round((SELECT max(mx) FROM agg)-mx,6) FROM agg
      UNION ALL SELECT 'maxsim_mean', test_id, round((SELECT max(mn) FROM agg)-mn,6) FROM agg"""),
    ("scored", "SELECT s.*, CASE WHEN t.label>=8 THEN 1 ELSE 0 END AS label FROM scores s JOIN test t ON t.vec_id=s.test_id"),
    *o.curve(extra="method, "), ("pr", o.PR.format(x="method, ")), ("best", o.BEST),
    ("cut", "SELECT * FROM (SELECT method, threshold, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, threshold) AS r FROM best) WHERE r=1"),
    ("judged", "SELECT s.*, CASE WHEN score>=threshold THEN 1 ELSE 0 END AS prediction FROM scored s JOIN cut USING (method)"),
    ("c", f"SELECT method, {o.cells('prediction')} FROM judged GROUP BY ALL"),
]


@register("method_comparison", o.ctes(*METHODS) + f"SELECT method, tn, fp, fn, tp, {o.rates(6)} FROM c")
def method_comparison(spark, sf):
    test, bank = vec_sides(spark, sf)
    near = similarity.nearest(test, bank, 1, **VEC_IDS).select(
        "test_id", F.col("distance").alias("score")
    )
    sims = materialise(similarity.maxsim(test, bank, **VEC_IDS), "similarities")
    pairs = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in ("maxsim_max", "maxsim_mean")))
    inverted = thresholds.invert_scores(sims.select("test_id", F.inline(pairs)), by=("method",))
    rows = near.withColumn("method", F.lit("knn")).unionByName(inverted)
    labels = test.select(
        F.col("vec_id").alias("test_id"), (F.col("label") >= 8).cast("int").alias("label")
    )
    rows = rows.join(labels, "test_id").select(
        "method", "test_id", "label", F.round("score", 6).alias("score")
    )
    judged = detection.decide(materialise(rows, "scores"))
    return rounded(metrics.method_comparison(judged), *o.RATES)


@register("detect_anomalies", o.ctes(
    *o.DETECT,
    ("weighted", "SELECT score, label, n FROM near JOIN test USING (sentence)"),
    ("per_score", """SELECT score, coalesce(sum(CASE WHEN label=1 THEN n END),0)::BIGINT AS pos,
      coalesce(sum(CASE WHEN label=0 THEN n END),0)::BIGINT AS neg FROM weighted GROUP BY ALL"""),
    ("cum", "SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos FROM per_score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"),
    ("pr", o.PR.format(x="")), ("best", o.BEST),
    ("judged", "SELECT label, n, CASE WHEN score>=(SELECT threshold FROM best ORDER BY f1 DESC, threshold LIMIT 1) THEN 1 ELSE 0 END AS prediction FROM weighted"),
    ("c", f"SELECT {o.cells('prediction', 'n')} FROM judged"),
) + f"SELECT tn, fp, fn, tp, {o.rates(6)} FROM c")
def detect_anomalies(spark, sf):
    found = detection.nearest_normal_report(views.log_lines(spark, sf))
    return rounded(found.drop("method"), *o.RATES)


def _three(name: str) -> str:
    return f"SELECT method, tn, fp, fn, tp, {o.rates(6)} FROM c"


LINE_RECORDS = [*o.split(), *o.preprocessed("log_lines"), *o.SPLIT_COUNTS]


@register("detect_three_methods", o.methods_report(LINE_RECORDS, detection.METHODS) + _three("lines"))
def detect_three_methods(spark, sf):
    return rounded(detection.nearest_normal_report(views.log_lines(spark, sf), methods=detection.METHODS), *o.RATES)


def _detected(spark, sf, **options):
    found = detection.nearest_normal_report(views.log_lines(spark, sf), methods=detection.METHODS, **options)
    return rounded(found, *o.RATES)


@register("detect_roc", o.methods_report(LINE_RECORDS, detection.METHODS, search="roc") + _three("lines"))
def detect_roc(spark, sf):
    return _detected(spark, sf, search="roc")


@register("detect_core_set", o.methods_report(LINE_RECORDS, detection.METHODS, core=0.3) + _three("lines"))
def detect_core_set(spark, sf):
    return _detected(spark, sf, core_set=0.3)


@register("detect_first_token", o.methods_report(LINE_RECORDS, detection.METHODS, first_only=True) + _three("lines"))
def detect_first_token(spark, sf):
    return _detected(spark, sf, first_only=True)


@register("detect_novel_only", o.methods_report(LINE_RECORDS, detection.METHODS, novel=True) + _three("lines"))
def detect_novel_only(spark, sf):
    return _detected(spark, sf, novel_only=True)


RATIO_RECORDS = [*LINE_RECORDS, ("all_train", f"""SELECT sentence, row_number() OVER (ORDER BY {o.key(1234, 'line_id')}, line_id) AS rn,
  count(*) OVER () AS n FROM records JOIN split USING (line_id) WHERE split='train'"""),
    ("few", "SELECT DISTINCT sentence FROM all_train WHERE rn<=floor(n*0.01::DOUBLE)")]


@register("detect_train_ratio", o.methods_report(RATIO_RECORDS, detection.METHODS).replace("SEMI JOIN train USING", "SEMI JOIN few USING") + _three("lines"))
def detect_train_ratio(spark, sf):
    return _detected(spark, sf, train_ratio=0.01)


@register("detect_thunderbird", o.methods_report(o.THUNDERBIRD_RECORDS, detection.METHODS) + _three("lines"))
def detect_thunderbird(spark, sf):
    return rounded(
        detection.nearest_normal_report(views.cluster_lines(spark, sf), dataset="thunderbird", methods=detection.METHODS),
        *o.RATES,
    )


@register("detect_hdfs_sessions", o.methods_report(o.SESSION_RECORDS, detection.METHODS) + _three("sessions"))
def detect_hdfs_sessions(spark, sf):
    train, test = detection.split_sessions(
        views.sessions_src(spark, sf), views.session_label_rows(spark, sf)
    )
    return rounded(detection.detection_report(train, test, methods=detection.METHODS), *o.RATES)


@register("predict_lines", o.methods_report(LINE_RECORDS, ("knn",)) + "SELECT r.line_id, j.prediction FROM records r JOIN split s USING (line_id) JOIN (SELECT DISTINCT sentence, prediction FROM judged) j USING (sentence) WHERE s.split='test'")
def predict_lines(spark, sf):
    train, test = detection.split_records(views.log_lines(spark, sf))
    test = materialise(test.select("line_id", "label", "sentence"), "test")
    counts = materialise(detection.counted(test), "test-counts")
    scores = detection.template_scores(train, counts, methods=("knn",))
    cut = thresholds.best_f1_threshold(scores.join(counts, "sentence"), weight="n")
    return detection.predict_lines(test, counts, scores, cut).select("line_id", "prediction")


@register("judge_stream", o.methods_report(LINE_RECORDS, ("knn",)) + "SELECT r.line_id, j.prediction FROM records r JOIN split s USING (line_id) JOIN (SELECT DISTINCT sentence, prediction FROM judged) j USING (sentence) WHERE s.split='test'")
def judge_stream(spark, sf):
    """The lines of ``predict_lines``, read as a stream of files."""
    split = detection.split_lines(views.log_lines(spark, sf))
    train, test = detection.merged_records(split)
    counts = materialise(detection.counted(test, "n"), "test-counts")
    scores = detection.template_scores(train, counts, methods=("knn",), weight="n").select("sentence", "score")
    cut = thresholds.best_f1_threshold(scores.join(counts, "sentence"), weight="n").first()["threshold"]
    folder = shared_folder(spark, "stream")
    split.where("split = 'test'").select("line_id", "line").write.parquet(f"{folder}/lines")
    # a file is a task, so a trigger reads enough of them for every core
    lines = streaming.line_stream(spark, f"{folder}/lines", files=parallelism(spark))
    judged = streaming.judge_stream(lines, scores, cut)
    streaming.run_available(judged, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("line_id", "prediction")


# --- prompts and answers ---------------------------------------------------------------------


@register("zero_shot_prompt", o.ctes(*o.FIELDS) + f"SELECT line_id, {o.zero_shot('strict', 'log_text')} AS prompt FROM fields")
def zero_shot_prompt(spark, sf):
    return fields(spark, sf).select(
        "line_id", prompts.zero_shot_prompt(F.col("log_text")).alias("prompt")
    )


@register("zero_shot_styles", o.ctes(*o.FIELDS) + " UNION ALL ".join(
    f"SELECT line_id, '{s}' AS style, {o.zero_shot(s, 'log_text')} AS prompt FROM fields" for s in prompts.STYLES
))
def zero_shot_styles(spark, sf):
    styles = F.array(*(
        F.struct(F.lit(s).alias("style"), prompts.zero_shot_prompt(F.col("log_text"), s).alias("prompt"))
        for s in prompts.STYLES
    ))
    return fields(spark, sf).select("line_id", F.inline(styles))


@register("few_shot_prompt", o.ctes(*o.FIELDS, ("mix", o.mix(2, 3)), ("b", o.block("strict"))) + f"SELECT line_id, {o.few_shot('strict', 'log_text', 'block')} AS prompt FROM fields, b")
def few_shot_prompt(spark, sf):
    block = scoring.folded(examples_of(spark, sf, 2, 3), "strict")
    return fields(spark, sf).withColumn("_block", block.scalar()).select(
        "line_id", prompts.few_shot_prompt(F.col("log_text"), F.col("_block")).alias("prompt")
    )


@register("example_mix", o.ctes(*o.FIELDS) + " UNION ALL ".join(
    f"SELECT '{name}' AS mix, line_id, log, label FROM ({o.mix(a, n)})" for name, (a, n) in views.MIXES.items()
))
def example_mix(spark, sf):
    out = None
    for name, (abnormal, normal) in views.MIXES.items():
        one = examples_of(spark, sf, abnormal, normal).withColumn("mix", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("mix", "line_id", "log", "label")


@register("keyword_score", o.ctes(*o.FIELDS) + f"SELECT line_id, CASE WHEN regexp_matches(log_text,'{o.ALARM}') THEN '1' ELSE '0' END AS response FROM fields")
def keyword_score(spark, sf):
    return fields(spark, sf).select(
        "line_id", scoring.keyword_score(F.col("log_text")).alias("response")
    )


class Refusing(scoring.KeywordScorer):
    """Fails on prompts about some units, as a model may."""

    def __call__(self, prompts):
        if any("u-13:" in p for p in prompts):
            raise ValueError("refused")
        return super().__call__(prompts)


class Digest:
    """Answers from every character of the prompt and from its cap, so that equal
    answers mean equal prompts."""

    def __init__(self, cap: int):
        self.cap = cap

    def __call__(self, prompts):
        marks = (hashlib.md5(f"{self.cap}|{p}".encode()).hexdigest() for p in prompts)
        return ["1" if m[0] in "01234567" else "0" for m in marks]


@register("batch_score", o.ctes(*o.FIELDS) + f"SELECT line_id, label, CASE WHEN NOT contains(log_text,'u-13:') AND regexp_matches(log_text,'{o.ALARM}') THEN 1 ELSE 0 END AS prediction, true AS timed, NOT contains(log_text,'u-13:') AS no_error FROM fields")
def batch_score(spark, sf):
    out = prompting.judged(fields(spark, sf), Refusing)
    return out.select(
        "line_id", "label", "prediction",
        (F.col("inference_time_ms") >= 0).alias("timed"), F.col("error").isNull().alias("no_error"),
    )


ALL_SETTINGS = ("m", o.CONFIGS)
SWEPT = [*o.FIELDS, ALL_SETTINGS, ("lines", f"SELECT line_id, {o.leading('line', 1)} AS text FROM log_lines")]


def _counts(flag: str) -> str:
    return f"""count(*) AS total_logs, sum(CASE WHEN {flag} THEN 0 ELSE 1 END)::BIGINT AS normal_count,
  sum(CASE WHEN {flag} THEN 1 ELSE 0 END)::BIGINT AS abnormal_count"""


def _sweep(spark, sf, scorer):
    known = fields(spark, sf)
    replied = prompting.sweep(
        prompting.sweep_lines(views.log_lines(spark, sf)),
        known.select("line_id", F.col("log_text").alias("log"), "label"),
        views.MIXES, views.CAPS["few_shot"], scorer, zero_caps=views.CAPS["zero_shot"],
    )
    return prompting.sweep_stats(replied).select(
        "mode", "mix", "cap", "total_logs", "normal_count", "abnormal_count"
    )


@register("prompt_sweep", o.ctes(*SWEPT) + f"""SELECT mode, mix, cap, {_counts(f"regexp_matches(text,'{o.ALARM}')")}
  FROM lines, m GROUP BY ALL""")
def prompt_sweep(spark, sf):
    return _sweep(spark, sf, scoring.KeywordScorer)


MIX_BLOCKS = [(f"mix_{m}", o.mix(a, n)) for m, (a, n) in views.MIXES.items()]
BLOCKS = ("blocks", " UNION ALL ".join(
    f"SELECT '{m}' AS mix, block FROM ({o.block('rules').replace('FROM mix', f'FROM mix_{m}')})" for m in views.MIXES
))


@register("sweep_prompts", o.ctes(*SWEPT, *MIX_BLOCKS, BLOCKS, ("asked", f"""SELECT mode, mix, cap,
  CASE WHEN mode='few_shot' THEN {o.few_shot('rules', 'text', 'block')} ELSE {o.zero_shot('json', 'text')} END AS prompt
  FROM lines, m LEFT JOIN blocks USING (mix)""")) + f"""SELECT mode, mix, cap,
  {_counts("md5(cap||'|'||prompt)[1] IN ('0','1','2','3','4','5','6','7')")} FROM asked GROUP BY ALL""")
def sweep_prompts(spark, sf):
    """The same settings with a scorer that depends on every character of a prompt."""
    return _sweep(spark, sf, Digest)


PROMPTED = [*o.FIELDS,
    ("ranked", f"""SELECT *, {o.key(42, 'line_id')} AS k, row_number() OVER (PARTITION BY label ORDER BY
      {o.key(42, 'line_id')}, line_id) AS rn, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM fields"""),
    ("f", "SELECT *, rn<=least(n,greatest(1,round_even(200*(n::DOUBLE/total::DOUBLE),0))) AS first FROM ranked"),
    ("r", "SELECT *, row_number() OVER (ORDER BY first DESC, k, line_id) AS pos FROM f"),
    ("judged", f"SELECT label, CASE WHEN regexp_matches(log_text,'{o.ALARM}') THEN 1 ELSE 0 END AS pred FROM r WHERE pos<=200"),
    ("c", f"SELECT count(*) AS total_samples, sum(label)::BIGINT AS anomaly_count, sum(pred)::BIGINT AS predicted_anomaly_count, {o.cells('pred')} FROM judged"),
    ("modes", "SELECT * FROM (VALUES ('zero_shot'),('few_shot')) v(mode)"),
]


@register("prompted_report", o.ctes(*PROMPTED) + f"""SELECT mode, c.*, total_samples AS valid_predictions, 0::BIGINT AS invalid_predictions,
  0::BIGINT AS parse_fallback_count, {o.rates(4, 'accuracy', 'precision', 'recall', 'f1')},
  round({o.RATES['accuracy']},4) AS all_accuracy, round({o.RATES['f1']},4) AS all_f1 FROM c, modes""")
def prompted_report(spark, sf):
    known = fields(spark, sf)
    examples = examples_of(spark, sf, 2, 2)
    judged = prompting.benchmark(known, scoring.KeywordScorer, 200, examples)
    return prompting.benchmark_report(judged).select(
        "mode", "total_samples", "anomaly_count", "predicted_anomaly_count", "tn", "fp", "fn", "tp",
        "valid_predictions", "invalid_predictions", "parse_fallback_count",
        "accuracy", "precision", "recall", "f1", "all_accuracy", "all_f1",
    )


ANS = ("answers", o.ANSWERS)


def _answers(spark, sf, **columns):
    return views.answers(spark, sf).select("id", *(c.alias(n) for n, c in columns.items()))


R = "response"


@register("strip_reasoning", o.ctes(ANS) + f"SELECT id, {o.BARE} AS bare FROM answers")
def strip_reasoning(spark, sf):
    return _answers(spark, sf, bare=answers.strip_reasoning(F.col(R)))


@register("parse_strict", o.ctes(ANS) + f"SELECT id, {o.STRICT} AS prediction FROM answers")
def parse_strict(spark, sf):
    return _answers(spark, sf, prediction=answers.parse_strict(F.col(R)))


@register("parse_first", o.ctes(ANS) + f"SELECT id, {o.FIRST} AS prediction FROM answers")
def parse_first(spark, sf):
    return _answers(spark, sf, prediction=answers.parse_first(F.col(R)))


@register("parse_first_flagged", o.ctes(ANS) + f"SELECT id, {o.FIRST} AS prediction, {o.FALLBACK} AS parse_fallback FROM answers")
def parse_first_flagged(spark, sf):
    return _answers(
        spark, sf, prediction=answers.parse_first(F.col(R)),
        parse_fallback=answers.used_fallback(F.col(R)),
    )


@register("parse_last", o.ctes(ANS) + f"SELECT id, {o.LAST} AS label_text FROM answers")
def parse_last(spark, sf):
    return _answers(spark, sf, label_text=answers.parse_last(F.col(R)))


@register("parse_json_label", o.ctes(ANS, ("f", f"SELECT *, {o.OBJECT} AS obj FROM answers")) + f"""SELECT id,
  CASE WHEN contains(response,'"Label": "0"') THEN '0' WHEN obj IS NOT NULL AND json_valid(obj) THEN json_extract_string(obj,'$.Label')
    WHEN contains(response,'0') THEN '0' ELSE '1' END AS label_text,
  CASE WHEN obj IS NOT NULL AND json_valid(obj) THEN json_extract_string(obj,'$.line') ELSE trim(line,{o.WS}) END AS line FROM f""")
def parse_json_label(spark, sf):
    both = answers.parse_json_label(F.col(R), F.col("line"))
    return views.answers(spark, sf).select("id", both.alias("x")).select(
        "id", F.col("x.label").alias("label_text"), F.col("x.line").alias("line")
    )


# --- run statistics ------------------------------------------------------------------------------


@register("latency_summary", o.ctes(S) + "SELECT count(*) AS rows, round(avg(ms),2) AS avg_inference_time_ms, round(sum(ms)/1000,2) AS total_inference_time_s FROM scored")
def latency_summary(spark, sf):
    return metrics.latency_summary(views.scored(spark, sf), "ms")


RATES = (
    "time_taken_seconds", "avg_time_per_log_ms", "throughput_logs_per_second",
    "normal_percentage", "abnormal_percentage",
)


def stats_of(spark, sf):
    return rounded(
        runstats.run_stats(views.runs(spark, sf), ms="ms", by=("mix", "cap")), *RATES
    )


@register("run_stats", o.ctes(*o.RUN_CTES) + "SELECT * FROM full_stats")
def run_stats(spark, sf):
    return stats_of(spark, sf)


@register("latency_percentiles", o.ctes(S, ("p", "SELECT quantile_cont(ms,0.5) AS p50, quantile_cont(ms,0.95) AS p95, quantile_cont(ms,0.99) AS p99 FROM scored")) + "SELECT " + ", ".join(f"round({q},6) AS {q}_ms, round(1000/{q},6) AS {q}_logs_per_second" for q in ("p50", "p95", "p99")) + " FROM p")
def latency_percentiles(spark, sf):
    found = runstats.latency_percentiles(views.scored(spark, sf), "ms")
    return rounded(found, *found.columns)


@register("config_pivot", o.ctes(*o.RUN_CTES) + "SELECT mix, " + ", ".join(f"max(CASE WHEN cap={c} THEN throughput_logs_per_second END) AS cap_{c}" for c in views.CAPS["few_shot"]) + " FROM full_stats GROUP BY mix")
def config_pivot(spark, sf):
    return runstats.config_pivot(
        stats_of(spark, sf), "throughput_logs_per_second", views.CAPS["few_shot"]
    )


BETTER = {"throughput_logs_per_second": True, "avg_time_per_log_ms": False, "abnormal_count": True}


@register("best_config", o.ctes(*o.RUN_CTES) + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS metric, mix, cap, {m}::DOUBLE AS value FROM full_stats ORDER BY {m} {'DESC' if up else 'ASC'}, mix, cap LIMIT 1)"
    for m, up in BETTER.items()
))
def best_config(spark, sf):
    return runstats.best_config(stats_of(spark, sf), BETTER)
