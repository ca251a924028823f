import json

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import sampling
from cinderlog.sources import logs, sinks


def test_line_numbers_count_blank_lines_and_go_on_over_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\nthree \xff\xfe x\n")
    (tmp_path / "b.log").write_bytes(b"four\nfive")
    got = [tuple(r) for r in logs.read_log_lines(spark, str(tmp_path)).orderBy("line_id").collect()]
    assert got == [(0, "one"), (1, ""), (2, "three �� x"), (3, "four"), (4, "five")]
    dropped = logs.read_log_lines(spark, str(tmp_path), drop_bad=True).where("line_id = 2").first()
    assert dropped.line == "three  x"


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        df = logs.read_log_lines(spark, str(path))
        assert df.rdd.getNumPartitions() > 10
        wrong = df.where(F.split("line", " ")[1].cast("long") != F.col("line_id")).count()
        assert wrong == 0 and df.count() == 20_000
    finally:
        spark.conf.set(key, before)


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('log_text,label\n"a, ""b""",1\nc,0\n')
    got = [tuple(r) for r in logs.read_labelled_csv(spark, str(tmp_path / "x.csv")).orderBy("id").collect()]
    assert got == [(0, 'a, "b"', 1), (1, "c", 0)]
    (tmp_path / "y.csv").write_text("log_text\na\n")
    with pytest.raises(ValueError, match="label"):
        logs.read_labelled_csv(spark, str(tmp_path / "y.csv"))


def test_examples(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"log": "a", "label": 1}, {"log": "b", "label": 0}]))
    assert {tuple(r) for r in logs.read_examples(spark, str(tmp_path / "e.json")).collect()} == {("a", 1), ("b", 0)}
    with pytest.raises(ValueError):
        logs.read_examples(spark, "examples.txt")


def test_run_stats_names(spark, tmp_path):
    for name in ("run_2ab2nmt50_stats.json", "run_4normt10_stats.json", "zeroX_maxToken75_stats.json"):
        (tmp_path / name).write_text(json.dumps({"total_logs": 5, "normal_count": 2}, indent=2))
    got = {(r.mix, r.cap, r.total_logs) for r in logs.read_run_stats(spark, str(tmp_path)).collect()}
    assert got == {("2ab2n", 50, 5), ("4n", 10, 5), ("zero", 75, 5)}


def test_write_split_once(spark, tmp_path):
    rows = spark.range(50).select(
        F.col("id").alias("line_id"), F.concat(F.lit("l"), "id").alias("line"), (F.col("id") < 10).cast("int").alias("label"))
    split = sampling.normal_only_split(rows, 0.25, "line_id")
    sizes = sinks.write_split(split, str(tmp_path / "out")).first()
    assert (sizes.train_normal, sizes.test_normal, sizes.test_abnormal) == (30, 10, 10)
    sinks.write_split(split.limit(0), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out" / "lines"))
    assert lines.where("split = 'test'").count() == 20 and lines.count() == 50


def test_predictions_in_both_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", x')], "label int, line string")
    sinks.write_predictions(df, str(tmp_path / "j"), "json")
    sinks.write_predictions(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).first().line == 'say "hi", x'
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().line == 'say "hi", x'
    with pytest.raises(ValueError):
        sinks.write_predictions(df, str(tmp_path / "p"), "pickle")


@pytest.mark.parametrize("escape", [True, False])
def test_csv_gives_back_what_it_got(spark, tmp_path, escape):
    values = ["  lead and trail  ", 'two\nlines, "quoted"', "back\\slash\\n\\\\", "a\rb", "\ttab", "plain", "é\u2028x", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, log_text string").withColumn("label", F.lit(1))
    path = str(tmp_path / "c")
    sinks.write_predictions(df, path, "csv", escape_breaks=escape)
    back = logs.read_labelled_csv(spark, path, escaped=escape, multi_line=not escape)
    got = {r.id: (r.log_text, r.label) for r in back.collect()}
    if not escape:  # a carriage return ends a quoted line as a line feed does
        values[3], values[7] = got[3][0], None  # and an empty text is a missing one
    assert got == {i: (v, 1) for i, v in enumerate(values)}


def test_stage_after_a_failed_run(spark, tmp_path):
    path = tmp_path / "s"
    broken = spark.range(4).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception):
        sinks.stage(broken, str(path))
    assert sinks.stage(spark.range(3), str(path)).count() == 3
    assert sinks.stage(spark.range(9), str(path)).count() == 3


def test_metrics_as_csv(spark, tmp_path):
    sinks.write_metrics(spark.createDataFrame([(0.5,)], "f1 double"), str(tmp_path / "m"), fmt="csv", model="a b")
    assert tuple(logs.read_csv(spark, str(tmp_path / "m")).first()) == ("0.5", "a b")


def test_stage_keeps_finished_work(spark, tmp_path):
    path = str(tmp_path / "s")
    assert sinks.stage(spark.range(3), path).count() == 3
    assert sinks.stage(spark.range(9), path).count() == 3


def test_the_line_index_is_kept_and_follows_the_files(spark, tmp_path):
    logs_dir, kept = tmp_path / "logs", str(tmp_path / "index")
    logs_dir.mkdir()
    for name, n in (("a", 5000), ("b", 1), ("c", 3000)):
        (logs_dir / name).write_text("".join(f"{name} {k}\n" for k in range(n)))
    read = lambda: [r.line for r in logs.read_log_lines(spark, str(logs_dir), index=kept).orderBy("line_id").collect()]
    want = [f"a {k}" for k in range(5000)] + ["b 0"] + [f"c {k}" for k in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert read() == want and read() == want
        assert len(list((tmp_path / "index").iterdir())) == 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # other splits, another index
        assert read() == want and len(list((tmp_path / "index").iterdir())) == 2
        (logs_dir / "b").write_text("b 0\nb 1\n")
        assert read() == [*want[:5001], "b 1", *want[5001:]]
        assert len(list((tmp_path / "index").iterdir())) == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stages_redo_missing_and_changed_parts_only(spark, tmp_path):
    files = []
    for k in range(5):
        files.append(str(tmp_path / f"in{k}.txt"))
        (tmp_path / f"in{k}.txt").write_text(f"{k}\n")
    asked = []

    def build(own):
        asked.append([f[-5] for f in own])
        if "boom" in (tmp_path / "in4.txt").read_text() and files[4] in own:
            raise RuntimeError
        return spark.read.text(own)

    def run(settings=None):
        asked.clear()
        out = sinks.stage_parts(spark, files, build, str(tmp_path / "stage"), settings, files_per_part=2)
        return sorted(r.value for r in out.collect()), list(asked)

    (tmp_path / "in4.txt").write_text("boom\n")
    with pytest.raises(RuntimeError):
        run()
    (tmp_path / "in4.txt").write_text("4\n")
    assert run() == (["0", "1", "2", "3", "4"], [["4"]])  # the parts before the failure stand
    assert run() == (["0", "1", "2", "3", "4"], [])
    (tmp_path / "in2.txt").write_text("two\n")
    assert run() == (["0", "1", "3", "4", "two"], [["2", "3"]])
    assert run({"mask": "other"})[1] == [["0", "1"], ["2", "3"], ["4"]]
    rows = spark.read.json(str(tmp_path / "stage" / "manifest")).collect()
    assert sorted((r.part, r.built) for r in rows) == [(0, True), (1, True), (2, True)]


def test_session_texts_are_streamed_to_the_file(spark, tmp_path):
    pieces = [("s1", 0, f"line {k:06d}") for k in range(30_000)] + [("s2", 1, "only one "), ("s0", None, " b "), ("s0", None, "é ")]
    df = spark.createDataFrame(pieces, "session_id string, label int, piece string").repartition(7)
    sinks.write_session_texts(df, str(tmp_path / "texts"))
    got = {r.session_id: (r.label, r.text) for r in sinks.read_session_texts(spark, str(tmp_path / "texts")).collect()}
    assert got == {
        "s1": (0, "- " + " ".join(f"line {k:06d}" for k in range(30_000))), "s2": (1, "only one "), "s0": (None, " b  é "),
    }
    sinks.write_session_texts(df.limit(0), str(tmp_path / "none"))
    assert sinks.read_session_texts(spark, str(tmp_path / "none")).count() == 0


def test_a_stage_with_settings_follows_its_inputs(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\n")
    path = str(tmp_path / "kept")
    run = lambda **settings: [r.value for r in sinks.stage(spark.read.text(str(tmp_path / "in.txt")), path, settings).collect()]
    assert run(test=0.2) == ["a"] and run(test=0.2) == ["a"] and len(list((tmp_path / "kept").iterdir())) == 1
    assert run(test=0.3) == ["a"] and len(list((tmp_path / "kept").iterdir())) == 2
    (tmp_path / "in.txt").write_text("bc\n")
    assert run(test=0.2) == ["bc"]
