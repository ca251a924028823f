import pytest
from pyspark.sql import functions as F

from cinderlog.operators import embedding, metrics, scoring, thresholds
from cinderlog.plans import detection, prompting, streaming, views
from cinderlog.plans.queries import fields

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("split"))
    return detection.split_records(views.log_lines(spark, SF), folder=folder)


@pytest.mark.parametrize("core_set", [0, 0.25])
def test_three_methods_and_their_line_predictions(spark, split, core_set):
    train, test = split
    counts = detection.materialise(detection.counted(test))
    scores = detection.template_scores(train, counts, embedding.HashEmbedder, core_set=core_set)
    report = {r.method: r for r in detection.evaluate(counts, scores).collect()}
    assert set(report) == {"knn", "maxsim_max", "maxsim_mean"}
    rows = test.count()
    assert all(r.tn + r.fp + r.fn + r.tp == rows for r in report.values())
    one = scores.where("method = 'maxsim_max'")
    cut = thresholds.best_f1_threshold(one.join(counts, "sentence"), weight="n")
    lines = detection.predict_lines(test, counts, one, cut)
    found = metrics.confusion_matrix(lines).first()
    expected = report["maxsim_max"]
    assert tuple(found) == (expected.tn, expected.fp, expected.fn, expected.tp)
    assert lines.select("line_id").distinct().count() == rows


def test_novel_templates_only(spark, split):
    train, test = split
    counts = detection.materialise(detection.counted(test))
    scores = detection.template_scores(train, counts, methods=("knn",), novel_only=True)
    known = {r.sentence for r in train.select("sentence").distinct().collect()}
    got = {r.sentence: r.score for r in scores.collect()}
    assert got and not known & set(got) and min(got.values()) > 0
    full = detection.template_scores(train, counts, methods=("knn",))
    assert {r.sentence for r in full.where("score > 0").collect()} == set(got)


def test_a_stream_equals_the_batch_and_goes_on_where_it_was(spark, split, tmp_path):
    lines = detection.materialise(views.log_lines(spark, SF))
    batch = detection.parse.usable(detection.parse.preprocess(lines)).select("line_id", "label", "sentence")
    sentences = sorted(r.sentence for r in batch.select("sentence").distinct().collect())
    known = sentences[: len(sentences) // 2]
    scores = spark.createDataFrame([(x, k / 10) for k, x in enumerate(known)], "sentence string, score double")
    want = {r.line_id: (known.index(r.sentence) / 10 if r.sentence in known else None) for r in batch.collect()}

    def run(part):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.judge_stream(streaming.line_stream(spark, str(tmp_path / "in"), files=1), scores, 0.35)
        streaming.run_available(stream, str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out" / "rows")).collect()

    first = run(lines.where("line_id % 3 = 0"))
    assert {r.line_id for r in first} == {i for i in want if i % 3 == 0}
    both = run(lines.where("line_id % 3 > 0"))
    assert len(both) == len(want)
    for r in both:
        score = want[r.line_id]
        assert r.score == score and r.novel == (score is None)
        assert r.prediction == (None if score is None else int(score >= 0.35))


def test_roc_search(spark, split):
    train, test = split
    report = detection.nearest_normal_report(views.log_lines(spark, SF), search="roc").first()
    assert report.recall == 1.0


def test_few_shot_run(spark):
    records = fields(spark, SF)
    pool = records.select("line_id", F.col("log_text").alias("log"), "label")
    examples = scoring.example_mix(pool, 1, 2)
    out = prompting.judged(records, scoring.KeywordScorer, examples, style="short", parser="first")
    row = prompting.report(out).first()
    assert row.total_samples == records.count() == row.valid_predictions
    assert row.avg_inference_time_ms >= 0


class Capped:
    """A scorer whose reply depends on the token cap it was made with."""

    def __init__(self, cap):
        self.cap = cap

    def __call__(self, prompts):
        return ["1" if self.cap > 20 else "0"] * len(prompts)


def test_sweep_makes_a_scorer_per_cap(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    raw = [(i, f"- line {i % 3}") for i in range(9)] + [(9, "  ")]
    lines = prompting.sweep_lines(spark.createDataFrame(raw, "line_id long, line string"))
    assert {r.text for r in lines.collect()} == {"line 0", "line 1", "line 2"}
    pool = spark.createDataFrame(
        [(i, f"log {i}", i % 2) for i in range(8)], "line_id long, log string, label int"
    )
    out = prompting.sweep(lines, pool, {"2ab2n": (2, 2), "4n": (0, 4)}, [10, 50], Capped)
    stats = {(r.mix, r.cap): r for r in prompting.sweep_stats(out).collect()}
    assert set(stats) == {(m, c) for m in ("2ab2n", "4n") for c in (10, 50)}
    zero = prompting.sweep(lines, pool, {"4n": (0, 4)}, [50], Capped, zero_caps=[75])
    modes = {(r.mode, r.mix, r.cap): r.abnormal_count for r in prompting.sweep_stats(zero).collect()}
    assert modes == {("few_shot", "4n", 50): 9, ("zero_shot", "none", 75): 9}
    assert all(r.total_logs == 9 for r in stats.values())
    assert stats["4n", 50].abnormal_count == 9 and stats["4n", 10].normal_count == 9


class Wordy(Capped):
    """Answers of several shapes."""

    def __call__(self, prompts):
        return ["1" if self.cap > 20 else ' {"Label": "0", "line": "1"} so 1' for _ in prompts]


def test_sweep_reads_a_digit_as_it_is_and_parses_the_rest(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(5)], "line_id long, text string")
    pool = spark.createDataFrame([(i, f"log {i}", i % 2) for i in range(4)], "line_id long, log string, label int")
    out = prompting.sweep(lines, pool, {"1ab1n": (1, 1)}, [10, 50], Wordy, zero_caps=[10, 50])
    found = {(r.mode, r.cap, r.response, r.label_text) for r in out.collect()}
    wordy = ' {"Label": "0", "line": "1"} so 1'
    assert found == {
        ("few_shot", 10, wordy, "1"), ("few_shot", 50, "1", "1"),
        ("zero_shot", 10, wordy, "0"), ("zero_shot", 50, "1", "1"),
    }


def test_options_of_the_report(spark, split):
    train, test = split
    report = detection.detection_report(
        train, test, methods=detection.METHODS, train_ratio=0.5, first_only=True, core_set=0.5, timed=True
    ).collect()
    assert {r.method for r in report} == set(detection.METHODS)
    assert all(r.score_s > 0 and r.avg_response_s > 0 for r in report)


def test_other_datasets(spark):
    report = detection.nearest_normal_report(views.cluster_lines(spark, SF), dataset="thunderbird").first()
    assert report.tp + report.fn > 0
    train, test = detection.split_sessions(views.sessions_src(spark, SF), views.session_label_rows(spark, SF))
    assert train.count() and set(r.label for r in test.select("label").distinct().collect()) == {0, 1}


def test_lines_of_one_shape_are_masked_once(spark):
    """Digits alone never decide a sentence or a label, but the 0 of 0x and real dates do."""
    stamp = "2024-01-05-17.11.13.310352"
    bodies = [
        "addr 0x2603ab", "addr 1x2603ab", "addr 0X9f 0x", "00x17g", "10x1z", "blk_12", "blk_-7 of 10.0.4.120:52", "at u-7: 1",
        "a/b 7/x /1/y", "A" * 20 + "12345678", "a" * 47 + "0", "a" * 47 + "7", "12345678 1234567 ab012345", "é٣ 4:x u٤-5b", "x 5:b",
        "<7> ΑΣ1 ΑΣ9", "Jan 5 17:11:13 u7@host-3 crond[55]: x", "7.1.2 2024.1.2 99.99.9", "- 0 -", "",
    ]
    lines = [f"{tag} 17044{k}4673 2024.01.0{k} R7{k}-M1 {stamp} R{k} {b}" for tag in ("-", "EVT0", "-1") for k in (0, 4) for b in bodies]
    lines += [f"- 1 2 3 {t} x" for t in ("2024-13-05-17.11.13.3", "2024-12-05-17.11.13.3", "24-1-5-1.1.1.1", "")]
    lines += [detection.parse.masks.HEADER_LINE.title(), " \t", "- x", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    split = rows.withColumn("split", F.when(F.col("line_id") % 5 == 0, "train").otherwise("test"))
    for dataset in ("bgl", "thunderbird", "hdfs"):
        train, test = detection.merged_records(split, dataset)
        plain = [
            detection.parse.usable(detection.parse.preprocess(split.where(F.col("split") == name), dataset, labelled))
            for name, labelled in (("train", False), ("test", True))
        ]
        want = {tuple(r) for r in detection.counted(plain[1]).collect()}
        assert len(want) > 1 and {tuple(r) for r in detection.counted(test, "n").collect()} == want
        bank, known = (
            {(r.sentence, r.n) for r in x.collect()}
            for x in (detection.templates.count_templates(train, weight="n"), detection.templates.count_templates(plain[0]))
        )
        assert bank == known
    assert test.count() < plain[1].count()


def test_a_report_masks_shapes_and_not_lines(spark, monkeypatch):
    """Ten copies of the lines with other digits cost no more masked rows than one."""
    masked = []
    whole = detection.merged_records
    monkeypatch.setattr(detection, "merged_records", lambda *a: [masked.append(x.count()) or x for x in whole(*a)])
    lines = views.log_lines(spark, SF)
    copies = lines.select("line_id", "line", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    more = copies.select((F.col("line_id") + F.col("k") * 1_000_000).alias("line_id"), F.replace("line", F.lit("2024"), F.col("k") + F.lit(2010)).alias("line"))
    one, ten = (detection.nearest_normal_report(x).first() for x in (lines, more))
    assert ten.tp + ten.fn == 10 * (one.tp + one.fn)
    assert masked[3] <= masked[1] * 2 and masked[1] < (one.tn + one.fp + one.fn + one.tp) / 2
    drawn = detection.nearest_normal_report(lines, train_ratio=0.5).first()
    assert len(masked) == 4 and drawn.tp + drawn.fn == one.tp + one.fn


def test_the_streamed_query_splits_once_and_fills_every_core(spark, monkeypatch):
    from cinderlog.plans import queries

    splits, triggers, split, stream = [], [], queries.sampling.normal_only_split, streaming.line_stream
    monkeypatch.setattr(queries.sampling, "normal_only_split", lambda *a, **k: splits.append(1) or split(*a, **k))
    monkeypatch.setattr(streaming, "line_stream", lambda *a, **k: triggers.append(k["files"]) or stream(*a, **k))
    streamed = {tuple(r) for r in queries.judge_stream(spark, SF).collect()}
    assert len(splits) == 1 and triggers[0] >= spark.sparkContext.defaultParallelism
    assert streamed == {tuple(r) for r in queries.predict_lines(spark, SF).collect()}
