import hashlib
import math
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cinderlog.functions import vectors
from cinderlog.operators import (
    blocks, embedding, joins, late, metrics, ordered, pruned, runstats, sampling, scoring, sessions,
    similarity, streams, templates, thresholds,
)
from cinderlog.session import materialise


# --- ordered ---------------------------------------------------------------------


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(1)
    keys = rng.sample(range(100_000), 5000)
    rows = [(float(k), k % 7) for k in keys]
    df = spark.createDataFrame(rows, "k double, v long").repartition(5)
    got = {r.k: (r.upto, r.all_upto) for r in
           ordered.running_totals(df, "k", {"v": "upto"}, descending).collect()}
    total = 0
    for k, v in sorted(rows, reverse=descending):
        total += v
        assert got[k][0] == total
    assert {a for _, a in got.values()} == {total}


def test_running_totals_keeps_empty_and_tiny_inputs(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v long")
    out = ordered.running_totals(df, "k", {"v": "s"}).collect()
    assert {(r.k, r.s) for r in out} == {("a", 1), ("b", 3)}
    assert ordered.running_totals(df.where("v > 5"), "k", {"v": "s"}).count() == 0


def test_percentiles_with_a_heavy_value(spark):
    values = [1.0] * 400 + [float(x) for x in range(2, 602)]
    df = spark.createDataFrame([(v,) for v in values], "ms double")
    row = runstats.latency_percentiles(df, "ms").first()
    assert row.p50_ms == np.percentile(values, 50)
    assert row.p95_ms == pytest.approx(np.percentile(values, 95), abs=1e-9)
    assert row.p99_ms == pytest.approx(np.percentile(values, 99), abs=1e-9)


def test_template_ids_follow_code_points(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", "a b", "<z>", "", "b"]], "sentence string")
    got = sorted(templates.templates(df).collect())
    assert [(r.template_id, r.sentence, r.n) for r in got] == [
        (0, "", 1), (1, "<z>", 1), (2, "a", 1), (3, "a b", 1), (4, "b", 2),
    ]


# --- joins ----------------------------------------------------------------------


def test_lookup_equals_a_plain_join_under_skew(spark):
    rng = random.Random(2)
    keys = ["hot"] * 3000 + [f"k{rng.randint(0, 400)}" for _ in range(6000)] + [None, "gone"]
    rows = spark.createDataFrame(list(enumerate(keys)), "line_id int, k string")
    table = spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i) for i in range(401)], "k string, v int"
    )
    got = {r.line_id: (r.v, r._found) for r in joins.lookup(rows, table, "k").collect()}
    values = {r.k: r.v for r in table.collect()}
    assert len(got) == len(keys)
    for i, k in enumerate(keys):
        assert got[i] == (values.get(k), k in values)


@pytest.mark.parametrize("named", [True, False])
def test_lookup_spreads_the_hot_key(spark, tmp_path, named):
    """No partition of the result gets the hot key's rows together, equal rows (a frame
    without an id) included, and the join is really there."""
    before = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = spark.range(0, 9000, 1, 8).select(
            "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k")
        )
        table = rows.select("k").distinct().withColumn("v", F.concat(F.lit("of "), "k"))
        table.write.parquet(str(tmp_path / "table"))
        rows = rows if named else rows.select("k")
        found = joins.lookup(rows, spark.read.parquet(str(tmp_path / "table")), "k")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert "BroadcastHashJoin" in plan
        sizes = [
            r.n for r in found.where(F.col("v") == F.concat(F.lit("of "), "k"))
            .groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        ]
        assert sum(sizes) == 9000 and max(sizes) < 2 * 9000 / len(sizes)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lookup_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    got = joins.lookup(rows, table, "k").collect()
    assert len(got) == 100 and sum(r._found for r in got) == 50
    assert all(r.v == (1 if r.k == "a" else None) for r in got)


def exchanged(df):
    """The columns of every hash exchange, from the formatted plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning", plan)


def test_a_text_that_is_only_a_key_does_not_move(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id") % 900).alias("sentence"))
        table = materialise(templates.templates(rows))
        found = templates.template_lookup(rows, table, keep=["id"])
        assert found.columns == ["id", "template_id"] and found.count() == 3000
        moved = exchanged(found)
        assert any("_h1" in x for x in moved) and not any("sentence" in x for x in moved)
        whole = templates.template_lookup(rows, table).where("sentence = 'text 7'").collect()
        assert {r.template_id for r in whole} == {table.where("sentence = 'text 7'").first().template_id}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wide_values_of_hot_keys_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.repeat("k", 900))
    got = joins.lookup(rows, table, "k").collect()
    assert len(got) == 2000
    assert all(r.v == (r.k * 900 if r.k else None) and r._found == bool(r.k) for r in got)


@pytest.mark.parametrize("error", [0.02, -0.2])
def test_percentiles_by_sketch_are_exact(spark, monkeypatch, error):
    """Also where brackets miss (a negative error turns them inside out), with ties and gaps."""
    monkeypatch.setattr(ordered, "RANK_ERROR", error)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.exponential(9, 30_000).round(2), np.full(9000, 4.25), [1e9, -3.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "v double").repartition(6)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = ordered.percentiles(df, "v", shares).first()
    for name, share in shares.items():
        assert got[name] == pytest.approx(np.percentile(values, 100 * share), rel=1e-12)
    one = ordered.percentiles(df.where("v > 1e8"), "v", {"p50": 0.5}).first()
    assert one.p50 == 1e9
    assert ordered.percentiles(df.limit(0), "v", {"p50": 0.5}).first().p50 is None


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_rows_ruled_out_by_bitmaps_are_not_joined(spark, monkeypatch, bits):
    monkeypatch.setattr(joins, "MOST_BITS", bits)
    rows = materialise(spark.range(6000).select("id", F.when(F.col("id") % 5 > 0, F.array(F.col("id") * 1.5, F.lit(0.0))).alias("v")))
    table = rows.where("id % 3 = 0").select("v")
    got = {r.id for r in joins.lookup_missing(rows, table, "v", written=True).collect()}
    assert got == {i for i in range(6000) if i % 3 or i % 5 == 0}
    marked = joins.maybe_in(rows, table, "v").collect()
    assert all(r._maybe for r in marked if r.id % 3 == 0 and r.v)
    assert sum(r._maybe and r.id % 3 > 0 for r in marked) < (2500 if bits == 1 << 15 else 200)


def test_ranges_follow_the_partitions(spark):
    """More shuffle partitions, more and smaller ranges: nothing is fixed."""
    df = spark.range(40_000).select((F.col("id") * 7 % 40_009).alias("k"), F.lit(1).alias("v"))
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        parts = []
        for n in ("4", "16"):
            spark.conf.set(key, n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            out = ordered.running_totals(df, "k", {"v": "upto"})
            assert out.where("upto = 40000").count() == 1 and out.select("upto").distinct().count() == 40_000
            ranged = df.repartitionByRange("k").groupBy(F.spark_partition_id()).count().collect()
            parts.append((len(ranged), max(r["count"] for r in ranged)))
        assert parts[0][0] == 4 and parts[1][0] == 16 and parts[1][1] < parts[0][1] / 2
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_by_group(spark):
    rows = [(g, k, k + 1) for g in "ab" for k in range(50)]
    df = spark.createDataFrame(rows, "g string, k int, v long")
    got = {(r.g, r.k): (r.s, r.all_s) for r in ordered.running_totals(df, "k", {"v": "s"}, by=("g",)).collect()}
    assert all(got[g, k] == ((k + 1) * (k + 2) // 2, 1275) for g, k, _ in rows)


@pytest.mark.parametrize("bucket_rows", [1, 7, 100_000])
def test_the_bucket_that_is_ranked_does_not_grow(spark, bucket_rows):
    rows = spark.range(3000).select("id")
    flagged = sampling.flag_first(
        rows, "id", sampling.seeded_key(F.col("id"), 9), F.col("id") % 2,
        lambda n, _: F.floor(n / 3), bucket_rows=bucket_rows,
    )
    got = {r.id for r in flagged.where("picked").collect()}
    want = first_by_hash(range(0, 3000, 2), 500, 9) | first_by_hash(range(1, 3000, 2), 500, 9)
    assert got == want


def test_only_in_test_compares_whole_vectors(spark):
    schema = "template_id int, first array<float>"
    bank = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], schema)
    test = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], schema)
    assert [r.template_id for r in templates.only_in_test(test, bank).collect()] == [1]


# --- samples --------------------------------------------------------------------


def labelled(spark, normal, abnormal):
    n = normal + abnormal
    return spark.range(n).select(F.col("id"), (F.col("id") < abnormal).cast("int").alias("label"))


def first_by_hash(ids, n, seed):
    def key(i):
        return hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i
    return set(sorted(ids, key=key)[:n])


def test_split_sizes_of_the_published_run(spark):
    split = sampling.normal_only_split(labelled(spark, 1857, 143), 0.2, "id")
    assert tuple(sampling.split_sizes(split).first()) == (1485, 372, 143)
    train = split.where("split = 'train'")
    assert train.where("label = 1").count() == 0
    test = {r.id for r in split.where("split = 'test' AND label = 0").collect()}
    assert test == first_by_hash(range(143, 2000), 372, 1234)


@pytest.mark.parametrize("n, size, want", [(10, 0.5, 5), (7, 0.2, 2), (3, 1.0, 3), (0, 0.2, 0)])
def test_split_rounds_up(spark, n, size, want):
    split = sampling.normal_only_split(labelled(spark, n, 1), size, "id")
    assert split.where("split = 'test' AND label = 0").count() == want


def test_stratified_samples(spark):
    df = labelled(spark, 950, 50)
    v1 = sampling.stratified_sample(df, 100, "id")
    assert v1.count() == 100 and v1.where("label = 1").count() == 5
    assert sampling.stratified_sample(df, 5000, "id").count() == 1000
    assert sampling.stratified_sample(df, None, "id").count() == 1000
    rare = sampling.stratified_sample(labelled(spark, 999, 1), 10, "id")
    assert rare.where("label = 1").count() == 1 and rare.count() == 10


@pytest.mark.parametrize("normal, abnormal, n", [(75, 25, 10), (65, 35, 10), (2, 998, 50), (999, 1, 3)])
def test_stratified_exact_always_gives_n(spark, normal, abnormal, n):
    out = sampling.stratified_sample_exact(labelled(spark, normal, abnormal), n, "id")
    assert out.count() == n and out.select("id").distinct().count() == n


def test_presample_shares(spark):
    df = labelled(spark, 800, 200)
    by_share = sampling.presample(df, 0.1, "id")
    assert (by_share.count(), by_share.where("label = 1").count()) == (100, 20)
    by_count = sampling.presample(df, 500, "id")
    assert (by_count.count(), by_count.where("label = 1").count()) == (500, 100)
    assert sampling.presample(df, 1, "id").count() == 1000


def test_train_ratio_keeps_templates_of_drawn_rows(spark):
    rows = spark.range(200).select("id", (F.col("id") % 5).alias("template_id"))
    drawn = first_by_hash(range(200), 10, 1234)
    got = {r.template_id for r in sampling.train_ratio_templates(rows, 0.05, "id").collect()}
    assert got == {i % 5 for i in drawn}


# --- sessions -------------------------------------------------------------------


def test_sessions(spark):
    lines = spark.createDataFrame(
        [(0, "a b c got blk_12 and blk_-7 blk_12 from 10.0.0.1"), (1, "a b c put blk_12 3"),
         (2, "a b c got blk_12 and blk_-7 blk_12 from 10.9.9.9"), (3, "a b c none"),
         (4, "a b c bad blk_5")],
        "line_id int, line string",
    )
    long = sessions.sessionise(lines)
    assert {(r.session_id, r.line_id) for r in long.collect()} == {
        ("blk_12", 0), ("blk_-7", 0), ("blk_12", 1), ("blk_12", 2), ("blk_-7", 2), ("blk_5", 4)}
    labels = spark.createDataFrame([("blk_12", 0), ("other", 1)], "session_id string, label int")
    text = {r.session_id: (r.label, r.text) for r in
            sessions.session_text(sessions.session_parse(lines), labels).collect()}
    assert text == {
        "blk_12": (0, "- blk_12 got blk and blk blk from ip put blk num"),
        "blk_-7": (None, "blk_12 got blk and blk blk from ip"),
    }


# --- similarity -----------------------------------------------------------------


def vec_frame(spark, matrices):
    return embedding.with_first(spark.createDataFrame(
        [(i, [[float(x) for x in row] for row in m]) for i, m in enumerate(matrices)],
        "template_id int, tokens array<array<float>>",
    ))


@pytest.mark.parametrize("block_floats", [16, 60, 8_000_000])
def test_similarity_equals_brute_force_for_any_blocks(spark, block_floats):
    rng = np.random.default_rng(4)
    test = [rng.normal(size=(rng.integers(1, 4), 4)).round(2) for _ in range(13)]
    bank = [rng.normal(size=(rng.integers(1, 4), 4)).round(2) for _ in range(9)]
    bank[3] = bank[5] = bank[1]
    test[2] = bank[1]
    test[4] = np.zeros((2, 4))
    t, b = vec_frame(spark, test), vec_frame(spark, bank)
    f32 = lambda m: np.asarray(m, np.float32).astype(float)

    d = np.array([[np.linalg.norm(f32(x)[0] - f32(y)[0]) for y in bank] for x in test])
    near = similarity.nearest(t, b, 4, block_floats=block_floats).collect()
    assert len(near) == 13 * 4
    for r in near:
        order = sorted(range(9), key=lambda j: (d[r.test_id, j], j))
        assert r.bank_id == order[r["rank"] - 1]
        assert r.distance == pytest.approx(d[r.test_id, r.bank_id], abs=1e-12)

    one = {r.test_id: r.bank_id for r in similarity.nearest(t, b, block_floats=block_floats).collect()}
    assert one[2] == 1

    pairs = t.select(F.col("template_id").alias("i"), F.col("tokens").alias("x")).join(
        b.select(F.col("template_id").alias("j"), F.col("tokens").alias("y"))
    )
    double = {(r.i, r.j): r.s for r in
              pairs.select("i", "j", vectors.maxsim(F.col("x"), F.col("y")).alias("s")).collect()}
    for r in similarity.maxsim(t, b, block_floats=block_floats).collect():
        mine = [double[r.test_id, j] for j in range(9)]
        assert r.maxsim_max == pytest.approx(max(mine), abs=1e-9)
        assert r.maxsim_mean == pytest.approx(sum(mine) / 9, abs=1e-9)
    chosen = similarity.maxsim(
        t, b, neighbours=spark.createDataFrame([(x.test_id, x.bank_id) for x in near], "test_id int, bank_id int"),
        block_floats=block_floats,
    ).collect()
    for r in chosen:
        mine = [double[r.test_id, x.bank_id] for x in near if x.test_id == r.test_id]
        assert r.maxsim_max == pytest.approx(max(mine), abs=1e-9)
        assert r.maxsim_mean == pytest.approx(sum(mine) / 4, abs=1e-9)
    assert double[4, 0] == 0.0


def clustered(rng, n, dims=6, centres=12):
    """Vectors near a few centres, some of them equal."""
    middle = np.random.default_rng(1).normal(scale=20, size=(centres, dims))
    rows = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))
    return np.concatenate([rows, rows[: n // 10]]).astype(np.float32)


@pytest.mark.parametrize("k", [1, 7])
def test_pivot_search_is_exact_and_leaves_blocks_out(spark, k):
    rng = np.random.default_rng(k)
    bank, test = clustered(rng, 900), clustered(rng, 150)
    t, b = (vec_frame(spark, [[row] for row in side]) for side in (test, bank))
    got = similarity.nearest(t, b, k, block_floats=200).orderBy("test_id", "rank").collect()
    assert len(got) == k * len(test)
    x, y = test.astype(float), bank.astype(float)
    for i in range(len(test)):
        far = np.sqrt(((y - x[i]) ** 2).sum(axis=1))
        mine = got[i * k : (i + 1) * k]
        assert [r.bank_id for r in mine] == np.lexsort((np.arange(len(y)), far))[:k].tolist()
        assert np.allclose([r.distance for r in mine], np.sort(far)[:k], atol=1e-12)
    seen = similarity.visits(t, b, k, block_floats=200).first()
    grid = seen.test_blocks * (len(bank) * 6 // 200)
    assert seen.visited <= seen.offered < grid / 2


def test_best_match_compares_few_pairs(spark):
    rng = np.random.default_rng(8)
    made = [clustered(rng, 3, centres=6) for _ in range(300)]
    test, bank = made[:60], [m[: 1 + i % 3] for i, m in enumerate(made[60:])]
    t, b = vec_frame(spark, test), vec_frame(spark, bank)
    for metric in ("cos", "dot"):
        whole = {r.test_id: r.maxsim_max for r in similarity.maxsim(t, b, metric).collect()}
        for block_floats in (200, 8_000_000):
            got = similarity.maxsim_best(t, b, metric, block_floats=block_floats).collect()
            assert {r.test_id for r in got} == set(whole)
            assert all(r.maxsim_max == pytest.approx(whole[r.test_id], abs=1e-9) for r in got)
        assert max(r.computed / r.pairs for r in got) < 0.5
    assert similarity.maxsim_best(t, b.limit(0)).count() == 0


def test_pivot_search_has_no_more_test_blocks_than_tasks(spark):
    rng = np.random.default_rng(5)
    t, b = (vec_frame(spark, [[row] for row in rng.normal(size=(n, 4))]) for n in (3000, 400))
    seen = similarity.visits(t, b, 2, block_floats=16).first()
    assert seen.test_blocks <= 2 * streams.slots(spark) + 2 * pruned.PIVOTS
    assert seen.offered <= seen.test_blocks * 400


def test_kernels_equal_brute_force_for_any_shape(spark):
    rng = np.random.default_rng(6)

    def part(n, dims, size):
        mats = [rng.normal(scale=size, size=(rng.integers(1, 9), dims)).astype(np.float32) for _ in range(n)]
        values = pa.array([m.ravel() for m in mats], pa.list_(pa.float32()))
        tokens = pa.array([len(m) for m in mats], pa.int32())
        return [m.astype(float) for m in mats], pa.RecordBatch.from_arrays(
            [pa.array(range(n)), values, tokens], ["id", "values", "tokens"])

    # the last size is beyond what single precision holds
    for dims, size in ((3, 1), (40, 1), (5, 1e17)):
        (test, mine), (bank, theirs) = part(70, dims, size), part(600, dims, size)
        whole = np.array([[(x @ y.T).max(axis=1).sum() for y in bank] for x in test])
        every, best = late.All([mine], np.asarray), late.Best([mine.slice(0, 30), mine.slice(30)], np.asarray)
        for at in range(0, 600, 250):
            every.meet(theirs.slice(at, 250))
            best.meet(theirs.slice(at, 250))
        (e,), (m,) = every.found(), best.found()
        at = e.column("test_id").to_numpy()
        assert np.allclose(e.column("best"), whole.max(axis=1)[at], rtol=1e-12)
        assert np.allclose(e.column("total"), whole.sum(axis=1)[at], rtol=1e-9)
        assert np.allclose(m.column("best"), whole.max(axis=1)[m.column("test_id").to_numpy()], rtol=1e-12)


def test_best_match_computes_few_pairs_of_unlike_rows(spark):
    rng = np.random.default_rng(9)
    t, b = (vec_frame(spark, rng.normal(size=(n, 8, 8))) for n in (40, 500))
    whole = {r.test_id: r.maxsim_max for r in similarity.maxsim(t, b).collect()}
    got = similarity.maxsim_best(t, b).collect()
    assert all(r.maxsim_max == pytest.approx(whole[r.test_id], abs=1e-12) for r in got)
    assert sum(r.computed for r in got) < 0.1 * sum(r.pairs for r in got)
    alone = similarity.maxsim(t, b, mean=False)
    assert alone.columns == ["test_id", "maxsim_max"]
    assert {r.test_id: r.maxsim_max for r in alone.collect()} == pytest.approx(whole, abs=1e-12)


def test_no_task_holds_a_block_of_the_bank(spark):
    t, b = vec_frame(spark, [[[0, 0]]]), vec_frame(spark, [[[1, 0]], [[0, 2]]])
    near = similarity.nearest(t, b, 2)
    for df in (near, similarity.maxsim(t, b, neighbours=near)):
        plan = df._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan
    # repeated ids and repeated neighbours count as often as they occur
    twice = similarity.maxsim(t.unionByName(t), b, neighbours=near.unionByName(near)).collect()
    assert [(r.maxsim_max, r.maxsim_mean) for r in twice] == [(0, 0)]


def test_no_block_above_its_bound(spark):
    draw = np.random.default_rng(3)
    # a few rows hold most of the floats
    sizes = np.concatenate([draw.integers(1, 20, 2000), draw.integers(200, 900, 40)]).tolist()
    side = spark.createDataFrame(list(enumerate(sizes)), "id long, _floats long").repartition(5)
    placed, n = blocks.dealt(side, "id", 1000)
    held = {r.block: (r.n, r.s) for r in
            placed.groupBy("block").agg(F.count("*").alias("n"), F.sum("_floats").alias("s")).collect()}
    assert set(held) == set(range(n)) and sum(x[0] for x in held.values()) == len(sizes)
    assert all(s <= 1000 for _, s in held.values())
    assert n < 2 * sum(sizes) / 1000 + 2
    # rows beyond the bound are alone
    alone, n = blocks.dealt(side, "id", 300)
    for r in alone.groupBy("block").agg(F.count("*").alias("n"), F.sum("_floats").alias("s")).collect():
        assert r.s <= 300 or r.n == 1


def test_k_above_the_bank_gives_the_bank(spark):
    t, b = vec_frame(spark, [[[0, 0]]]), vec_frame(spark, [[[1, 0]], [[0, 2]]])
    got = similarity.nearest(t, b, 99).orderBy("rank").collect()
    assert [(r.bank_id, r.distance) for r in got] == [(0, 1.0), (1, 2.0)]


@pytest.mark.parametrize("value, want", [(0, 0), (0.05, 1), (0.3, 3), (1.0, 1), (4, 4), (99, 10)])
def test_core_set_size(value, want):
    assert similarity.core_set_size(10, value) == want


def test_plug_in_embedder_equals_the_built_in_one(spark):
    table = spark.createDataFrame([(0, "a b a"), (1, "<x>"), (2, "")], "template_id int, sentence string")
    plug = {r.template_id: r.tokens for r in
            embedding.embed_templates(table, embedding.HashEmbedder, batch=2).collect()}
    built = {r.template_id: r.tokens for r in embedding.embed_builtin(table).collect()}
    assert plug == built and len(built[0]) == 4


# --- thresholds and metrics --------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_threshold_ties(spark):
    df = scored(spark, [(0.9, 1), (0.9, 1), (0.6, 0), (0.6, 0), (0.2, 1), (0.2, 1), (0.1, 0)])
    best = thresholds.best_f1_threshold(df).first()
    points = {}
    for t in (0.9, 0.6, 0.2, 0.1):
        tp = sum(1 for r in df.collect() if r.score >= t and r.label == 1)
        fp = sum(1 for r in df.collect() if r.score >= t and r.label == 0)
        points[t] = 2 * tp / (tp + fp + 4)
    assert best.f1 == pytest.approx(max(points.values()), abs=1e-9)
    even = scored(spark, [(0.8, 1), (0.5, 0), (0.5, 1), (0.2, 0)])
    assert thresholds.best_f1_threshold(even).first().threshold == 0.5
    tied = scored(spark, [(3.0, 1), (2.0, 0), (1.0, 1), (0.0, 0)])
    assert thresholds.youden_threshold(tied).first().threshold == 3.0


def test_youden_may_flag_nothing(spark):
    row = thresholds.youden_threshold(scored(spark, [(0.9, 0), (0.1, 1)])).first()
    assert math.isinf(row.threshold) and row.j == 0.0


def test_single_class(spark):
    df = scored(spark, [(0.1, 0), (0.4, 0)])
    assert thresholds.score_auc(df).first().auc is None
    assert {r.recall for r in thresholds.pr_curve(df).collect()} == {1.0}
    m = metrics.binary_metrics(df.withColumn("prediction", F.lit(0))).first()
    assert m.recall == 0.0 and m.hard_auc is None and m.accuracy == 1.0


def test_score_auc_counts_ties_half(spark):
    assert thresholds.score_auc(scored(spark, [(0.5, 0), (0.5, 1)])).first().auc == 0.5
    assert thresholds.score_auc(scored(spark, [(0.1, 0), (0.5, 1)])).first().auc == 1.0


def test_weights_stand_for_rows(spark):
    rows = [(0.1, 0, 3), (0.5, 1, 2), (0.5, 0, 1), (0.9, 1, 4)]
    short = spark.createDataFrame(rows, "score double, label int, n int")
    full = short.select("score", "label", F.explode(F.sequence(F.lit(1), "n")))
    for find in thresholds.SEARCHES.values():
        assert find(short, weight="n").first() == find(full).first()
    cut = thresholds.best_f1_threshold(full)
    a = metrics.binary_metrics(thresholds.apply_threshold(short, cut), weight="n").first()
    assert a == metrics.binary_metrics(thresholds.apply_threshold(full, cut)).first()


# fixed values: metrics of the published runs
GOLDENS = [
    ((369, 3, 1, 142), dict(accuracy=0.9922330, f1=0.9861111, precision=0.9793103, recall=0.9930070, hard_auc=0.9924712)),
    ((14, 358, 0, 143), dict(accuracy=0.3048544, f1=0.4440994, precision=0.2854291, recall=1.0, hard_auc=0.5188172)),
    ((1422, 435, 6, 137), dict(hard_auc=0.8619)),
    ((1186, 671, 117, 26), dict(hard_auc=0.4102)),
]


@pytest.mark.parametrize("counts, expected", GOLDENS)
def test_published_metrics(spark, counts, expected):
    df = spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")
    row = metrics.from_counts(df).first()
    for name, value in expected.items():
        places = 4 if value in (0.8619, 0.4102) else 7
        assert round(row[name], places) == value


def predictions(spark, tn, fp, fn, tp, invalid_normal, invalid_abnormal):
    parts = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp), (0, -1, invalid_normal), (1, -1, invalid_abnormal)]
    df = spark.createDataFrame(parts, "label int, prediction int, n int")
    return df.where("n > 0").select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))


def test_published_valid_only_metrics(spark):
    row = metrics.valid_only_metrics(predictions(spark, 1658, 50, 43, 60, 149, 40)).first()
    assert (row.total_samples, row.valid_predictions, row.invalid_rate) == (2000, 1811, 0.0945)
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.9486, 0.5455, 0.5825, 0.5634)
    assert (row.false_positive_rate, row.false_negative_rate) == (0.0293, 0.4175)
    assert (row.anomaly_count, row.predicted_anomaly_count) == (143, 110)
    zero = metrics.valid_only_metrics(predictions(spark, 1606, 251, 137, 5, 0, 1)).first()
    assert (zero.accuracy, zero.precision, zero.recall, zero.f1) == (0.8059, 0.0195, 0.0352, 0.0251)
    assert (zero.false_positive_rate, zero.false_negative_rate, zero.invalid_rate) == (0.1352, 0.9648, 0.0005)


def test_published_fallback_metrics(spark):
    rows = predictions(spark, 1422, 435, 6, 137, 0, 0).withColumn("parse_fallback", F.lit(0))
    row = metrics.fallback_metrics(rows).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.7795, 0.2395, 0.958, 0.3832)
    assert row.predicted_anomaly_count == 572 and row.hard_auc == 0.8619


# --- scoring and run statistics -------------------------------------------------------


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fussy:
    def __call__(self, prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return ["1"] * len(prompts)


def test_replies_carry_numbers_and_prompts_are_shared(spark, monkeypatch):
    written = {}

    def keep(df, name="step"):
        written[name] = materialise(df, name)
        return written[name]

    monkeypatch.setattr(scoring, "materialise", keep)
    lines = spark.createDataFrame([(i, f"line {i % 40} lost" if i % 3 else "line") for i in range(200)], "line_id long, text string")
    settings = spark.createDataFrame(
        [(b * 300, c) for b in "xyz" for c in (5, 1)] + [("x" * 300, 5)], "block string, cap int"
    )
    out = scoring.score_settings(
        lines, settings, scoring.KeywordScorer, lambda t: F.concat("block", F.lit("\n\n"), t, F.lit("\n?")),
        "text", "cap", prompt_by=["block"],
    )
    assert out.columns == ["line_id", "text", "block", "cap", "response", "inference_time_ms", "error"]
    rows = out.collect()
    assert len(rows) == 200 * 7 and all(r.error is None for r in rows)
    assert all(r.response == str(int("lost" in r.text)) for r in rows)
    assert sum(r.block[0] == "x" and r.cap == 5 for r in rows) == 400
    # a row for each text, without the settings' texts
    replies = written["replies"]
    assert "block" not in replies.columns and replies.count() == lines.select("text").distinct().count()


def test_batch_score_keeps_failing_rows_and_scores_copies_once(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bad", "a", "b"])], "line_id int, prompt string")
    got = {r.line_id: (r.response, r.error) for r in scoring.batch_score(df, Fussy, batch=4, tasks=1).collect()}
    assert got == {0: ("1", None), 1: ("0", "no"), 2: ("1", None), 3: ("1", None)}


def test_run_stats_shares(spark):
    df = spark.range(500).select(
        F.when(F.col("id") < 115, "0").otherwise("1").alias("label_text"), F.lit(2.0).alias("inference_time_ms"))
    row = runstats.run_stats(df).first()
    assert (row.normal_percentage, row.abnormal_percentage) == (23.0, 77.0)
    assert (row.time_taken_seconds, row.throughput_logs_per_second) == (1.0, 500.0)


def test_best_config_ties(spark):
    df = spark.createDataFrame([("b", 10, 1.0), ("a", 20, 1.0), ("a", 10, 0.5)], "mix string, cap int, f1 double")
    assert tuple(runstats.best_config(df, {"f1": True}).first()) == ("f1", "a", 20, 1.0)


def test_prompts_are_built_in_the_scoring_stage(spark):
    df = spark.createDataFrame([(0, "x halted"), (1, "y"), (2, "x halted")], "line_id int, text string")
    block = "word " * 700
    build = lambda t: F.concat(F.lit(f"{block}\n\nEntry: "), t, F.lit("\nDigit:"))
    out = scoring.batch_score(df, scoring.KeywordScorer, "text", build)
    assert {r.line_id: r.response for r in out.collect()} == {0: "1", 1: "0", 2: "1"}


def test_keyword_scorer_judges_whole_entries(spark):
    entry = "halted " + "word " * 600
    assert scoring.KeywordScorer()([f"Judge.\n\nEntry: {entry}\nDigit:", "Judge halted ones.\n\nEntry: ok\nDigit:"]) == ["1", "0"]
    row = spark.createDataFrame([(entry,)], "t string").select(scoring.keyword_score(F.col("t"))).first()
    assert row[0] == "1"


def test_sentences_that_differ_late_get_vectors_of_their_own(spark):
    same = " ".join(["word"] * 200)
    table = spark.createDataFrame([(0, same + " a"), (1, same + " b")], "template_id int, sentence string")
    built = [r.tokens for r in embedding.embed_builtin(table).orderBy("template_id").collect()]
    assert built[0][0] != built[1][0] and len(built[0]) == 202


def test_repeated_session_labels(spark):
    found = spark.createDataFrame([("blk_1",), ("blk_2",)], "session_id string")
    labels = spark.createDataFrame([("blk_1", 1, 0), ("blk_1", 0, 5), ("blk_2", 0, 1), ("blk_2", 1, 2)],
                                   "session_id string, label int, label_no long")
    got = {r.session_id: r.label for r in sessions.session_labels(found, labels).collect()}
    assert got == {"blk_1": 0, "blk_2": 1}
