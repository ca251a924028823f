import numpy as np

import __spark_entry__ as contract
import corpus_pipeline
from cinderlog.llm import leaks, quality, sets
from tests.llm.conftest import SF
from tests.llm.test_near import brute


def test_registered_once_per_operator():
    names = [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the one before it kept; the first four return the columns of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {0: docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[k], SF)
        out.write.parquet(str(tmp_path / str(k)))
        kept[k + 1] = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert kept[k + 1].columns == columns
    rows = {k: {r.doc_id: r for r in df.collect()} for k, df in kept.items() if k < 5}
    field = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows[1]) == {i for i, r in rows[0].items() if quality.verdict(r.text, field)[6]}
    assert set(rows[2]) <= set(rows[1]) and all(r.text for r in rows[2].values())
    near = brute([(i, r.text) for i, r in rows[2].items()], sets.STAGE)
    assert set(rows[3]) == {i for i, (_, first) in near.items() if first == i}
    (index,) = leaks.indexes(spark.read.parquet(f"{SF}/benchmark.parquet"))
    bad = [k for k, *_ in leaks.search(index, [r.text for r in rows[3].values()])]
    assert set(rows[4]) == {i for k, i in enumerate(rows[3]) if k not in set(bad)}
    pieces = kept[5].collect()
    assert {r.doc_id for r in pieces} == set(rows[4])
    assert np.mean([r.length for r in pieces]) <= 4096
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in rows[0] if i in labels and labels[i].quality == 1 and len((rows[0][i].text or "").split()) >= 10]
    assert np.mean([i in rows[1] for i in good]) > 0.95


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty, long and repeated rows, columns with clashing names, no rows."""
    text = "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(9))
    rows = [
        (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text + " more", None, None, None), (None, text + " other", "en", "s", 1),
        (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \n\n", "en", "s", 3),
        (6, "long " * 100_000, "en", "s", 500_000), (7, "\n".join(["so it is"] * 20_000), "en", "s", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS n", "'x' AS key", "2.0 AS score", "array(1) AS tokens", "3 AS hash")
    for name, docs in (("odd", full), ("none", full.limit(0))):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert k == 4 or docs.columns == columns
            if k == 3:
                kept = sorted(r.doc_id or 0 for r in docs.collect())
        # the first copy stays, repeated as it was; of the others the lines that differ
        assert kept == ([] if name == "none" else [0, 1, 1, 2])
