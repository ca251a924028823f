import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import language, leaks, quality, secrets
from tests.llm.conftest import SF


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
    )


ODD = [None, "", " ", "\n \n", "one", "a\r\nb\x0bc\x0cd", "x\u2028y\u3000z\x85w", "é # ü\U0001f600 | <b>", "a\na\n\na \na",
       "a b c d e a b c d e f", "a b c d e f a b c d e", "z " * 300, "\ud7ff\n#\n#"]


def test_plain_counts(corpus):
    for text in ODD + [r.text for r in corpus.limit(40).collect()]:
        assert quality.measure(text)[0] == plain_counts(text)


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        field = quality.Field(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
        x = rng.normal(size=(n, quality.FEATURES))

        def total(labels):
            return sum(labels * (x @ field.weights)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))

        every = [np.array([k >> j & 1 for j in range(n)]) for k in range(2**n)]
        assert total(field.decode(x).astype(int)) == pytest.approx(max(map(total, every)))


def test_fit_separates_two_kinds_of_lines():
    rng = np.random.default_rng(5)
    sequences = []
    for k in range(60):
        x = rng.normal(size=(rng.integers(1, 9), quality.FEATURES))
        x[:, 0] = 1
        x[:, 6] += 4 * (k % 2)
        sequences.append((x, np.full(len(x), 1 - k % 2)))
    field = quality.fit(sequences)
    right = [field.decode(x).astype(int).tolist() == y.tolist() for x, y in sequences]
    assert np.mean(right) > 0.95


def test_quality_rules_against_labels(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = quality.train(docs, labels)
    rows = quality.judge(docs, field).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_lines_of_one_document_are_told_apart(spark):
    """Labels are of documents; lines within one are still learned."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(8, 20))) + "."
    bad = lambda: " ".join(f"{word().upper()} |" for _ in range(rng.randint(4, 12)))
    rows, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        parts = [good() if rng.random() < (0.2 if junk else 0.9) else bad() for _ in range(rng.randint(6, 12))]
        rows.append((i, "\n".join(parts)))
        labels.append((i, int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    # blocks of either kind in one text come out as such
    text = [good() for _ in range(5)] + [bad() for _ in range(5)] + [good() for _ in range(4)]
    assert field.decode(quality.measure("\n".join(text))[1]).tolist() == [True] * 5 + [False] * 5 + [True] * 4
    out = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    assert sum(0 < r.content_share < 1 for r in out.values()) > 150
    assert sum(out[i].kept == bool(q) for i, q in labels) > 285


def test_quality_of_odd_rows(spark, make):
    docs = make([(k, t) for k, t in enumerate(ODD)] + [(1, ""), (None, "w " * 9)])
    labels = spark.createDataFrame([(0, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels)  # one class only: everything is content
    out = quality.judge(docs, field).collect()
    assert len(out) == len(ODD) + 2 and all(r.base_failed for r in out if r.n_words < 10)
    kept = quality.kept_rows(docs, field)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in out)
    assert quality.judge(make([]), field).count() == 0


# --- language ---------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    assert (model.weights == 0).mean() > 0.5  # sparse
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_language_learns_from_allowed_rows_only(spark, make):
    rows = [(k, "ab ab ab") for k in range(40)]
    docs = make(rows).withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").when(F.col("doc_id") % 2 == 0, "aa"))
    model = language.train(docs)
    assert model.langs == ["aa"]
    out = language.predict(docs.unionByName(make([(99, None), (98, "12 !!"), (97, "")])), model).collect()
    assert {r.lang_pred for r in out if r.doc_id < 50} == {"aa"}
    assert {(r.lang_pred, r.score) for r in out if r.doc_id > 50} == {("und", 0.0)}
    nothing = language.train(make([]))
    assert {r.lang_pred for r in language.predict(make([(1, "abc"), (None, "x")]), nothing).collect()} == {"und"}


def test_grams_in_pieces(monkeypatch):
    text = "Ein  Satz über\nalles, und noch einer dazu. " * 5
    whole = language.grams(text)
    monkeypatch.setattr(language, "CHUNK", 7)
    parts = language.grams(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


# --- decontamination ------------------------------------------------------------------


def brute_leaks(index, text):
    """Every passage with every item, no skipping."""
    words = leaks.WORD.findall((text or "").lower())
    found = {}
    for first in range(0, len(words), index.segment):
        part = words[first : first + 2 * index.segment]
        for i, own in enumerate(index.weights):
            score = sum(own.get(t, 0) for t in {index.vocabulary[w] for w in part})
            if score >= leaks.THRESHOLD - 1e-9:
                joined = " " + " ".join(part) + " "
                both = [
                    sum(f" {' '.join(r)} " in joined for r in want) / len(want) if want else 1.0
                    for want in (index.questions[i], index.answers[i])
                ]
                if min(both) >= leaks.OVERLAP:
                    found[i] = max(found.get(i, 0), round(score, 9))
    return found


def test_retrieval_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    (index,) = leaks.indexes(items)
    texts = [r.text for r in docs]
    texts += [(texts[k] or "") + " " + r.text for k, r in enumerate(items.collect())]  # planted whole
    texts += [" ".join((r.text or "").upper().split()[2:]) for r in items.collect()]  # and in part
    got = {}
    for k, i, score, *_ in leaks.search(index, texts):
        got.setdefault(k, {})[i] = round(score, 9)
    want = {k: f for k, t in enumerate(texts) if (f := brute_leaks(index, t))}
    assert got == want and len(want) > 20


def test_slices_find_what_one_index_finds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    one = {(r.doc_id, r.item_id) for r in leaks.find(docs, items).collect()}
    monkeypatch.setattr(leaks, "SLICE_CHARS", 2000)
    assert {(r.doc_id, r.item_id) for r in leaks.find(docs, items).collect()} == one and one


def test_leaks_of_odd_rows(spark, make):
    question = "which of these seven words is never used twice in a sentence like this one"
    items = spark.createDataFrame(
        [(1, question, "the seventh word", "x"), (2, None, None, "y"), (3, "", "", "z")],
        "item_id long, question string, answer string, text string",
    )
    leak = f"before it {question}? The SEVENTH word! after it"
    docs = make([(1, leak), (1, leak), (2, question), (3, None), (4, ""), (5, "nothing here " * 50)])
    found = leaks.find(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1), (1, 1)]  # a question without its answer is none
    clean = leaks.clean_rows(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5]
    assert leaks.find(docs, items.limit(0)).count() == 0 and leaks.find(make([]), items).count() == 0
    texts = spark.createDataFrame([(7, question + " the seventh word", 1)], "item_id long, text string, answered int")
    assert {r.item_id for r in leaks.find(docs, texts).collect()} == {7}


def test_copies_cut_at_either_end_are_leaks(spark, make):
    """Items of a text alone: three quarters of one are a leak, whichever end is missing."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    (index,) = leaks.indexes(items)
    copies = []
    for r in items.where("text IS NOT NULL").collect():
        words = r.text.split()
        n = len(words)
        if n >= 12:
            copies += [(r.item_id, " ".join(words[a:b])) for a, b in ((0, n * 9 // 10), (0, n * 3 // 4), (n - n * 3 // 4, n))]
    found = {(k, index.ids[i]) for k, i, *_ in leaks.search(index, [f"before it {t} after it" for _, t in copies])}
    assert len(copies) > 30 and all((k, item) in found for k, (item, _) in enumerate(copies))
    text = "one of them began a long and quite unusual walk across seven frozen lakes toward his old home"
    one = spark.createDataFrame([(1, text)], "item_id long, text string")
    parts = [text[: text.index(" toward")], text[text.index("a long") :], " ".join(sorted(text.split()))]
    assert sorted(r.doc_id for r in leaks.find(make(list(enumerate(parts))), one).collect()) == [0, 1]


# --- secrets ---------------------------------------------------------------------------


def test_secrets_by_labels(spark, make):
    rows = []
    for k in range(120):
        key = f"{k * 7919 + 10**9:032x}"[-20:]
        rows.append((k, f'words around token = "a{key}f" and card 4{10**14 + k * 31} too'))
    rows += [(500, None), (501, ""), (502, "short abc123"), (503, "plainlowercasewordthatislong here")]
    out = secrets.scan(make(rows)).collect()
    by_kind = {True: [], False: []}
    for r in out:
        by_kind[r.candidate.startswith("a")].append(r.is_secret)
    assert len(by_kind[True]) == 120 and all(by_kind[True])
    assert len(by_kind[False]) == 121 and not any(by_kind[False])
    again = {(r.doc_id, r.candidate): r.probability for r in secrets.scan(make(rows)).collect()}
    assert again == {(r.doc_id, r.candidate): r.probability for r in out}


def test_candidates_are_complete(spark, make, corpus):
    rows = [(1, "a=0123456789abcdef01&b=0123456789abcdef02 x"), (1, "a=0123456789abcdef01"), (None, "ABCDEFGHIJKLMNOPQRST")]
    got = sorted((r.doc_id or 0, r.run_no, r.candidate, r.context.strip()) for r in secrets.candidates(make(rows).drop("source")).collect())
    assert got == [(0, 0, "ABCDEFGHIJKLMNOPQRST", ""), (1, 0, "0123456789abcdef01", "a="), (1, 0, "0123456789abcdef01", "a="),
                   (1, 1, "0123456789abcdef02", "a=0123456789abcdef01&b=")]
    want = sum(
        1 for r in corpus.collect() for m in re.findall(r"[A-Za-z0-9+/_-]{16,}", r.text or "")
        if re.search("[0-9]", m) or len(m) >= 20
    )
    assert secrets.candidates(corpus).count() == want


def test_assigned_values_of_any_length_and_alphabet(spark, make):
    texts = {
        'password = "hunter2024" here': ["hunter2024"], "x pwd=p@ss!w.r$d end": ["p@ss!w.r$d"], "secret: abcdefghijklmnopq": ["abcdefghijklmnopq"],
        '{"password":"Tr0ub&dor","user":"someone1"}': ["Tr0ub&dor"], "u?token=abc12345&pwd=xyz98765&q=other123": ["abc12345", "xyz98765"],
        "api_key\n=\nk1k2k3, and": ["k1k2k3"], "auth='short' token=\"abc\" x": [], "secret=secret": ["secret"], "the password hunter2024": [],
        "token=0123456789abcdef01.": ["0123456789abcdef01"], "user = hunter2024": [], "PASSWORD='12ab' or x": [],
        "password: pass1234 secret: word9876": ["pass1234", "word9876"],
    }
    rows = secrets.candidates(make(list(enumerate(texts)))).collect()
    got = {k: sorted(r.candidate for r in rows if r.doc_id == k) for k in range(len(texts))}
    assert got == {k: sorted(v) for k, v in enumerate(texts.values())}
    assert all(re.search(secrets.ASSIGNED, r.context) for r in rows)
    assert len({(r.doc_id, r.word_no, r.run_no) for r in rows}) == len(rows)
    many = [(k, f'login with password = "hunter{k * 7919}!x" and order 4{10**16 + k * 31} too') for k in range(60)]
    out = secrets.scan(make(many)).collect()
    assert len(out) == 120 and all(r.is_secret == r.candidate.startswith("hunter") for r in out)


def test_secrets_without_labels(spark, make):
    out = secrets.scan(make([(1, "0123456789abcdef")])).collect()
    assert [(r.candidate, r.probability, r.is_secret) for r in out] == [("0123456789abcdef", 1.0, True)]
    assert secrets.scan(make([])).count() == 0
