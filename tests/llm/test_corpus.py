"""Quality classifier, phrases and source divergence beside plain versions."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

import check
from cinderlog.llm import classifier, divergence, phrases
from cinderlog.llm.queries import REGISTRY
from tests.llm.conftest import SF

def test_queries_equal_their_sql(spark):
    """On whole tables, as the driver compares them."""
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compared = {name: both for name, both in REGISTRY.items() if both[1]}
    assert len(compared) == 4
    for name, (query, sql) in compared.items():
        _, verdict = check.compare(spark, con, SF, name, query, sql)
        assert verdict.startswith("ok") and "types" not in verdict, (name, verdict)


# --- op11 ---------------------------------------------------------------------


def marked(spark, n=600):
    """Texts of common words (label 1), or with signs in between or one word over and over."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        picked = [draw.choice(words) for _ in range(draw.randint(20, 80))]
        good = i % 4 > 0
        if not good:
            picked = [f"{w}!! ***" for w in picked] if i % 8 else [picked[0]] * len(picked)
        rows.append((i, " ".join(picked), "en", "s", 0, "x"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, x string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = marked(spark)
    return docs, labels, classifier.train(docs, labels)


def test_scores_of_held_out_documents(trained):
    docs, labels, model = trained
    got = classifier.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert 60 < len(held) < 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_labels_of_held_out_documents_do_not_matter(spark, trained):
    docs, labels, model = trained
    wrong = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"
    )
    other = classifier.train(docs, wrong)
    assert all(np.array_equal(a, b) for a, b in zip(model.layers, other.layers))
    assert model.temperature == other.temperature


def test_word_vectors_equal_plain_sums(spark):
    texts = ["a b c a", None, "", "b!! b", "c a b " * 50]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got, n = classifier.word_vectors(docs)
    index = classifier.index_vectors().astype(int)
    want, count = np.zeros((classifier.BUCKETS, classifier.DIMS)), Counter()
    for t in texts:
        words = [m[0] for m in re.finditer(r"\w+|[^\w\s]+", t or "")]
        at = [zlib.crc32(w.encode()) % classifier.BUCKETS for w in words]
        count.update(at)
        for i, j in permutations(range(len(at)), 2):
            if abs(i - j) <= 2:
                want[at[i]] += index[0 if j < i else 1][at[j]]
    length = np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert np.allclose(got, np.divide(want, length, out=np.zeros_like(want), where=length > 0), atol=1e-6)
    assert {k: int(n[k]) for k in np.flatnonzero(n)} == dict(count)


def test_pooling_in_slices_is_the_same(monkeypatch, trained):
    model, text = trained[2], trained[0].first()["text"] * 20
    whole = model.pooled(text, classifier.Rows())
    monkeypatch.setattr(classifier, "SLICE", 7)
    monkeypatch.setattr(classifier, "LONG", 100)
    assert np.allclose(model.pooled(text, classifier.Rows()), whole)


def test_classifier_odd_rows(spark, trained):
    docs, labels, model = trained
    rows = [(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "word"), (4, "word " * 200_000)]
    odd = spark.createDataFrame([(*r, 1.0, "y") for r in rows], "doc_id long, text string, score double, predicted string")
    got = classifier.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert classifier.score(odd.limit(0), model).count() == 0
    untaught = classifier.train(docs.limit(5), labels.limit(0))
    assert {r["score"] for r in classifier.score(odd, untaught).collect()} == {0.5}
    one_kind = classifier.train(docs, labels.where("quality = 1"))
    assert len({r["score"] for r in classifier.score(odd, one_kind).collect()}) == 1


# --- op12 ---------------------------------------------------------------------


def plain_phrases(rows, min_count=10, share=50, top=2000):
    counts = {}
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(x for g, x in c.items() if len(g) == 1)
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= min_count}
        longer = {}
        for g, a in found.items():
            if len(g) == 3:
                for h in (g[:2], g[1:]):
                    longer[h] = max(longer.get(h, 0), a)
        scored = []
        for g, a in found.items():
            if 100 * longer.get(g, 0) >= share * a:
                continue
            s, _, left, right = min(
                (1000000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g))
            )
            scored.append((-s, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -s))
    return sorted(out)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, text string, n long, phrase string")
    got = phrases.mine(docs.repartition(3), **more)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect())


def babble(seed, n, words=12, size=40):
    draw = random.Random(seed)
    names = ["The", "of", "a", "éa", "\x01", "zz", "B", "x-y", " ", "end", "ab", "\U0001f600"][:words]
    out = []
    for _ in range(n):
        text = "".join(
            draw.choice(names) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"])
            for _ in range(draw.randint(0, size))
        )
        out.append((draw.choice(["en", "de", None]), draw.choice([text, text, None, ""])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(spark, seed):
    rows = babble(seed, 150)
    # a passage of many words that every copy holds in one piece: one unary path
    rows += [("en", "Once upon " + " ".join(f"w{i}" for i in range(40)) + " end. the of")] * 15
    assert mined(spark, rows) == plain_phrases(rows)
    assert mined(spark, rows, min_count=3, top=20) == plain_phrases(rows, 3, 50, 20)


def test_phrases_in_small_slices_and_with_hot_nodes(spark, monkeypatch):
    rows = babble(5, 200, words=5)
    want = plain_phrases(rows)
    monkeypatch.setattr(phrases, "SLICE", 5)
    monkeypatch.setattr(phrases, "HELD_WORDS", 50)
    monkeypatch.setattr(phrases, "FEW", 1)
    monkeypatch.setattr(phrases, "SAMPLED", 1.0)
    assert mined(spark, rows) == want


def test_paths_are_compacted(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([("en", "x " + " ".join(words))] * 6 + [("en", "y " + " ".join(words))] * 6, "lang string, text string")
    got = phrases.paths(phrases.Graph(docs, 5)).collect()
    assert sorted((len(r["words"]), r["n"]) for r in got) == [(3, 6), (3, 6), (30, 12)]
    assert [r["words"] for r in got if r["n"] == 12] == [words]


def test_phrases_of_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("en", ""), ("en", " .,\n")]) == []
    assert mined(spark, [("en", "a b c")]) == []
    rows = [("en", "deep " * 300_000)]
    assert mined(spark, rows) == plain_phrases(rows)


# --- op13 ---------------------------------------------------------------------


def plain_audit(rows, min_docs, top=50):
    groups, total, docs = {}, {}, {}
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        groups.setdefault((lang, source), Counter()).update(terms)
        total.setdefault(lang, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang in total:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def rates(counts):
            whole = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // whole for t in kept}

        q = rates(total[lang])
        own = {s: rates(c) for (x, s), c in groups.items() if x == lang}
        for s, p in own.items():
            pair = [(-sum(abs(p[t] - o[t]) for t in kept), other.encode()) for other, o in own.items() if other != s]
            term = [(-(p[t] - q[t]), t.encode()) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, count long, bits string")
    return sorted(tuple(r) for r in divergence.audit(docs.repartition(3), **more).collect())


def mixed(seed, n):
    draw = random.Random(seed)
    names = [f"{chr(97 + i % 26)}{'é' * (i % 3)}{chr(65 + i // 26)}" for i in range(60)]
    return [
        (
            draw.choice(["en", "en", "de", None]), draw.choice(["s1", "s2", "", None, "Z", "é"]),
            draw.choice([None, "", " ".join(draw.choice(names[: draw.randint(1, 60)]) for _ in range(draw.randint(0, 90)))]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("chunk, block", [(4096, 16), (8, 2)])
def test_audit_equals_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "CHUNK_BITS", max(2 * chunk, 64))
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 20 * block)
    rows = mixed(chunk, 200)
    assert audited(spark, rows, min_docs=5, top=7) == plain_audit(rows, 5, 7)
    # sources without a kept term, a language with nothing but the ends of the scale
    rows += [("fr", "a", "un deux"), ("fr", "b", None), ("fr", "c", "trois"), ("en", "mute", "...")]
    rows += [("en", "huge", "zz " * 100_000)]
    assert audited(spark, rows, min_docs=5) == plain_audit(rows, 5)


def test_audit_of_odd_tables(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []
    rows = [("en", "a", "x y"), ("en", "b", "x")]
    assert audited(spark, rows, min_docs=1) == plain_audit(rows, 1)
    assert audited(spark, rows) == plain_audit(rows, 30)
