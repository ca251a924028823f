import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinderlog.llm import packing, tokenfile
from cinderlog.llm.tokens import encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a  b", "a   b", " a", "a ", "a\n\nb", "it's I'LL don't", "<|endoftext|> x", "É è\nÀ", "x²y 12½",
       "日本 語", "a\tb", "it'sabc 12a3!!? «a» ¿x?", "'re're", "a \nb", "a\n b", "İ ς Σ", "e\u0301"]


@pytest.mark.parametrize("kind, path", [("lower", WORDS), ("spaced", BYTES)])
def test_cached_ids_are_the_tokenizers_ids(corpus, kind, path):
    plain, mine = Tokenizer.from_file(path), encoder(kind, path)
    for text in ODD + [r.text for r in corpus.limit(60).collect()]:
        for _ in range(2):  # from the model, then from the cache
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, n).astype(np.uint16) for n in (1, 2, 900, 37)]
    blocks += [np.full(600, 7, np.uint16), np.tile(np.arange(9, dtype=np.uint16), 99), np.zeros(1, np.uint16)]
    coded = tokenfile.encode_blocks(blocks)
    for some in (coded, coded[::-1], coded[2:3]):  # blocks are read in any company
        found = tokenfile.decode_blocks(some)
        assert all(np.array_equal(a, b) for a, b in zip(found, [blocks[coded.index(c)] for c in some]))
    assert len(coded[4]) < 100 and len(coded[5]) < 200


def test_damage_is_noticed():
    (code,) = tokenfile.encode_blocks([np.arange(300, dtype=np.uint16)])
    for at in (4, 9, 40):
        with pytest.raises(ValueError):
            tokenfile.decode_blocks([code[:at] + bytes([code[at] ^ 1]) + code[at + 1 :]])


def test_a_block_advances_in_lanes(monkeypatch):
    """Steps of arrays, not ids, are what a block costs; it used to take one for each id."""
    rng, steps, look = np.random.default_rng(5), [], tokenfile.Model.look
    monkeypatch.setattr(tokenfile.Model, "look", lambda *a: steps.append(1) or look(*a))
    blocks = [(rng.zipf(1.3, tokenfile.BLOCK) % 50_000).astype(np.uint16) for _ in range(3)]
    coded = tokenfile.encode_blocks(blocks)
    assert len(steps) * 50 < tokenfile.BLOCK
    found = tokenfile.decode_blocks(coded)
    assert len(steps) * 25 < tokenfile.BLOCK and all(np.array_equal(a, b) for a, b in zip(found, blocks))


def test_blocks_of_any_length_round_trip(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = [1, 3, 63, 64, 65, 127, 128, 129, 200, 1000, tokenfile.BLOCK - 1, tokenfile.BLOCK, tokenfile.BLOCK + 1, tokenfile.MOST]
    blocks = [(rng.zipf(1.2, n) % 65536).astype(np.uint16) for n in sizes]
    blocks += [np.zeros(n, np.uint16) for n in (1, 70, 5000)] + [np.full(300, 65535, np.uint16)]
    whole = tokenfile.encode_blocks(blocks)
    monkeypatch.setattr(tokenfile, "GROUP", 3)
    assert tokenfile.encode_blocks(blocks) == whole  # whatever blocks advance together
    assert all(np.array_equal(a, b) for a, b in zip(tokenfile.decode_blocks(whole[::-1]), blocks[::-1]))
    with pytest.raises(ValueError):
        tokenfile.encode_blocks([np.zeros(tokenfile.MOST + 1, np.uint16)])


def expected(rows, path, end):
    plain, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    return out


def test_token_file(spark, make, corpus, tmp_path):
    rows = [(r.doc_id, r.text) for r in corpus.collect()] + [(900_000, None), (900_001, ""), (900_002, "a b " * 9000)]
    folder = str(tmp_path / "file")
    tokenfile.write(make(rows), BYTES, folder)
    want = expected(sorted(rows), BYTES, 2)
    got = {r.doc_id: tuple(r) for r in tokenfile.digest(spark, folder).collect()}
    assert got == {w[0]: w[:4] for w in want}
    runs = {}
    for r in sorted(tokenfile.read_ids(spark, folder).collect(), key=lambda r: (r.doc_id, r.at)):
        runs.setdefault(r.doc_id, []).extend(r.ids)
    assert runs == {w[0]: w[4] for w in want}
    assert any(len(w[4]) > tokenfile.BLOCK for w in want)


def test_token_file_of_repeated_rows_and_of_nothing(spark, make, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None)]
    tokenfile.write(make(rows), BYTES, str(tmp_path / "a"))
    got = sorted((r.start, r.n_tokens) for r in tokenfile.digest(spark, str(tmp_path / "a")).collect())
    assert got == [(0, 2), (2, 2), (4, 2), (6, 1)]
    tokenfile.write(make([]), BYTES, str(tmp_path / "b"))
    assert tokenfile.digest(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("seed, room", [(1, 16), (2, 50), (3, 4096)])
def test_plan_is_best_fit_decreasing(seed, room):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, room, 400).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan(counts, room)
    free: list[int] = []  # plain best fit, longest first, one by one
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(room - n)
    assert plan["n"].sum() == 400 and (plan["sequence"] + plan["n"]).max() == len(free)
    used = {}
    for r in plan.itertuples():
        for k in range(r.n):
            used.setdefault(r.sequence + k, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room


def test_packing(make, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()] + [(900_000, None), (900_001, "word " * 9000), (900_001, "word " * 9000)]
    got = packing.pack_documents(make(rows), WORDS, with_ids=True).collect()
    want = {w[0]: w[4] for w in expected(rows, WORDS, 1)}
    sequences = {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + 4096]
        assert r.ids == ids and r.length == len(ids) and r.piece == r.start // 4096
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(want[i]) for i, _ in rows)
    assert sum(r.length for r in got) == total
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-total // 4096) + 1


def test_packing_nothing(make):
    assert packing.pack_documents(make([]), WORDS).count() == 0


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    rows = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 10 = 0, 5L, 7L) as length")
    ranks = {}
    for r in packing.ranked(rows).collect():
        ranks.setdefault(r.length, []).append(r.rank)
    assert sorted(ranks[7]) == list(range(900)) and sorted(ranks[5]) == list(range(100))
