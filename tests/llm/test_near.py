import random
import time

import pytest

from cinderlog.llm import lines, sets
from cinderlog.llm.components import components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def brute(rows, near):
    own = {i: shingles(t, near.width) for i, t in rows}
    up = {i: i for i in own}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(own)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = own[i], own[j]
            if a and b and 100 * len(a & b) >= near.percent * len(a | b) and root(i) != root(j):
                low, high = sorted((root(i), root(j)))
                up[high] = low
    return {i: (len(own[i]), root(i)) for i in ids}


def crowd(rng, groups, size, words=60, vocabulary=400):
    """Groups of near copies, loners, and one passage that many share."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage, rows = [word() for _ in range(30)], []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(words)] = word()
            rows.append(" ".join(copy))
    for _ in range(size * 2):
        rows.append(" ".join(passage + [word() for _ in range(rng.randrange(1, 40))]))
    return list(enumerate(rows))


@pytest.mark.parametrize("near", [sets.QUERY, sets.STAGE])
@pytest.mark.parametrize("longest", [2, 8, 32])
def test_components_equal_brute_force(make, monkeypatch, near, longest):
    monkeypatch.setattr(sets, "LIST", longest)
    rows = crowd(random.Random(longest), 4, 25)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "one two three"), (1006, "ONE two\tthree")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sets.jaccard_components(make(rows), near).collect()}
    assert got == brute(rows, near)


def test_repeated_rows_null_ids_and_nothing(make):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (5, text), (5, "other words in this one"), (7, text), (None, text), (8, "other words in this one"), (9, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in sets.jaccard_components(make(rows)).collect())
    assert got == [(-1, -1), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
    assert sets.jaccard_components(make([])).count() == 0


def test_first_of_groups_keeps_columns(make):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text + " x"), (2, text), (1, "all different words here"), (4, None)]
    out = sets.first_of_groups(make(rows), sets.STAGE)
    assert out.columns == make([]).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_ascii_lower_case_only(make):
    rows = [(1, "ÀB c d"), (2, "àb c d"), (3, "Àb C D")]
    got = {r.doc_id: r.component_id for r in sets.jaccard_components(make(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(5, k) for k in range(6, 30)] + [(29, 3), (7, 7), (6, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in (3, *range(5, 30))} == {3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_an_id_join_nothing(make):
    """They may link documents, but two of them are not one document."""
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(40))
    rows = [(1, text("a")), (2, text("b")), (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " x")]
    rows += [(9, text("d")), (None, text("d") + " x"), (8, text("d") + " x y"), ((1 << 63) - 2, text("e")), (None, text("e"))]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in sets.jaccard_components(make(rows)).collect())
    assert got == [(-1, -1)] * 6 + [(1, 1), (2, 2), (8, 8), (9, 8), ((1 << 63) - 2, (1 << 63) - 2)]
    kept = sets.first_of_groups(make(rows), sets.QUERY)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 8, (1 << 63) - 2]


# --- lines --------------------------------------------------------------------------


def dedup(make, rows):
    return {(r.doc_id, r.n_deleted): r.text for r in lines.dedup(make(rows)).collect()}


def para(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_long_passages_go_where_they_repeat(make):
    p, q = para("p", 60), para("q", 55)
    rows = [(2, f"own two\n{p}\nend"), (1, f"{p}\nfirst"), (3, f"a\n{q}"), (4, f"{q}\n{p}\nb"), (5, "own two")]
    got = dedup(make, rows)
    assert got == {(1, 0): rows[1][1], (2, 1): "own two\nend", (3, 0): rows[2][1], (4, 2): "b", (5, 0): "own two"}


def test_short_lines_alone_stay(make):
    rows = [(k, f"head\nbody {k} text\nfoot") for k in range(30)]
    assert all(n == 0 for _, n in dedup(make, rows))


def test_runs_of_short_lines_go_and_are_extended(make):
    run = [f"line number {k}" for k in range(7)]
    rows = [(1, "\n".join(["x", *run, "y"])), (2, "\n".join(["u", *run, "v"])), (3, "\n".join([*run[:2], "w"]))]
    got = dedup(make, rows)
    assert got == {(1, 0): rows[0][1], (2, 7): "u\nv", (3, 0): rows[2][1]}


def test_repeats_inside_a_document_and_copies(make):
    p = para("p", 60)
    rows = [(1, f"{p}\nmiddle\n{p}"), (2, f"{p}\nmiddle\n{p}"), (3, None), (4, ""), (5, "\n\n"), (None, f"z\n{p}")]
    got = dedup(make, rows)
    assert got == {(1, 1): f"{p}\nmiddle", (2, 3): "", (3, 0): None, (4, 0): "", (5, 0): "\n\n", (None, 1): "z"}


def test_equal_rows_and_blank_lines(make):
    p = para("p", 60)
    rows = [(1, f"{p}\n\nx"), (1, f"{p}\n\nx"), (2, f"\n{p}\n \ny")]
    out = sorted((r.doc_id, r.text, r.n_deleted) for r in lines.dedup(make(rows)).collect())
    assert out == [(1, rows[0][1], 0), (1, rows[0][1], 0), (2, "\n \ny", 1)]
    assert lines.dedup(make([])).count() == 0


@pytest.mark.parametrize("sizes", [(13, 13, 13, 13), (16, 16, 16, 16), (25, 14, 7, 5), (5, 7, 14, 25), (2, 23, 2, 24)])
def test_four_lines_of_fifty_words_go(make, sizes):
    """No three of the lines reach HEAVY_WORDS words, and all four are one short of the windows' run."""
    rows = []
    for p in range(12):
        passage = "\n".join(para(f"p{p}l{j}x", n) for j, n in enumerate(sizes))
        for copy in (p, 100 + p):
            own = [[f"own {copy} {side} {j}" for j in range(6)] for side in "ab"]
            rows.append((copy, "\n".join([*own[0], passage, *own[1]])))
    out = {r.doc_id: r.n_deleted for r in lines.dedup(make(rows)).collect()}
    assert {out[p] for p in range(12)} == {0} and {out[100 + p] for p in range(12)} == {4}


@pytest.mark.parametrize("seed", range(3))
def test_guaranteed_runs_never_stay(make, seed):
    """No run of GRAM + WINDOW - 1 lines, nor one of HEAVY_WORDS words in a line, is left twice."""
    rng = random.Random(seed)
    pool = [f"short {k} words" for k in range(12)] + [para(f"h{k}x", 52) for k in range(4)]
    parts = [[rng.choice(pool) for _ in range(6)] for _ in range(6)]
    rows = []
    for k in range(25):
        body = [f"own {k} {j}" for j in range(3)] + parts[rng.randrange(6)] + [f"tail {k}"] + parts[rng.randrange(6)][:4]
        rows.append((k, "\n".join(body)))
    out = {r.doc_id: r.text for r in lines.dedup(make(rows)).collect()}
    before = {line for _, t in rows for line in t.split("\n")}
    after = [line for t in out.values() for line in t.split("\n")]
    assert before == set(after)  # each line stays somewhere
    heavy = [x for x in after if len(x.split()) >= 50]
    assert len(heavy) == len(set(heavy))
    size, seen = lines.GRAM + lines.WINDOW - 1, set()
    for k, _ in rows:
        kept = out[k].split("\n")
        for a in range(len(kept) - size + 1):
            run = tuple(kept[a : a + size])
            assert run not in seen
            seen.add(run)


def test_many_equal_lines_take_time_in_proportion(make):
    same, two = "\n".join(["so it is"] * 100_000), "\n".join(["so it is", "and so on"] * 30_000)
    rows = [(1, same), (2, same + "\nown"), (3, two), (4, "x\nso it is\ny")]
    began = time.monotonic()
    got = dedup(make, rows)
    assert time.monotonic() - began < 90
    assert got[1, 99_999] == "so it is" and got[2, 100_000] == "own"
    assert (3, 59_997) in got or (3, 59_998) in got
    assert got[4, 0] == rows[3][1]
