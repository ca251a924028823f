"""Phrases whose words belong together, from a weighted de Bruijn graph.

Texts are cut into pieces at sentence marks and line ends, pieces into words at
blanks. Every three successive words of a piece are an edge from the node of the
first two to the node of the last two; equal edges add up. The last two words of a
piece lead to no third one: these ends are edges to an empty word, so each word of
the text starts exactly one edge. Nothing else is counted in the text. The count of
two words is the flow out of their node, ends included; the count of a word is the
flow of all nodes that begin with it.

Edges that are frequent enough form the graph of candidates. A node all of whose
flow comes in by one edge and leaves by one edge is passed through only; such unary
paths are compacted to one row, found by pointer doubling. All phrases inside
a path have the path's count, so only its two ends need a look at other counts, and
the pairs of words inside it are part of a longer phrase just as frequent.

A task combines edges before it passes them on. Those of a node go to one task,
sorted; nodes that more than 1/``HOT_PARTS`` of the rows start from are dealt
by their third word as well. Which nodes these are is estimated from every
sixteenth document; it decides where rows go, not what they count. Counts below
1e16 are exact.

Rows: null texts are empty, null languages are ``und``. Repeated rows count as often
as they occur; other columns are ignored. Texts of any length are read in slices.
Without a candidate there is no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.session import materialise

MIN_COUNT, SHARE, TOP = 10, 50, 2000
HOT_PARTS, SALTS, SAMPLED = 1024, 64, 1 / 16
HELD_WORDS = 3_000_000  # of a task, before their edges are combined
HELD_VOCABULARY = 1 << 20
SLICE = 1 << 20  # bytes of a text that are split at once
OUT_ROWS = 200_000
FEW = 1000  # sampled rows below which a node is not worth dealing out

END = b"."  # no word holds a sentence mark
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else ord(END) if b in BREAKS else 0x20 if b == 0x09 else b
    for b in range(256)
)
EDGE = "lang string, gram binary, salt int, n long"
FLOW = "kind string, lang string, w1 binary, w2 binary, w3 binary, n long"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, with ``END`` wherever a piece ends; two at its end."""
    plain, at = text.translate(TO_WORDS), 0
    while at < len(plain):
        to = at + SLICE
        if to < len(plain):  # no word is cut: go on to the next blank or mark
            stops = [x for x in (plain.find(b" ", to), plain.find(END, to)) if x >= 0]
            to = min(stops) if stops else len(plain)
        yield plain[at:to].replace(END, b" . ").split()
        at = to
    yield [END, END]


class Words(dict):
    """Number of a word, in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Held:
    """Words of one language that a task has read and not yet passed on."""

    def __init__(self, lang: str, hot: set[tuple[bytes, bytes]]):
        self.lang, self.hot, self.rest = lang, hot, []
        self.empty()

    def empty(self) -> None:
        self.words, self.ids, self.n = Words(), [], 0

    def add(self, tokens: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens)))
        self.n += len(tokens)

    def edges(self) -> Iterator[pa.RecordBatch]:
        """The combined edges of all words but the last two, which are kept for later."""
        ids = np.concatenate([np.array([self.words[w] for w in self.rest], np.int64), *self.ids])
        names = list(self.words)
        self.rest = [names[k] for k in ids[-2:]]
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        real = a > 0
        key = a[real] << 42 | b[real] << 21 | np.where(b[real] > 0, c[real], 0)
        key, n = np.unique(key, return_counts=True)
        number = dict(self.words) | {b"": 0}
        hot = [number[x] << 21 | number[y] for x, y in self.hot if x in number and y in number]
        names[0] = b""
        table = pa.array(names, pa.binary())
        low = (1 << 21) - 1
        for at in range(0, len(key), OUT_ROWS):
            part = key[at : at + OUT_ROWS]
            w1, w2, w3 = part >> 42, part >> 21 & low, part & low
            salt = np.full(len(part), -1, np.int32)
            own = np.flatnonzero(np.isin(part >> 21, hot))
            salt[own] = [zlib.crc32(names[k]) % SALTS for k in w3[own]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.lang] * len(part), pa.string()),
                    pc.binary_join_element_wise(*(table.take(pa.array(w)) for w in (w1, w2, w3)), b" "),
                    pa.array(salt), pa.array(n[at : at + OUT_ROWS]),
                ],
                ["lang", "gram", "salt", "n"],
            )
        self.empty()


def edges(docs: DataFrame, hot: dict[str, set[tuple[bytes, bytes]]]) -> DataFrame:
    """(lang, gram, salt, n): edges as tasks have combined them. A gram is three words,
    the last or the last two of them empty at an end, with a blank between each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    held[lang] = Held(lang, hot.get(lang, set()))
                for tokens in slices(text.as_py()):
                    held[lang].add(tokens)
                    if (
                        sum(h.n for h in held.values()) >= HELD_WORDS
                        or sum(len(h.words) for h in held.values()) >= HELD_VOCABULARY
                    ):
                        for h in held.values():
                            yield from h.edges()
        for h in held.values():
            if h.n:
                yield from h.edges()

    return docs.mapInArrow(run, EDGE).withColumn("gram", F.col("gram").cast("string"))


def node() -> Column:
    return F.substring_index("gram", " ", 2)


def words_of(grams: pa.Array) -> list[pa.Array]:
    """First, second and third words: the text between the blanks, without a copy per word."""
    grams = grams.cast(pa.binary())
    data = np.frombuffer(grams.buffers()[2], np.uint8) if grams.buffers()[2] else np.empty(0, np.uint8)
    ends = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1]
    data = data[ends[0] : ends[-1]]
    blanks = np.flatnonzero(data == 0x20).reshape(-1, 2)
    # every blank is left out, so what comes after it moves to the front by one
    stops = np.column_stack([blanks, ends[1:] - ends[0]]).astype(np.int64)
    stops -= 2 * np.arange(len(grams))[:, None] + np.arange(3)
    offsets = np.append(0, stops.ravel()).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), 3 * len(grams), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 0x20])]
    )
    return [words.take(pa.array(np.arange(k, 3 * len(grams), 3))) for k in range(3)]


def hot_nodes(docs: DataFrame) -> dict[str, set[tuple[bytes, bytes]]]:
    """Nodes with more than 1/HOT_PARTS of the edges of a sample: fewer than HOT_PARTS."""
    sample = edges(docs.where(F.rand(7) < SAMPLED), {})
    counts = materialise(
        sample.groupBy("lang", node().alias("node")).agg(F.count("*").alias("n")), "sampled-nodes"
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = counts.where((F.col("n") * HOT_PARTS > total) & (F.col("n") >= FEW)).collect()
    out: dict[str, set[tuple[bytes, bytes]]] = {}
    for r in most:
        out.setdefault(r["lang"], set()).add(tuple(r["node"].encode().split(b" ")))
    return out


def flows(parts: DataFrame, min_count: int) -> DataFrame:
    """(kind, lang, w1, w2, w3, n): whole counts of ``edge``s from ``min_count`` on;
    ``node``s and the flow out of them, from ``min_count`` on or of a hot node's part;
    ``word``s and the flow of the nodes that begin with them, in several rows.

    Edges of a node come one after the other; a task holds one batch of them and what
    it knows of the last edge and the last node.
    """
    keys = ["lang", "w1", "w2", "salt", "w3"]

    def changes(table: pa.Table, names: list[str]) -> np.ndarray:
        """Whether a row differs from the one before it; the first one does."""
        out = np.ones(table.num_rows, bool)
        out[1:] = False
        for name in names:
            column = table.column(name)
            out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return out

    def summed(table: pa.Table, names: list[str]) -> pa.Table:
        starts = np.flatnonzero(changes(table, names))
        n = np.add.reduceat(table.column("n").to_numpy(), starts)
        return table.take(pa.array(starts)).set_column(
            table.schema.get_field_index("n"), "n", pa.array(n)
        )

    def split(table: pa.Table) -> pa.Table:
        words = words_of(table.column("gram").combine_chunks())
        return pa.table(
            [table.column("lang"), *words[:2], table.column("salt"), words[2], table.column("n")],
            names=[*keys, "n"],
        )

    def rows(kind: str, table: pa.Table, width: int) -> list[pa.RecordBatch]:
        none = pa.nulls(table.num_rows, pa.binary())
        words = [table.column(f"w{k}").combine_chunks() if k <= width else none for k in (1, 2, 3)]
        return pa.table(
            [pa.array([kind] * table.num_rows), table.column("lang"), *words, table.column("n")],
            names=["kind", "lang", "w1", "w2", "w3", "n"],
        ).to_batches()

    def nodes(done: pa.Table) -> Iterator[pa.RecordBatch]:
        large = np.maximum(done.column("n").to_numpy() >= min_count, done.column("salt").to_numpy() >= 0)
        yield from rows("node", done.filter(pa.array(large)), 2)
        yield from rows("word", summed(done, keys[:2]), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = last = None  # the last ones so far, of one row each
        for batch in batches:
            if not batch.num_rows:
                continue
            table = split(summed(pa.Table.from_batches([batch]), ["gram", "lang", "salt"]))
            table = summed(pa.concat_tables([edge, table]), keys) if edge else table
            edge, whole = table.slice(table.num_rows - 1), table.slice(0, table.num_rows - 1)
            if whole.num_rows:
                yield from rows("edge", whole.filter(pc.greater_equal(whole.column("n"), min_count)), 3)
                found = summed(pa.concat_tables([last, whole]) if last else whole, keys[:4])
                last, done = found.slice(found.num_rows - 1), found.slice(0, found.num_rows - 1)
                if done.num_rows:
                    yield from nodes(done)
        if edge:
            yield from rows("edge", edge.filter(pc.greater_equal(edge.column("n"), min_count)), 3)
            yield from nodes(summed(pa.concat_tables([last, edge]) if last else edge, keys[:4]))

    # by hashes first, of the first word and of the node: most rows differ in these
    order = F.shiftleft(F.hash("lang", F.substring_index("gram", " ", 1)).cast("long"), 32).bitwiseOR(
        F.hash(node(), "salt").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    dealt = (
        parts.repartition("lang", node(), "salt")
        .withColumn("_order", order)
        .sortWithinPartitions("_order", "lang", "salt", "gram")
        .drop("_order")
    )
    return dealt.mapInArrow(run, FLOW).withColumns(
        {w: F.col(w).cast("string") for w in ("w1", "w2", "w3")}
    )


class Graph:
    """Counts from ``min_count`` on: ``words`` (lang, w1, n), ``nodes`` (lang, w1, w2, n,
    most, inner) without the ends, ``edges`` (id, lang, w1, w2, w3, n), ``totals`` (lang, n)."""

    def __init__(self, docs: DataFrame, min_count: int):
        docs = docs.select(
            F.coalesce("lang", F.lit("und")).alias("lang"),
            F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        )
        found = materialise(flows(edges(docs, hot_nodes(docs)), min_count), "flows")
        words = materialise(
            found.where("kind = 'word'").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "words"
        )
        self.totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
        self.words = words.where(F.col("n") >= min_count)
        self.edges = materialise(
            found.where("kind = 'edge' AND w3 <> ''")
            .select(F.monotonically_increasing_id().alias("id"), "lang", "w1", "w2", "w3", "n"),
            "edges",
        )
        flow = (
            found.where("kind = 'node' AND w2 <> ''")
            .groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        )
        one = F.lit(1)
        ways = (
            self.edges.select("lang", "w1", "w2", one.alias("out"), F.lit(0).alias("in"), "n")
            .unionByName(
                self.edges.select(
                    "lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(0).alias("out"),
                    one.alias("in"), "n",
                )
            )
            .groupBy("lang", "w1", "w2")
            .agg(
                F.sum("out").alias("out"), F.sum("in").alias("in"),
                F.min("n").alias("least"), F.max("n").alias("most"),
            )
        )
        passed = (F.col("out") == 1) & (F.col("in") == 1) & (F.col("least") == F.col("n"))
        self.nodes = materialise(
            flow.join(ways, ["lang", "w1", "w2"], "left").select(
                "lang", "w1", "w2", "n", "most", F.coalesce(passed, F.lit(False)).alias("inner")
            ),
            "nodes",
        )


def paths(graph: Graph) -> DataFrame:
    """(lang, words, n): the edges, those along a unary path as one row.

    Every edge after an inner node points to the one before that node; pointers double
    until all of them reach the first edge of their path. A path has no cycle, as
    the first word of a piece always comes in from outside.
    """
    inner = graph.nodes.where("inner").select("lang", "w1", "w2")
    ahead = graph.edges.join(inner, ["lang", "w1", "w2"]).select("lang", "w1", "w2", "id")
    behind = graph.edges.select(
        "lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("id").alias("to")
    )
    # an inner node has one edge on either side
    linked = materialise(
        ahead.join(behind, ["lang", "w1", "w2"]).select("id", "to", F.lit(1).cast("long").alias("steps")),
        "links",
    )
    reached = []
    open_links = linked
    while not open_links.isEmpty():
        # every link jumps as far again as the edge it points to has come
        jumped = open_links.join(
            linked.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps")),
            "to", "left",
        )
        jumped = materialise(
            jumped.select(
                "id", F.coalesce("_to", "to").alias("to"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                F.col("_to").isNull().alias("_ends"),
            ),
            "links",
        )
        reached.append(jumped.where("_ends").drop("_ends"))
        open_links = jumped.where("NOT _ends").drop("_ends")
        # ends stay in the table that is pointed to: they hold how far it is to the first edge
        linked = jumped.drop("_ends") if len(reached) == 1 else jumped.drop("_ends").unionByName(
            _all(reached[:-1])
        )
    placed = graph.edges if not reached else graph.edges.join(_all(reached), "id", "left")
    if not reached:
        placed = placed.withColumns({"to": F.lit(None).cast("long"), "steps": F.lit(None).cast("long")})
    return (
        placed.withColumns({"to": F.coalesce("to", "id"), "steps": F.coalesce("steps", F.lit(0))})
        .groupBy("to")
        .agg(
            F.min("lang").alias("lang"), F.min("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("steps", "w1", "w2", "w3"))).alias("_edges"),
        )
        .select(
            "lang",
            F.concat(
                F.array(F.col("_edges")[0]["w1"], F.col("_edges")[0]["w2"]), F.col("_edges")["w3"]
            ).alias("words"),
            "n",
        )
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", a * a * million, left * right)


def mine(docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words
    of each language, by the score of their weakest cut.

    A pair of words goes if a longer phrase around it has ``share`` percent of its count.
    """
    graph = Graph(docs, min_count)
    first = graph.words.select("lang", "w1", F.col("n").alias("f_first"))
    pairs = (
        graph.nodes.where(~F.col("inner"))
        .where((F.coalesce("most", F.lit(0)) * 100) < F.col("n") * share)
        .join(first, ["lang", "w1"])
        .join(graph.words.select("lang", F.col("w1").alias("w2"), F.col("n").alias("f_last")), ["lang", "w2"])
        .select(
            "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"),
            F.array(F.struct(score(F.col("n"), F.col("f_first"), F.col("f_last")).alias("score"),
                             F.lit(1).alias("k"), F.col("f_first").alias("l"), F.col("f_last").alias("r"))).alias("cuts"),
        )
    )
    # nodes inside a path have its count; those at its ends are looked up
    ends = graph.nodes.where(~F.col("inner")).select("lang", "w1", "w2", F.col("n").alias("f"))
    size = F.size("words")
    laid = (
        paths(graph)
        .select(
            "lang", "words", F.col("n").alias("a"), F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"),
            F.col("words")[size - 2].alias("z1"), F.col("words")[size - 1].alias("z2"),
        )
        .join(ends.withColumnRenamed("f", "f_in"), ["lang", "w1", "w2"])
        .join(ends.toDF("lang", "z1", "z2", "f_out"), ["lang", "z1", "z2"])
        .select("lang", "a", "f_in", "f_out", "words", F.explode(F.sequence(F.lit(0), size - 3)).alias("_at"))
        .select(
            "lang", "a",
            *(F.col("words")[F.col("_at") + k].alias(f"w{k + 1}") for k in range(3)),
            F.when(F.col("_at") == 0, F.col("f_in")).otherwise(F.col("a")).alias("f12"),
            F.when(F.col("_at") == size - 3, F.col("f_out")).otherwise(F.col("a")).alias("f23"),
        )
    )
    triples = (
        laid.join(first, ["lang", "w1"])
        .join(graph.words.select("lang", F.col("w1").alias("w3"), F.col("n").alias("f_last")), ["lang", "w3"])
        .select(
            "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
            F.array(
                *(
                    F.struct(score(F.col("a"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
                    for k, l, r in ((1, F.col("f_first"), F.col("f23")), (2, F.col("f12"), F.col("f_last")))
                )
            ).alias("cuts"),
        )
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        pairs.unionByName(triples)
        .withColumn("cut", F.array_min("cuts"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .join(graph.totals, "lang")
        .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )
