"""How far the sources of a language lie apart: count-level bitmaps.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased; a
language keeps those found in ``min_docs`` of its documents or more. Its terms are
dealt into chunks of bounded size, and every group (language, source) stores one
bitmap of term positions per chunk and count. All terms of a count share one
smoothed rate, so a pair of sources needs no look at single terms: the AND of two
bitmaps and its popcount say how many terms have this count here and that count
there, which is multiplied by the distance of the two rates. What a bitmap has in
common with none of the other side's is met by the count zero there, and what is in
neither bitmap is zero on both sides: these follow by complement.

A task holds two blocks of ``BLOCK`` sources and one chunk, whatever the number of
sources; its sums are whole numbers of 64 bits. Counts of terms are combined
within each task before they are shuffled, so neither a hot source nor a hot term
is a hot key.

Rows: null text, lang and source are ''. A group without terms takes part with
counts of zero. Repeated rows count as often as they occur. Other columns are
ignored. An empty table gives an empty result; so does a lone source without
terms. Of equal values the smaller item, by its UTF-8 bytes, ranks first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.session import materialise

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
CHUNK_TERMS = 4096  # aimed at; a bitmap has room for twice as many
CHUNK_BITS = 2 * CHUNK_TERMS
BLOCK = 16
HELD_TERMS = 400_000  # counters of a task before it passes them on

# a-z and bytes of characters beyond ASCII stay, A-Z become small, the rest are blanks
TO_TERMS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
PARTS = "lang string, source string, term string, count long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents, combined within
    a task; a row may come from several tasks."""

    def emptied(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, counts, found = [], [], [], [], []
        for (lang, source), (n, df) in held.items():
            langs += [lang] * len(n)
            sources += [source] * len(n)
            terms += n.keys()
            counts += n.values()
            found += map(df.__getitem__, n)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()), pa.array(sources, pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(counts, pa.int64()), pa.array(found, pa.int64()),
            ],
            ["lang", "source", "term", "count", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        n = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                terms = terms_of(text.as_py())
                counts, found = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                n -= len(counts)
                counts.update(terms)
                found.update(set(terms))
                n += len(counts)
                if n >= HELD_TERMS:
                    yield emptied(held)
                    n = 0
        if n:
            yield emptied(held)

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, PARTS)


def kept_terms(parts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, count, cells): terms in enough documents, with a (source, count)
    for each source that has them."""
    whole = (
        parts.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    )
    # at most one entry a source
    return (
        whole.groupBy("lang", "term")
        .agg(
            F.sum("count").alias("count"), F.sum("docs").alias("docs"),
            F.collect_list(F.struct("source", "count")).alias("cells"),
        )
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)) in 64 bits: the quotient
    is taken three decimal digits at a time. Holds for totals below 9e15."""
    whole = total + SMOOTHING * terms
    left, out = count + SMOOTHING, F.lit(1).cast("long")
    for power in (1_000_000, 1_000, 1):
        left = left * 1000
        out = out + F.call_function("div", left, whole) * power
        left = left % whole
    return out


def rates_of(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    whole = total + SMOOTHING * terms
    return np.array([1 + SCALE * (int(c) + SMOOTHING) // whole for c in counts], np.int64)


class Side:
    """The sources of one block in one chunk, with their bitmaps one below the other."""

    def __init__(self, table: pa.Table, block: int):
        of = table.filter(pc.equal(table.column("block"), block))
        source, count = of.column("source").to_pylist(), of.column("count").to_numpy()
        head = np.flatnonzero(count == 0)  # one row a source, which carries its total
        self.names = [source[k] for k in head]
        at = {name: k for k, name in enumerate(self.names)}
        level = np.flatnonzero(count > 0)
        owner = np.array([at[source[k]] for k in level], np.int64)
        order = np.lexsort((count[level], owner))
        level, owner = level[order], owner[order]
        bits = of.column("bits")
        self.bits = np.frombuffer(
            b"".join(bits[k].as_py() for k in level.tolist()), "<u8"
        ).reshape(len(level), CHUNK_BITS // 64)
        self.ends = np.searchsorted(owner, np.arange(len(self.names) + 1))
        self.size = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        heads = of.take(head)
        totals, terms = heads.column("total").to_pylist(), heads.column("terms").to_pylist()
        self.zero = np.array([rates_of([0], *x)[0] for x in zip(totals, terms)], np.int64)
        self.rates = np.concatenate(
            [np.empty(0, np.int64)]
            + [
                rates_of(count[level[self.levels(k)]], *x)
                for k, x in enumerate(zip(totals, terms))
            ]
        )

    def levels(self, k: int) -> slice:
        return slice(self.ends[k], self.ends[k + 1])


def distances(left: Side, k: int, right: Side, size: int) -> np.ndarray:
    """Sums over a chunk's ``size`` terms of the distance of source ``k`` to each
    source of ``right``."""
    mine = left.levels(k)
    out = np.zeros(len(right.names), np.int64)
    met = np.zeros(len(right.size), np.int64)  # per bitmap of the right, what any count here has
    for bits, here, n in zip(left.bits[mine], left.rates[mine], left.size[mine]):
        words = np.flatnonzero(bits)  # elsewhere the AND is empty
        joint = np.bitwise_count(right.bits[:, words] & bits[words]).sum(axis=1).astype(np.int64)
        met += joint
        out += _per_source(joint * np.abs(right.rates - here), right)
        # the count is zero there
        out += (n - _per_source(joint, right)) * np.abs(right.zero - here)
    zero = left.zero[k]
    out += _per_source((right.size - met) * np.abs(right.rates - zero), right)
    neither = size - int(left.size[mine].sum()) - _per_source(right.size - met, right)
    return out + neither * np.abs(right.zero - zero)


def _per_source(values: np.ndarray, side: Side) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[side.ends[1:]] - sums[side.ends[:-1]]


def _pairs(table: pa.Table) -> pa.Table:
    """Partial distances of all pairs that one chunk and two blocks hold, both ways."""
    i, j = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    size = pc.max(table.column("size")).as_py()
    left = Side(table, i)
    right = left if i == j else Side(table, j)
    sources, items, values = [], [], []
    for k, name in enumerate(left.names):
        found = distances(left, k, right, size)
        for other, value in zip(right.names, found.tolist()):
            if i == j and other == name:
                continue
            sources.append(name)
            items.append(other)
            values.append(value)
            if i != j:
                sources.append(other)
                items.append(name)
                values.append(value)
    lang = table.column("lang")[0].as_py()
    return pa.table(
        [
            pa.array([lang] * len(sources), pa.string()), pa.array(sources, pa.string()),
            pa.array(items, pa.string()), pa.array(values, pa.int64()),
        ],
        names=["lang", "source", "item", "value"],
    )


def bitmaps(cells: DataFrame) -> DataFrame:
    """One bitmap of term positions for each group, chunk and count."""
    return cells.groupBy("lang", "chunk", "blocks", "source", "count").agg(
        F.substring(F.bitmap_construct_agg("position"), 1, CHUNK_BITS // 8).alias("bits")
    )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to every
    other source of the language (part ``pair``), and the ``top`` terms that it uses
    more than its language does (part ``term``)."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialise(kept_terms(term_counts(docs), min_docs), "kept-terms")
    cells = kept.select(
        "lang", "term", F.col("count").alias("lang_count"), F.explode("cells").alias("_cell")
    ).select("lang", "term", "lang_count", "_cell.source", "_cell.count")
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = materialise(
        docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left"), "groups"
    )
    # sources are dealt into blocks by their hash, BLOCK to a block on average
    langs = materialise(
        groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .join(
            kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("count").alias("lang_total")),
            "lang", "left",
        ),
        "langs",
    )
    zero = F.lit(0).cast("long")
    groups = groups.join(langs, "lang").withColumns(
        {c: F.coalesce(c, zero) for c in ("total", "terms", "lang_total")}
    )
    return pair_part(kept, groups, langs).unionByName(term_part(cells, groups, top))


def pair_part(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    # chunks by hash, positions by rank in them; the rare chunk that is too full is cut
    n_chunks = F.ceil(F.col("terms") / CHUNK_TERMS).cast("int")
    placed = (
        kept.join(langs, "lang")
        .withColumn("_hash", F.pmod(F.xxhash64("term"), n_chunks).cast("int"))
        .withColumn(
            "_at", F.row_number().over(Window.partitionBy("lang", "_hash").orderBy("term")) - 1
        )
        .withColumns(
            {
                "chunk": F.struct("_hash", F.floor(F.col("_at") / CHUNK_BITS).alias("_cut")),
                "position": (F.col("_at") % CHUNK_BITS).cast("long"),
            }
        )
    )
    placed = materialise(placed.select("lang", "chunk", "position", "blocks", "cells"), "placed-terms")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    head = (
        groups.where("terms > 0")
        .join(placed.groupBy("lang", "chunk").agg(F.count("*").alias("size")), "lang")
        .select(
            "lang", "chunk", "blocks", block, "source", F.lit(0).cast("long").alias("count"),
            "total", "terms", "size", F.lit(None).cast("binary").alias("bits"),
        )
    )
    cells = placed.select("lang", "chunk", "position", "blocks", F.explode("cells").alias("_cell")).select(
        "lang", "chunk", "position", "blocks", "_cell.source", "_cell.count"
    )
    # a block meets every block of its language once
    rows = bitmaps(cells).withColumn("block", block).unionByName(head, allowMissingColumns=True)
    dealt = rows.withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumns({"left": F.least("block", "_other"), "right": F.greatest("block", "_other")})
    partial = (
        dealt.drop("_other", "blocks")
        .groupBy("lang", "chunk", "left", "right")
        .applyInArrow(_pairs, "lang string, source string, item string, value long")
    )
    alone = groups.where("terms = 0")
    without = alone.select("lang", "source").join(
        alone.select("lang", F.col("source").alias("item")), "lang"
    ).where("source <> item").withColumn("value", F.lit(0).cast("long"))
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(summed.unionByName(without), "pair")


def term_part(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    found = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (
            rate(F.col("count"), F.col("total"), F.col("terms"))
            - rate(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
        ).alias("value"),
    )
    return ranked(found.where("value > 0"), "term", top)


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
