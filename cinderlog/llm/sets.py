"""Exact Jaccard join on word shingles, with skipping by set relations.

Texts with equal shingle sets form a class; classes are compared, not copies. A
shingle is a 63-bit hash, a class the 64-bit hash of its sorted set.

Order of tokens. Tokens below ``low`` are counted over all classes. Class 0 are
those in at most ``LIST`` sets, class 2 the more frequent ones, which come last in
the order. A set whose class-0 tokens below ``low`` fill its prefix (n -
ceil(t n) + 1 tokens) never looks further. The others are read whole, and their
tokens from ``low`` on are counted among them: class 1 up to ``LIST``, class 2
above. Any two linked sets share a prefix token in this order.

Index-level skipping. A list of a class-0 or class-1 token holds at most LIST sets,
in blocks by set size; a block meets itself and the next one only, as others cannot
reach the threshold. For class 0 the shared tokens are counted, and a pair is
skipped unless its unshared counted tokens leave room for the threshold. Long lists
(class 2) skip by position: two sets whose first common token stands too late in
both are skipped.

Answer-level skipping. In long lists, which groups of near copies make, no pairs
are formed. A few leaders of each list are compared with all its members. A member
takes over its leader's links: both are in one component then, and pairs inside a
component need no answer. For the rest the distance to the leader bounds the
distance to each other (1 - Jaccard is a metric), and only pairs whose distances to
the leader differ by less than the threshold allows are compared, and of these only
pairs whose sketches (token counts by the lowest bits) leave room for the threshold.
New leaders are drawn as long as they leave clearly fewer such pairs.

Rows: null texts, texts without a word have an empty set, linked with nothing.
Repeated rows are one document; rows with one id and different texts belong to one
component. Rows without an id get no component; they are a document for each text,
which may link others. The largest long stands for a missing id. Other columns are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import window_hashes
from cinderlog.llm.components import components
from cinderlog.session import materialise

LIST = 32
LEADERS = 4
ROUNDS = 6
SKETCH = 128
LAST = (1 << 63) - 1
CHUNK_WORDS = 200_000


@dataclass(frozen=True)
class Near:
    """Words in a shingle and the least similarity in percent."""

    width: int = 4
    percent: int = 85

    @property
    def low(self) -> int:
        """Tokens below are counted over all sets: the share a prefix takes, and a third more."""
        return int((1 << 63) * min(1.0, 1.35 * (100 - self.percent) / 100))

    def prefix(self, n: Column) -> Column:
        return n - F.ceil(n * self.percent / F.lit(100)) + 1

    def apart(self, a: Column, b: Column, unshared: Column) -> Column:
        """Whether linked sets of sizes a and b can have so many unshared tokens."""
        return (100 + self.percent) * unshared <= (100 - self.percent) * (a + b)

    def sizes_fit(self, a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def block(self, n: Column) -> Column:
        """Sets whose blocks are not the same or neighbours cannot be linked."""
        return F.floor(F.log(n.cast("double")) / F.lit(-math.log(self.percent / 100)) + 1e-9).cast("int")


QUERY = Near()
STAGE = Near(width=5, percent=80)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of word hashes, as non-negative 64-bit numbers."""
    if not len(words):
        return np.empty(0, np.int64)
    found = window_hashes(words, min(width, len(words)))
    return np.unique((found >> np.uint64(1)).astype(np.int64))


def signed(docs: DataFrame, below: int | None, width: int) -> DataFrame:
    """(doc_id, cid, n, tokens, sketch): class, size and the tokens below ``below`` (None: all).

    ``sketch`` counts a whole set's tokens by their lowest bits; two sets have at least as
    many unshared tokens as their sketches are apart. It comes with whole sets only.
    """
    whole = below is None

    def chunks(batches: Iterator[pa.RecordBatch]):
        ids, words, ends = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:  # bytes.lower and bytes.split know ASCII only
                    words += text.encode("utf-8", "surrogatepass").lower().split()
                ids.append(doc_id)
                ends.append(len(words))
                if len(words) >= CHUNK_WORDS:
                    yield ids, words, ends
                    ids, words, ends = [], [], []
        if ids:
            yield ids, words, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, ends in chunks(batches):
            hashes = (
                pd.util.hash_array(np.array(words, dtype=object), categorize=False)
                if words else np.empty(0, np.uint64)
            )
            cids, sizes, parts, sketches, at = [], [], [], [], 0
            for end in ends:
                found = shingle_set(hashes[at:end], width)
                at = end
                cids.append(xxhash.xxh3_64_intdigest(found.tobytes()) >> 1 if len(found) else None)
                sizes.append(len(found))
                parts.append(found if whole else found[: np.searchsorted(found, below)])
                sketches.append(np.bincount(found % SKETCH, minlength=SKETCH).astype(np.int32) if whole else None)
            offsets = np.cumsum([0, *map(len, parts)])
            tokens = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int64())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), tokens,
                    pa.array(sketches, pa.list_(pa.int32())),
                ],
                ["doc_id", "cid", "n", "tokens", "sketch"],
            )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, cid long, n long, tokens array<long>, sketch array<int>")


def list_pairs(lists: DataFrame, near: Near) -> DataFrame:
    """(a, b, token): pairs of each short list (token, cid, n) that sizes allow."""
    left = lists.select("token", F.col("cid").alias("a"), F.col("n").alias("na"), near.block(F.col("n")).alias("block"))
    right = lists.select(
        "token", F.col("cid").alias("b"), F.col("n").alias("nb"),
        F.explode(F.array(near.block(F.col("n")), near.block(F.col("n")) - 1)).alias("block"),
    )
    # the set in the lower block, or of the same block the lower class, stands left
    same = near.block(F.col("na")) == near.block(F.col("nb"))
    pairs = left.join(right, ["token", "block"]).where(~same | (F.col("a") < F.col("b")))
    return pairs.where(near.sizes_fit("na", "nb") & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "token"
    )


def verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Adds ``distance`` and ``linked`` to pairs (a, b)."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("ta", "tb")))
    union = F.col("na") + F.col("nb") - F.col("same")
    return both.select(
        *pairs.columns,
        (1 - F.col("same") / union).alias("distance"),
        (100 * F.col("same") >= near.percent * union).alias("linked"),
    )


def long_list_links(lists: DataFrame, sets: DataFrame, links: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) that connect what the given ``links`` and the members of long lists
    (token, cid, n, pos) connect: one to each member's component, and the rest."""
    far = (100 - near.percent) / 100
    # a pair fits when its slacks, places against the room for unshared tokens, add up to 0 at
    # most; so one of its sets has none above 0, and the other not more than the list allows
    lists = lists.withColumn("slack", (100 + near.percent) * F.col("pos") - (100 - near.percent) * F.col("n"))
    least = lists.where("slack <= 0").groupBy("token").agg(F.min("slack").alias("least"))
    lists = materialise(
        lists.join(least, "token").where("slack + least <= 0").select("token", "cid", "n", "slack"), "long-lists"
    )
    rows = lists.count()
    if not rows:
        return links
    found, before = links, None
    for turn in range(ROUNDS):
        # the member with the fewest tokens of its own stands in the middle of a group; the others at random
        drawn = [F.min(F.struct(F.xxhash64("cid", F.lit(turn * LEADERS + k)), "cid"))["cid"] for k in range(1, LEADERS)]
        if not turn:
            drawn.insert(0, F.min(F.struct("slack", F.xxhash64("cid"), "cid"))["cid"])
        leaders = lists.where("slack <= 0").groupBy("token").agg(F.array_distinct(F.array(*drawn)).alias("leaders"))
        led = materialise(lists.join(leaders, "token"), "led")
        pairs = led.select(F.explode("leaders").alias("a"), F.col("cid").alias("b")).where("a <> b").distinct()
        fresh = materialise(verified(pairs, sets, near), "compared")
        labels = components(found.unionByName(fresh.where("linked").select("a", "b")))
        labels = materialise(labels, "labels")
        # from here on a link to its component stands for all links of a member
        found = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        to_leader = fresh.select(F.col("a").alias("leader"), F.col("b").alias("cid"), "distance")
        rest = (
            led.select("token", "cid", "n", "slack", F.col("leaders")[0].alias("leader"))
            .join(to_leader, ["leader", "cid"], "left")
            .join(labels.withColumnRenamed("node", "cid"), "cid", "left")
            .select(
                "token", "cid", "n", "slack", F.coalesce("component", "cid").alias("part"),
                F.coalesce("distance", F.lit(0.0)).alias("distance"),
            )
        )
        # sets whose distances to the leader differ by more than a slot cannot be linked
        rest = materialise(rest.withColumn("slot", F.floor(F.col("distance") / far).cast("int")), "rest")
        near_slots = F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot")
        mine = rest.where("slack <= 0")
        others = rest.select("token", "cid", "n", "slack", "part", "distance", near_slots)
        left = _product(mine, others, ["token", "slot"]) - _product(mine, others, ["token", "slot", "part"])
        if not left:
            return found
        if left <= 20 * rows or before is not None and left > 0.8 * before:
            break
        before = left
    # the sketches' distance is at most the number of unshared tokens
    sketches = sets.select("cid", "sketch")
    names = ("cid", "n", "slack", "part", "distance", "sketch")
    mine = mine.join(sketches, "cid").select("token", "slot", *(F.col(c).alias(f"{c}_a") for c in names))
    others = others.join(sketches, "cid").select("token", "slot", *(F.col(c).alias(f"{c}_b") for c in names))
    off = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    pairs = mine.join(others, ["token", "slot"]).where(
        (F.col("part_a") != F.col("part_b"))
        & (F.col("slack_a") + F.col("slack_b") <= 0)
        & near.sizes_fit("n_a", "n_b")
        & (F.abs(F.col("distance_a") - F.col("distance_b")) <= far + 1e-9)
        & near.apart(F.col("n_a"), F.col("n_b"), off)
    )
    pairs = pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()
    return found.unionByName(verified(pairs, sets, near).where("linked").select("a", "b"))


def _product(left: DataFrame, right: DataFrame, keys: list[str]) -> int:
    """How many pairs a join on ``keys`` would make."""
    counted = left.groupBy(*keys).agg(F.count("*").alias("l")).join(
        right.groupBy(*keys).agg(F.count("*").alias("r")), keys
    )
    return counted.agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0))).first()[0]


def long_prefixes(sets: DataFrame, short: DataFrame, frequent: DataFrame, near: Near) -> DataFrame:
    """(token, cid, n, pos, df, long): prefix tokens, with their places and list lengths, of
    the sets that class-0 tokens do not fill, but for class 0 itself.

    ``frequent`` holds the class-2 tokens below ``low``.
    """
    rows = sets.join(short, "cid", "left_semi").select("cid", "n", F.explode("tokens").alias("token"))
    low = rows.where(F.col("token") < near.low).join(frequent.select("token", F.col("df").alias("_df")), "token", "left")
    low = low.select("cid", "n", "token", F.col("_df").alias("df"), F.when(F.col("_df").isNull(), 0).otherwise(2).alias("kind"))
    high = rows.where(F.col("token") >= near.low)
    counts = high.groupBy("token").agg(F.count("*").alias("df"))
    high = high.join(counts, "token").select(
        "cid", "n", "token", "df", F.when(F.col("df") > LIST, 2).otherwise(1).alias("kind")
    )
    order = Window.partitionBy("cid").orderBy("kind", "token")  # one document's tokens
    ranked = low.unionByName(high).withColumn("pos", F.row_number().over(order) - 1)
    return ranked.where(
        (F.col("pos") < near.prefix(F.col("n"))) & (F.col("kind") > 0) & (F.col("df") > 1)
    ).select("token", "cid", "n", "pos", "df", (F.col("kind") == 2).alias("long"))


def set_links(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid, n, rep) of each row, and the links (a, b) between classes."""
    base = materialise(signed(docs, near.low, near.width), "signed")
    reps = base.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"))
    rows = base.select("doc_id", "cid", "n").join(reps, "cid", "left")
    one = materialise(
        base.join(reps, "cid").where("doc_id = rep").dropDuplicates(["cid"]).select("cid", "n", "rep", "tokens"),
        "classes",
    )
    postings = one.select("cid", "n", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    counts = materialise(counts, "counts")
    shared = materialise(postings.join(counts, "token"), "postings")

    frequent = counts.where(F.col("df") > LIST)
    dropped = shared.where(F.col("df") > LIST).groupBy("cid").agg(F.count("*").alias("dropped"))
    own = F.size("tokens") - F.coalesce("dropped", F.lit(0))
    stats = materialise(
        one.join(dropped, "cid", "left").select("cid", "n", "rep", own.alias("own")), "sizes"
    )
    short = stats.where(F.col("own") < near.prefix(F.col("n"))).select("cid")

    counted = (
        list_pairs(shared.where(F.col("df") <= LIST), near).groupBy("a", "b").agg(F.count("*").alias("both"))
    )
    close = counted.join(
        stats.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("own").alias("oa")), "a"
    ).join(stats.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("own").alias("ob")), "b")
    unshared = F.col("oa") + F.col("ob") - 2 * F.col("both")
    close = close.where(near.apart(F.col("na"), F.col("nb"), unshared)).select("a", "b")
    close = materialise(close, "close")

    needed = close.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(short).distinct()
    wanted = stats.join(needed, "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    texts = texts.join(wanted.select("doc_id"), "doc_id", "left_semi")
    whole = signed(texts, None, near.width).join(wanted.select("cid"), "cid", "left_semi")
    sets = materialise(whole.select("cid", "n", "tokens", "sketch").dropDuplicates(["cid"]), "sets")

    more = materialise(long_prefixes(sets, short, frequent, near), "prefixes")
    others = list_pairs(more.where("NOT long"), near).select("a", "b")
    links = materialise(
        verified(close.unionByName(others).distinct(), sets, near).where("linked").select("a", "b"), "links"
    )
    lists = more.where("long").select("token", "cid", "n", "pos")
    return rows, long_list_links(lists, sets, links, near)


def jaccard_components(docs: DataFrame, near: Near = QUERY) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
    rows, links = set_links(docs, near)
    rows = materialise(rows, "rows")
    # A class is its smallest document, so a component's least node is its id. A class of rows
    # without an id has a node of its own, beyond all ids.
    nowhere = F.lit(LAST).cast("decimal(20,0)") + 1
    node = F.when(F.col("rep") == LAST, nowhere + F.col("cid")).otherwise(F.col("rep")).cast("decimal(20,0)")
    rows = rows.withColumn("node", F.when(F.col("cid").isNotNull(), node))
    nodes = rows.where(F.col("cid").isNotNull()).select("cid", "node").distinct()
    edges = links.join(nodes.select(F.col("cid").alias("a"), F.col("node").alias("ra")), "a").join(
        nodes.select(F.col("cid").alias("b"), F.col("node").alias("rb")), "b"
    ).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # rows with one id and different texts
    several = (
        rows.where((F.col("doc_id") != LAST) & F.col("node").isNotNull())
        .groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    )
    again = rows.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    edges = edges.unionByName(again.distinct())
    labels = components(edges)
    found = rows.join(labels, "node", "left")
    component = F.coalesce("component", "node", "doc_id").cast("long")
    return found.select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id") != LAST, component).alias("component_id"),
    )


def first_of_groups(docs: DataFrame, near: Near) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for.

    The smallest doc_id stays; documents without a word and rows without an id stay.
    """
    found = jaccard_components(docs, near)
    lost = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
