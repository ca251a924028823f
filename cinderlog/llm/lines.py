"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

1. A document is its lines with a word, each a hash. A gram is a run of lines. It is
   a fingerprint when it reaches ``HEAVY_WORDS`` words with as few lines as possible,
   at most ``HEAVY_LINES``, or when it has ``GRAM`` lines and its hash is the minimum
   of a window of ``WINDOW`` neighbouring ones (of equal ones the last). So two places
   that share a run of GRAM + WINDOW - 1 lines, or a shorter one of HEAVY_WORDS
   words, share a fingerprint.
2. Each fingerprint's places are joined with its first place, in order of
   doc_id, then place in the document. Pairs of later places are never formed.
3. Each match is extended both ways over equal lines, and the later lines of the run
   are deleted. A fingerprint carries the ``REACH`` lines on either side of it. That is
   enough: where more lines are equal, they hold a fingerprint of their own.

All steps take time in proportion to the lines, however often a line repeats.

A single line below HEAVY_WORDS words never goes alone, however often it occurs.

Rows: null and empty texts stay as they are. A text that loses all its lines with
a word becomes "". Rows with the same id and text are one document and treated
alike, rows with one id and different texts are documents of their own; a null id
comes last. Other columns are kept. An empty table gives an empty table. Lines
without a word go only with a text that loses all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.session import materialise

GRAM = 3
WINDOW = 3
HEAVY_WORDS = 50
HEAVY_LINES = GRAM + WINDOW - 2  # from one line more on, the windows find a run of any words
REACH = GRAM + WINDOW - 2
LAST = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def word_count(line: Column) -> Column:
    """Words between ASCII blanks."""
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def row_key(docs: DataFrame) -> Column:
    """Stands for id and text together; never null."""
    return F.xxhash64("doc_id", "text")


def hashed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, at, hash, words): per document the arrays over its lines with a word."""
    every = F.transform(
        lines_of(F.col("text")),
        lambda x, k: F.struct(k.alias("at"), F.xxhash64(x).alias("hash"), word_count(x).alias("words")),
    )
    rows = docs.where(F.col("text").isNotNull()).select(
        row_key(docs).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
        F.filter(every, lambda x: x["words"] > 0).alias("lines"),
    )
    return rows.where(F.size("lines") > 0).select(
        "key", "doc_id",
        F.col("lines.at").alias("at"), F.col("lines.hash").alias("hash"), F.col("lines.words").alias("words"),
    )


def fingerprints(rows: DataFrame) -> DataFrame:
    """(key, doc_id, gram, k, size, before, after): selected grams of ``size`` lines that
    begin with line ``k``, one row each, and the lines around them, the nearest first."""
    n = F.size("hash")
    every = F.sequence(F.lit(0), n - 1)

    def gram(k: Column, size: int) -> Column:
        return F.xxhash64(F.slice("hash", k + 1, size), F.lit(size))

    def heavy(k: Column) -> Column:
        """Fewest lines from ``k`` on that reach the words, up to HEAVY_LINES; else null."""
        total, found = F.lit(0), F.lit(None).cast("int")
        for size in range(1, HEAVY_LINES + 1):
            total = total + F.coalesce(F.get("words", k + size - 1), F.lit(0))
            found = F.coalesce(found, F.when((total >= HEAVY_WORDS) & (k + size <= n), size))
        return found

    with_grams = rows.select(
        "key", "doc_id",
        F.transform(every, heavy).alias("sizes"),
        F.col("hash"),
        F.when(
            n >= GRAM,
            F.transform(
                F.sequence(F.lit(0), n - GRAM),
                lambda k: F.struct(gram(k, GRAM).alias("gram"), (-k).alias("back")),
            ),
        ).otherwise(F.array().cast("array<struct<gram:bigint,back:int>>")).alias("grams"),
    )
    m = F.size("grams")
    minima = F.when(
        m > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(m - WINDOW, F.lit(0))),
            lambda k: F.array_min(F.slice("grams", k + 1, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<struct<gram:bigint,back:int>>"))
    # a column of its own: it is looked into once for each of its elements
    with_minima = with_grams.select("key", "doc_id", "hash", "sizes", minima.alias("minima"))
    # neighbouring windows often choose the same gram
    chosen = F.filter("minima", lambda x, j: (j == 0) | (F.get("minima", j - 1)["back"] != x["back"]))
    winnowed = F.transform(
        chosen, lambda x: F.struct(x["gram"].alias("gram"), (-x["back"]).alias("k"), F.lit(GRAM).alias("size"))
    )
    by_words = F.filter(
        F.transform(
            "sizes",
            lambda size, k: F.struct(
                F.when(size.isNotNull(), F.xxhash64(F.slice("hash", k + 1, F.coalesce(size, F.lit(1))), size)).alias("gram"),
                k.alias("k"), size.alias("size"),
            ),
        ),
        lambda x: x["gram"].isNotNull(),
    )
    each = with_minima.select("key", "doc_id", "hash", F.explode(F.concat(winnowed, by_words)).alias("f"))
    k = F.col("f.k")
    return each.select(
        "key", "doc_id", "f.gram", "f.k", "f.size",
        F.reverse(F.slice("hash", F.greatest(k - REACH, F.lit(0)) + 1, F.least(k, F.lit(REACH)))).alias("before"),
        F.slice("hash", k + F.col("f.size") + 1, F.lit(REACH)).alias("after"),
    )


def same_lines(a: str, b: str) -> Column:
    """How many lines are equal, from the first one on."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(at == 0, F.size(equal)).otherwise(at - 1)


def repeats(rows: DataFrame) -> DataFrame:
    """(key, start, stop): runs of lines of a document that occurred before."""
    found = fingerprints(rows)
    place = F.struct("doc_id", "key", "k")
    firsts = (
        found.groupBy("gram")
        .agg(F.min(F.struct("doc_id", "key", "k", "before", "after")).alias("first"), F.max(place).alias("last"))
        .where(
            F.struct("first.doc_id", "first.key", "first.k") != F.col("last")
        )
        .select(
            "gram", F.col("first.key").alias("first_key"), F.col("first.k").alias("first_k"),
            F.col("first.before").alias("first_before"), F.col("first.after").alias("first_after"),
        )
    )
    later = found.join(firsts, "gram").where(
        (F.col("key") != F.col("first_key")) | (F.col("k") != F.col("first_k"))
    )
    return later.select(
        "key",
        (F.col("k") - same_lines("before", "first_before")).alias("start"),
        (F.col("k") + F.col("size") + same_lines("after", "first_after")).alias("stop"),
    )


def deletions(rows: DataFrame) -> DataFrame:
    """(key, ats, all): numbers of the lines to delete from each document, ascending."""
    places = repeats(rows).distinct().select("key", F.explode(F.sequence("start", F.col("stop") - 1)).alias("k"))
    lost = places.groupBy("key").agg(F.array_sort(F.collect_set("k")).alias("ks"))  # a document's lines
    return lost.join(rows.select("key", "at"), "key").select(
        "key", F.transform("ks", lambda k: F.get("at", k)).alias("ats"),
        (F.size("ks") == F.size("at")).alias("all"),
    )


def without(lines: Column, ats: Column) -> Column:
    """The lines but those numbered ``ats``: what lies between each two of them."""
    n = F.size(ats)
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(ats, i - 1) + 1)
    stop = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(ats, i))
    between = F.transform(
        F.sequence(F.lit(0), n), lambda i: F.struct(start(i).alias("start"), (stop(i) - start(i)).alias("n"))
    )
    some = F.filter(between, lambda x: x["n"] > 0)
    return F.flatten(F.transform(some, lambda x: F.slice(lines, x["start"] + 1, x["n"])))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs cut from ``text``, and how many lines went
    (``n_deleted``)."""
    rows = materialise(hashed(docs).dropDuplicates(["key"]), "line-hashes")
    lost = deletions(rows).select(
        F.col("key").alias("_key"), F.col("ats").alias("_ats"), F.col("all").alias("_all")
    )
    marked = docs.withColumn("_row", row_key(docs)).join(lost, F.col("_row") == F.col("_key"), "left")
    marked = marked.withColumn("_lines", F.when(F.col("_ats").isNotNull(), lines_of(F.col("text"))))
    stays = without(F.col("_lines"), F.col("_ats"))
    text = (
        F.when(F.col("_ats").isNull(), F.col("text"))
        .when(F.col("_all"), F.lit(""))
        .otherwise(F.array_join(stays, "\n"))
    )
    columns = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns]
    return marked.select(*columns, F.coalesce(F.size("_ats"), F.lit(0)).cast("long").alias("n_deleted"))
