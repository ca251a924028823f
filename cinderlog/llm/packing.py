"""Best-fit packing of documents into sequences, planned on a length histogram.

1. Each document becomes pieces: its ids and an end id, cut only where it is
   longer than a sequence.
2. Pieces are counted by length. Best fit, longest first, runs over these counts:
   equal sequences form one group, and many pieces of a length take a place in a
   group at once. The plan's size depends on the sequence length, not on the
   number of documents.
3. A piece's rank among those of its length, found without gathering a length in
   one task, joins it to the planned place of that rank.

Rows: null text is an empty document (its end id alone). Repeated rows are
packed each for itself. Other columns are ignored. An empty table gives no rows.
Equal lengths take their places in order of a hash of id and piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.tokens import encoder
from cinderlog.session import materialise

MAX_TOKENS = 4096
BUCKET_ROWS = 2_000  # mean rows that one task ranks within a length
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, vocabulary: str, end_id: int = 1, max_tokens: int = MAX_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder("lower", vocabulary).encode
        end, width = np.uint32(end_id).tobytes(), 4 * max_tokens
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                flat = np.frombuffer(b"".join(columns[5]), "<u4").view(np.int32)
                ends = np.cumsum([0, *columns[3]])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], room: int = MAX_TOKENS) -> pd.DataFrame:
    """Best fit, longest first, over counts by length.

    One row per run of equal placements: pieces of ``length`` with ranks
    ``first`` to ``first + n - 1`` go to sequences ``sequence``,
    ``sequence + 1``, … at ``offset``.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, how many)
    rooms: list[int] = []  # its keys, in order
    rows, opened = [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in groups:
                groups[free] = []
                bisect.insort(rooms, free)
            groups[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):  # the fullest sequences that still have room
                free = rooms[at]
                first, n = groups[free].pop()
                if not groups[free]:
                    del groups[free], rooms[at]
                take = min(n, left)
                rows.append((length, rank, take, first, room - free))
                put(free, first + take, n - take)
                put(free - length, first, take)
            else:  # new sequences; full ones first, then one with the rest
                each = room // length
                full, rest = divmod(left, each)
                take = full * each
                for k in range(each if full else 0):
                    rows.append((length, rank + k * full, full, opened, k * length))
                put(room - each * length, opened, full)
                opened += full
                for k in range(rest):
                    rows.append((length, rank + take + k, 1, opened, k * length))
                if rest:
                    put(room - rest * length, opened, 1)
                    opened += 1
                take = left
            left -= take
            rank += take
    names = ["length", "first", "n", "sequence", "offset"]
    return pd.DataFrame(rows, columns=names, dtype="int64").sort_values(["length", "first"])


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length, for rows (doc_id, piece, length, …).

    Rows of a length are dealt over buckets by a hash; a bucket's ranks start
    after the rows of the buckets before it. The number of buckets follows the
    rows, so no length meets in one task.
    """
    buckets = rows.count() // BUCKET_ROWS + 1
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    rows = rows.withColumn("_bucket", spread)
    sizes = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket")
    starts = sizes.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    rows = rows.withColumn("_in", F.row_number().over(order) - 1)
    return rows.join(starts, ["length", "_bucket"]).withColumn(
        "rank", F.col("_before") + F.col("_in")
    ).drop("_before", "_in", "_bucket")


def pack(rows: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, …).

    Pieces of full length need no plan: each is a sequence. The plan goes to the
    tasks as a broadcast; a histogram of at most ``max_tokens`` lengths makes at
    most a few times as many groups, whatever the number of pieces.
    """
    spark = rows.sparkSession
    short = rows.where(F.col("length") < max_tokens)
    histogram = short.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    made = plan(dict(zip(histogram["length"].tolist(), histogram["n"].tolist())), max_tokens)
    opened = int((made["sequence"] + made["n"]).max()) if len(made) else 0
    keys = [made[c].to_numpy() for c in ("length", "first", "sequence", "offset")]
    sent = spark.sparkContext.broadcast(keys)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, sequences, offsets = sent.value
        start = np.searchsorted(lengths, np.arange(max_tokens + 1))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            # rows of the plan in order of (length, first): one search for both
            key = lengths * (1 << 44) + firsts
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            assert (at >= start[length]).all()
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(sequences[at] + rank - firsts[at]))
            yield out.append_column("offset", pa.array(offsets[at]))

    with_rank = ranked(short)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = [c for c in with_rank.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in order)
    placed = with_rank.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    whole = rows.where(F.col("length") >= max_tokens)
    # ids of whole sequences follow from the piece itself, above all planned ones
    names = [*order, "sequence_id", "offset"]
    alone = whole_ids(whole, opened).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(names).unionByName(alone.select(names))


def whole_ids(whole: DataFrame, after: int) -> DataFrame:
    """A sequence id for each row, above ``after``: its rank among the full ones."""
    return ranked(whole).withColumn("sequence_id", F.col("rank") + after).drop("rank")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places; tokens are made once."""
    return pack(materialise(pieces(docs, vocabulary, end_id, with_ids=with_ids), "pieces"))
