"""Token ids in a binary file format: range coding driven by mixed id predictions.

Model. The ids that last followed the two previous ids (order 2) and the previous id
(order 1) are candidates, each with a confidence. Whether the candidate comes is
one binary decision; its probability mixes, in the logistic domain with weights
learned on the way, the hit rates of order 0 (all decisions), of order 1 and of
order 2 under their confidences. There are 128 cases of confidences, so the mixture is
worked out for each case, at the steps ``MIX``, not for each id. Other ids are coded with
adaptive order-0 frequencies: the counts in the block so far, brought up to date at the
steps ``COUNT``, or an escape, the number of bits of the id and these bits. A range coder
with a 48-bit interval turns the decisions into 16-bit words.

Blocks. Every ``BLOCK`` ids begin anew with an empty model, so blocks are read alone
and in any order. A block is a mark, the number of ids, the checksums of ids and
of code (begun from the number), and the code; a false checksum raises an error. The ids of a block are cut into
runs of at least ``RUN`` ids, its lanes, which share its model, have a range coder each and
advance together, one id at a time, as arrays; so do the lanes of ``GROUP`` blocks. The
code is the number of words of each lane, then the words of one lane after the other.

Table. A row per block (part, block, first, payload, docs) in Parquet, so the format
works on every file system that Spark writes to and a lost task leaves nothing
behind. Parts are ranges of doc_id in ascending order, blocks follow in order within
them, and ``docs`` names the documents of a block with their places.

Rows: null and empty texts are their end id alone. Documents of one id stand side by
side, in order of a hash of their text; null ids come first. Other columns are
ignored. An empty table makes an empty file. Ids are below 65536.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.tokens import encoder

BLOCK = 8192
GROUP = 128  # blocks that advance together
RUN = 64  # ids of a lane at least
MOST = 1 << 15  # ids of a block, for the precision of their shares
MARK = b"CMR2"
HEAD = "<4sIII"
HEAD_SIZE = struct.calcsize(HEAD)
SLOTS = 4096  # of a block's table of candidates
CASES = 128  # confidence of order 2, of order 1, whether both name one id
SIZES = 17  # bits of an id that escapes
MIX = frozenset((1, 2, 3, 4, 6, 8, 12, *range(16, 2 * RUN, 16)))  # steps
COUNT = frozenset((1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96))
FULL, LEAST, LOW_MASK = 1 << 48, 1 << 32, (1 << 32) - 1
DOCS = "docs array<struct<k: long, doc_id: long, at: long, n: int>>"
TABLE = f"part int, block int, first long, n_tokens int, payload binary, {DOCS}"

_x = np.arange(4096)
STRETCH = np.rint(256 * np.log((_x + 0.5) / (4095.5 - _x))).astype(np.int64)
SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-(_x - 2048) / 256))), 32, 4064).astype(np.int64)


class Lanes:
    """Runs of the blocks' ids, longest first. ``alive[k]`` lanes have more than ``k`` ids."""

    def __init__(self, sizes: list[int]):
        n = np.array(sizes, np.int64)
        self.of_block = np.maximum(n // RUN, 1)  # lanes
        block = np.repeat(np.arange(len(n)), self.of_block)
        place = np.arange(len(block)) - np.repeat(np.cumsum(self.of_block) - self.of_block, self.of_block)
        short, longer = np.divmod(n, self.of_block)
        begin = place * short[block] + np.minimum(place, longer[block]) + (np.cumsum(n) - n)[block]
        length = short[block] + (place < longer[block])
        self.order = np.argsort(-length, kind="stable")
        self.n, self.blocks, self.longest = len(block), len(n), int(length.max())
        self.block, self.begin, self.length = block[self.order], begin[self.order], length[self.order]
        self.alive = np.searchsorted(-self.length, -np.arange(self.longest), side="left").tolist()

    def present(self, x: np.ndarray, a: int, b: int) -> np.ndarray:
        """What the lanes have in ``x`` from step ``a`` to before ``b``."""
        if self.alive[b - 1] == self.n:
            return x[a:b].reshape(-1)
        return x[a:b][np.arange(a, b)[:, None] < self.length]

    def sums(self, steps: int) -> np.ndarray:
        """Ids of each block before a step."""
        return np.bincount(self.block, np.minimum(self.length, steps), self.blocks).astype(np.int64)


class Model:
    """What each block has learned. ``m`` lanes are still running.

    A slot holds a candidate id and, above its 16 bits, its confidence from 0 to 7.
    """

    def __init__(self, lanes: Lanes):
        self.m, self.blocks, self.block = lanes.n, lanes.blocks, lanes.block
        self.slot_base, self.case_base = ((lanes.block * n).astype(np.int32) for n in (SLOTS, CASES))
        self.slots1, self.slots2 = (np.zeros(lanes.blocks * SLOTS, np.int32) for _ in range(2))
        self.hits = np.zeros((2, lanes.blocks, 8, 8, 2), np.int64)  # of each case: all decisions, hits
        self.weight = np.full((3, lanes.blocks, 1, 1, 1), 22_000, np.int64)
        self.cases: list[np.ndarray] = []  # since the last mixing, those of hits in a second half
        self.sizes = np.ones((lanes.blocks, SIZES), np.int64)
        self._mixture()
        self.count(np.zeros(lanes.blocks, np.int64), np.zeros(lanes.blocks, np.int64))

    def shrink(self, m: int) -> None:
        self.m = m
        for name in ("block", "slot_base", "case_base", "known", "total", "before"):
            setattr(self, name, getattr(self, name)[:m])

    def look(self, prev1: np.ndarray, prev2: np.ndarray) -> None:
        """The candidate and its probability of coming, in 4096ths."""
        key = prev1 * np.int32(40503)  # 32 bits suffice: only low ones count
        self.at1 = ((key >> 4 & (SLOTS - 1)) + self.slot_base).astype(np.int64)
        self.at2 = ((key + prev2 * np.int32(30011) >> 5 & (SLOTS - 1)) + self.slot_base).astype(np.int64)
        self.s1, self.s2 = self.slots1.take(self.at1), self.slots2.take(self.at2)
        c1, c2 = self.s1 >> 16, self.s2 >> 16
        self.candidate = np.where(c2 > 0, self.s2, self.s1) & 0xFFFF
        same = (self.s1 ^ self.s2) & 0xFFFF == 0
        self.case = (c2 << 4 | c1 << 1 | same) + self.case_base
        self.p = self.mixed.take(self.case)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """A slot that several lanes of a block write keeps what the last of them wrote."""
        self.cases.append(self.case + hit * np.int32(self.blocks * CASES))
        fresh = ids | 1 << 16
        for at, own, slots in ((self.at1, self.s1, self.slots1), (self.at2, self.s2, self.slots2)):
            more = np.minimum(own + (1 << 16), own | 7 << 16)
            conf = own >> 16
            less = np.where(conf > 1, own - (conf + 1 >> 1 << 16), fresh)
            slots[at] = np.where((own ^ ids) & 0xFFFF == 0, more, less)

    def mix(self) -> None:
        """Brings hit rates, weights and the mixture up to date."""
        found = np.bincount(np.concatenate(self.cases), minlength=2 * self.blocks * CASES)
        self.cases = []
        found = found.reshape(2, self.blocks, 8, 8, 2)
        n = found[0] + found[1]
        err = (found[1] << 12) - n * self.mixed.reshape(n.shape)
        for k, s in enumerate(self.stretched):
            step = (err * s).sum(axis=(1, 2, 3), keepdims=True) >> 10
            self.weight[k] += np.clip(step, -3000, 3000)
        self.hits[0] += n
        self.hits[1] += found[1]
        self._mixture()

    def _mixture(self) -> None:
        self.stretched = []
        for over in ((2, 3, 4), (2,), (3, 4)):  # order 0, order 1, order 2
            n, hits = self.hits.sum(axis=over, keepdims=True)
            self.stretched.append(STRETCH.take(4096 * (2 * hits + 1) // (2 * n + 4)))
        (w0, w1, w2), (s0, s1, s2) = self.weight, self.stretched
        self.mixed = SQUASH.take((w0 * s0 + w1 * s1 + w2 * s2 >> 16) + 2048, mode="clip").reshape(-1)

    def note(self, blocks: np.ndarray, bits: np.ndarray) -> None:
        """Notes ids that escaped; the frequencies change at the next count."""
        self.sizes += np.bincount(blocks * SIZES + bits, minlength=self.sizes.size).reshape(self.sizes.shape)

    def count(self, n: np.ndarray, distinct: np.ndarray) -> None:
        """``n`` ids of each block are counted now, ``distinct`` ones among them."""
        self.known, self.before = n[self.block], (np.cumsum(n) - n)[self.block]
        self.total = self.known + np.maximum(distinct, 1)[self.block]  # the rest is the escape's
        self.size_of = self.sizes.copy()
        self.size_end = np.cumsum(self.size_of, axis=1)
        self._size_ends = (self.size_end + np.arange(self.blocks)[:, None] * 2 * MOST).reshape(-1)

    def size_at(self, blocks: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place, in all blocks' frequencies of sizes, whose share holds ``value``."""
        return np.searchsorted(self._size_ends, value + blocks * 2 * MOST, side="right")


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b below 2 ** 48, where a quotient of floats cannot be rounded up to the next integer."""
    return (a / b).astype(np.int64)


class Writer:
    """Range coder of all lanes: carries stay in the words and are resolved at the end."""

    def __init__(self, n: int, length: int):
        self.n = n
        self.low, self.range = np.zeros(n, np.int64), np.full(n, FULL, np.int64)
        self.words = np.empty((4 * length + 1) * n, np.uint32)  # a row for each place
        self.at = np.arange(n)

    def shift(self, m: int) -> None:
        """Put out a word of each of the first lanes that is due, those with a short interval."""
        low, span, at = self.low[:m], self.range[:m], self.at[:m]
        due = span < LEAST
        self.words[at] = (low >> 32).astype(np.uint32)  # stays only if due
        at += due * self.n
        low[:] = np.where(due, (low & LOW_MASK) << 16, low)
        span[:] = np.where(due, span << 16, span)
        self.shift_some(np.flatnonzero(span < LEAST))

    def shift_some(self, due: np.ndarray) -> None:
        if len(due):
            low, at = self.low.take(due), self.at.take(due)
            self.words[at] = low >> 32
            self.at[due] = at + self.n
            self.low[due] = (low & LOW_MASK) << 16
            self.range[due] <<= 16

    def narrow(self, lanes: np.ndarray, begin: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        """From ``begin``, ``size`` parts of ``total``."""
        part = _quotient(self.range.take(lanes), total)
        span = part * size
        self.low[lanes] += part * begin
        self.range[lanes] = span
        self.shift_some(lanes[span < LEAST])

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The words (a row per lane) and how many each lane has."""
        self.words[self.at] = self.low + LOW_MASK >> 32
        used = self.at // self.n + 1
        words = self.words.reshape(-1, self.n)[: int(used.max())]
        words *= np.arange(len(words))[:, None] < used
        for j in range(len(words) - 1, 0, -1):
            words[j - 1] += words[j] >> 16
        return words.T.astype("<u2"), used  # without the carries


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids; blocks are independent of each other."""
    return [code for a in range(0, len(blocks), GROUP) for code in _encode_group(blocks[a : a + GROUP])]


def _encode_group(blocks: list[np.ndarray]) -> list[bytes]:
    lanes = Lanes([len(b) for b in blocks])
    if max(map(len, blocks)) > MOST:
        raise ValueError(f"blocks of more than {MOST} ids do not fit the format")
    flat = np.concatenate(blocks).astype(np.int32)
    place = np.minimum(lanes.begin + np.arange(lanes.longest)[:, None], len(flat) - 1)
    ids = flat.take(place)
    # ranks of the ids among the distinct ones of all blocks
    width = int(flat.max()) + 1
    there = np.zeros(len(blocks) * width, bool)
    there[np.repeat(np.arange(len(blocks)) * width, [len(b) for b in blocks]) + flat] = True
    distinct = np.flatnonzero(there)
    rank = np.empty(len(there), np.int32)
    rank[distinct] = np.arange(len(distinct), dtype=np.int32)
    ranks = rank.take(ids + lanes.block * width, mode="clip")
    first = np.searchsorted(distinct, np.arange(len(blocks)) * width)  # rank of each block's first
    counts = np.zeros(len(distinct), np.int64)

    model, out = Model(lanes), Writer(lanes.n, lanes.longest)
    prev1 = prev2 = np.zeros(lanes.n, np.int32)
    counted, shares = 0, counts  # of each rank, its first place and its count
    for step in range(lanes.longest):
        m = lanes.alive[step]
        if m < model.m:
            model.shrink(m)
            prev1, prev2 = prev1[:m], prev2[:m]
        if step in MIX:
            model.mix()
        if step in COUNT:
            counts += np.bincount(lanes.present(ranks, counted, step), minlength=len(counts))
            model.count(lanes.sums(step), np.add.reduceat(counts > 0, first, dtype=np.int64))
            begins = np.cumsum(counts) - counts
            begins -= np.repeat(begins.take(first), np.diff(first, append=len(counts)))
            counted, shares = step, begins << 32 | counts
        own = shares.take(ranks[step, :m])
        size = own & LOW_MASK
        new = size == 0
        begin = np.where(new, model.known, own >> 32)
        size = np.where(new, model.total - model.known, size)
        now = ids[step, :m]
        model.look(prev1, prev2)
        hit = now == model.candidate
        span = out.range[:m]
        bound = (span >> 12) * model.p
        part = _quotient(span - bound, model.total)
        out.low[:m] += np.where(hit, 0, bound + part * begin)
        out.range[:m] = np.where(hit, bound, part * size)
        out.shift(m)
        new = np.flatnonzero(new & ~hit)
        if len(new):
            rest, block = now.take(new), model.block.take(new)
            bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
            at = block * SIZES + bits
            size = model.size_of.take(at)
            out.narrow(new, model.size_end.take(at) - size, size, model.size_end[:, -1].take(block))
            some = np.int64(1) << np.maximum(bits - 1, 0)
            out.narrow(new, rest & some - 1, np.ones_like(some), some)
            model.note(block, bits)
        model.learn(now, hit)
        prev1, prev2 = now, prev1
    words, used = out.finish()
    back = np.argsort(lanes.order)
    words, used = words[back], used[back]
    last = np.cumsum(lanes.of_block)
    written = np.arange(words.shape[1]) < used[:, None]
    found = []
    for b, a, z in zip(blocks, (last - lanes.of_block).tolist(), last.tolist()):
        code = used[a:z].astype("<u2").tobytes() + words[a:z][written[a:z]].tobytes()
        found.append(struct.pack(HEAD, MARK, len(b), zlib.crc32(b.astype("<u2").tobytes()), zlib.crc32(code, len(b))) + code)
    return found


class Reader:
    """Range decoder of all lanes."""

    def __init__(self, codes: list[np.ndarray], lanes: Lanes):
        self.n = lanes.n
        each = lanes.of_block.tolist()
        used = np.concatenate([c[:k] for c, k in zip(codes, each)]).astype(np.int64)
        stream = np.concatenate([c[k:] for c, k in zip(codes, each)])
        back = np.argsort(lanes.order)
        self.words = np.zeros((int(used.max()) + 4) * self.n, np.uint16)  # a row for each place
        place = np.arange(len(stream)) - np.repeat(np.cumsum(used) - used, used)
        self.words[place * self.n + np.repeat(back, used)] = stream
        self.at = np.arange(self.n)
        self.code, self.range = np.zeros(self.n, np.int64), np.full(self.n, FULL, np.int64)
        for _ in range(3):
            self.code = self.code << 16 | self.words.take(self.at)
            self.at += self.n

    def shift(self, m: int) -> None:
        """Take in a word for each of the first lanes that is due."""
        code, span, at = self.code[:m], self.range[:m], self.at[:m]
        due = span < LEAST
        code[:] = np.where(due, code << 16 | self.words.take(at), code)
        span[:] = np.where(due, span << 16, span)
        at += due * self.n
        self.shift_some(np.flatnonzero(span < LEAST))

    def shift_some(self, due: np.ndarray) -> None:
        if len(due):
            at = self.at.take(due)
            self.code[due] = self.code.take(due) << 16 | self.words.take(at)
            self.at[due] = at + self.n
            self.range[due] <<= 16

    def value(self, lanes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A part of ``total``, and which one comes."""
        part = _quotient(self.range.take(lanes), total)
        return part, np.minimum(_quotient(self.code.take(lanes), part), total - 1)

    def narrow(self, lanes: np.ndarray, part: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        span = part * size
        self.code[lanes] -= part * begin
        self.range[lanes] = span
        self.shift_some(lanes[span < LEAST])


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block."""
    return [ids for a in range(0, len(payloads), GROUP) for ids in _decode_group(payloads[a : a + GROUP])]


def _decode_group(payloads: list[bytes]) -> list[np.ndarray]:
    heads = [struct.unpack_from(HEAD, p) for p in payloads]
    for payload, (mark, n, _, check) in zip(payloads, heads):
        if mark != MARK or zlib.crc32(payload[HEAD_SIZE:], n) != check:
            raise ValueError("damaged block: its code does not fit its checksum")
    lanes = Lanes([h[1] for h in heads])
    code = Reader([np.frombuffer(p, "<u2", offset=HEAD_SIZE) for p in payloads], lanes)
    ids = np.zeros((lanes.longest, lanes.n), np.int32)
    model = Model(lanes)
    prev1 = prev2 = np.zeros(lanes.n, np.int32)
    above = (lanes.block << 16).astype(np.int32)
    table = np.zeros(1, np.int64)  # the counted ids in order, each with its count and its first place
    for step in range(lanes.longest):
        m = lanes.alive[step]
        if m < model.m:
            model.shrink(m)
            prev1, prev2 = prev1[:m], prev2[:m]
        if step in MIX:
            model.mix()
        if step in COUNT:
            keys = np.sort(lanes.present(above | ids[:step], 0, step))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts, keys = np.diff(starts, append=len(keys)), keys.take(starts).astype(np.int64)
            known = lanes.sums(step)
            model.count(known, np.bincount(keys >> 16, minlength=lanes.blocks))
            starts -= (np.cumsum(known) - known).take(keys >> 16)
            table = np.repeat(starts << 32 | counts << 16 | keys & 0xFFFF, counts)
        model.look(prev1, prev2)
        span = code.range[:m]
        bound = (span >> 12) * model.p
        rest = code.code[:m] - bound
        hit = rest < 0
        part = _quotient(span - bound, model.total)
        value = np.minimum(_quotient(np.maximum(rest, 0), part), model.total - 1)
        new = value >= model.known
        own = table.take(model.before + np.minimum(value, model.known - 1))
        begin = np.where(new, model.known, own >> 32)
        size = np.where(new, model.total - model.known, own >> 16 & 0xFFFF)
        code.code[:m] = np.where(hit, code.code[:m], rest - part * begin)
        code.range[:m] = np.where(hit, bound, part * size)
        code.shift(m)
        now = np.where(hit, model.candidate, own & 0xFFFF).astype(np.int32)
        new = np.flatnonzero(new & ~hit)
        if len(new):
            block = model.block.take(new)
            part, value = code.value(new, model.size_end[:, -1].take(block))
            at = model.size_at(block, value)
            bits = at - block * SIZES
            size = model.size_of.take(at)
            code.narrow(new, part, model.size_end.take(at) - size, size)
            some = np.int64(1) << np.maximum(bits - 1, 0)
            part, value = code.value(new, some)
            code.narrow(new, part, value, np.ones_like(value))
            now[new] = value + np.where(bits > 0, some, 0)
            model.note(block, bits)
        ids[step, :m] = now
        model.learn(now, hit)
        prev1, prev2 = now, prev1
    flat = np.empty(int(lanes.length.sum()), np.uint16)
    place = lanes.begin + np.arange(lanes.longest)[:, None]
    flat[lanes.present(place, 0, lanes.longest)] = lanes.present(ids, 0, lanes.longest)
    found = np.split(flat, np.cumsum([h[1] for h in heads])[:-1])
    for own, head in zip(found, heads):
        if zlib.crc32(own.astype("<u2").tobytes()) != head[2]:
            raise ValueError("damaged block: its ids do not fit their checksum")
    return found


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> None:
    """Encode the whole texts of (doc_id, text) in ascending doc_id order into ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, end = encoder("spaced", vocabulary).encode, np.uint32(end_id).tobytes()
        texts: list[np.ndarray] = []  # ids not yet written
        places: list[list] = []  # (k, doc_id, place in the document, how many) of them
        held = k = block = first = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal texts, places, held, block, first
            stream = np.concatenate(texts)
            take = len(stream) if last else len(stream) // BLOCK * BLOCK
            blocks = [stream[a : min(a + BLOCK, take)] for a in range(0, take, BLOCK)]
            docs_of: list[list] = [[] for _ in blocks]
            at, left = 0, []
            for doc, doc_id, place, n in places:
                while n:
                    if at >= take:
                        left.append([doc, doc_id, place, n])
                        break
                    now = min(n, min((at // BLOCK + 1) * BLOCK, take) - at)
                    docs_of[at // BLOCK].append({"k": doc, "doc_id": doc_id, "at": place, "n": now})
                    at, place, n = at + now, place + now, n - now
            rows = [pa.array([part] * len(blocks), pa.int32())]
            rows.append(pa.array(range(block, block + len(blocks)), pa.int32()))
            rows.append(pa.array(range(first, first + take, BLOCK), pa.int64()))
            rows.append(pa.array(map(len, blocks), pa.int32()))
            rows.append(pa.array(encode_blocks(blocks), pa.binary()))
            kind = pa.list_(pa.struct([("k", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32())]))
            rows.append(pa.array(docs_of, kind))
            block, first = block + len(blocks), first + take
            texts, places = [stream[take:]], left
            held = len(stream) - take
            yield pa.RecordBatch.from_arrays(rows, ["part", "block", "first", "n_tokens", "payload", "docs"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encode(text.as_py() or "") + end, "<u4")
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids of 65536 and more do not fit the format")
                texts.append(ids.astype(np.uint16))
                places.append([k, doc_id, 0, len(ids)])
                k += 1
                held += len(ids)
                if held >= GROUP * BLOCK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(run, TABLE).write.parquet(folder)


def read_ids(spark, folder: str) -> DataFrame:
    """(part, k, doc_id, at, first, ids): a run of ids for each block that a document touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                some = batch.slice(a, GROUP)
                blocks = decode_blocks(some.column("payload").to_pylist())
                rows = []
                for ids, part, first, places in zip(
                    blocks, some.column("part").to_pylist(), some.column("first").to_pylist(), some.column("docs").to_pylist()
                ):
                    at = 0
                    for x in places:
                        rows.append((part, x["k"], x["doc_id"], x["at"], first + at, ids[at : at + x["n"]]))
                        at += x["n"]
                kinds = [pa.int32(), *[pa.int64()] * 4]
                columns = list(zip(*rows))
                flat = pa.array(np.concatenate(columns[5]).astype(np.int32))
                ends = pa.array(np.cumsum([0, *map(len, columns[5])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.ListArray.from_arrays(ends, flat)],
                    ["part", "k", "doc_id", "at", "first", "ids"],
                )

    table = spark.read.parquet(folder).select("part", "first", "payload", "docs")
    return table.mapInArrow(run, "part int, k long, doc_id long, at long, first long, ids array<int>")


def joined_crc(before: int, crc: int, n: int) -> int:
    """crc32 of a followed by b, from those of a and b, b having ``n`` ids of four bytes."""
    blank = bytes(4 * n)
    return zlib.crc32(blank, before) ^ zlib.crc32(blank) ^ crc


def digest(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                some = batch.slice(a, GROUP)
                blocks = decode_blocks(some.column("payload").to_pylist())
                rows = []
                for ids, part, first, places in zip(
                    blocks, some.column("part").to_pylist(), some.column("first").to_pylist(), some.column("docs").to_pylist()
                ):
                    raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                    for x in places:
                        crc = zlib.crc32(raw[4 * at : 4 * (at + x["n"])])
                        rows.append((part, x["k"], x["doc_id"], x["at"], first + at, x["n"], crc))
                        at += x["n"]
                kinds = [pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "k", "doc_id", "at", "first", "n", "crc"]
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for runs in batch.column("runs").to_pylist():
                total = 0
                for x in sorted(runs, key=lambda x: x["at"]):
                    total = joined_crc(total, x["crc"], x["n"]) if x["at"] else x["crc"]
                crcs.append(total)
            yield batch.drop_columns(["runs"]).append_column("ids_crc32", pa.array(crcs, pa.int64()))

    table = spark.read.parquet(folder)
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    runs = table.select("part", "first", "payload", "docs").mapInArrow(
        run, "part int, k long, doc_id long, at long, first long, n long, crc long"
    )
    docs = runs.groupBy("part", "k").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("at", "n", "crc")).alias("runs"),  # one for each block of a document
    )
    docs = docs.join(starts, "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "runs")
    return docs.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
