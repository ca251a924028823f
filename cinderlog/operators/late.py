"""Late interaction of token matrices: the dense kernels.

Similarities are computed in tiles that stay in a core's cache: some test templates
with all their tokens against one token of each of some bank templates at a time, the
maximum taken in place. Templates of unlike length are put beside others of like
length and filled up: a test template with zero vectors, which add nothing, a bank
template with copies of its first token, which change no maximum.

``Best`` needs the largest similarity alone: tiles in single precision, with a
bound of their rounding, tell which pairs may be the largest, and only those
are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

TILE_TOKENS, TILE_BANK = 128, 256
PAIR_FLOATS = 1_000_000  # of single pairs computed at once

Unit = Callable[[np.ndarray], np.ndarray]


class Matrices:
    """Templates with their token vectors, by number of tokens."""

    def __init__(self, parts: list[pa.RecordBatch], unit: Unit):
        counts = np.concatenate([p.column("tokens").to_numpy() for p in parts]).astype(np.int64)
        flat = np.concatenate(
            [p.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64) for p in parts]
        )
        self.tokens = unit(flat.reshape(int(counts.sum()), -1))
        # one more, of zeros, fills up
        self.tokens = np.vstack([self.tokens, np.zeros((1, self.tokens.shape[1]))])
        self.order = np.argsort(counts, kind="stable")
        self.counts, self.starts = counts[self.order], (np.cumsum(counts) - counts)[self.order]

    def __len__(self) -> int:
        return len(self.counts)

    def padded(self, rows, copies: bool) -> np.ndarray:
        """[row, token, dimension], filled up with copies of the first token or with zeros."""
        counts, starts = self.counts[rows][:, None], self.starts[rows][:, None]
        slot = np.arange(max(1, int(counts.max(initial=0))))[None, :]
        fill = np.where(counts > 0, starts, len(self.tokens) - 1) if copies else len(self.tokens) - 1
        return self.tokens[np.where(slot < counts, starts + slot, fill)]


class Tiles:
    """A block's test templates, cut for ``dtype``; gives their similarities to a chunk."""

    def __init__(self, test: Matrices, dtype: type):
        self.dtype, self.parts = dtype, []
        at = 0
        while at < len(test):
            n = max(1, TILE_TOKENS // max(1, int(test.counts[at])))
            n = max(1, min(n, TILE_TOKENS // max(1, int(test.counts[min(at + n, len(test)) - 1]))))
            rows = slice(at, min(at + n, len(test)))
            whole = test.padded(rows, copies=False)
            self.parts.append((rows, whole.shape[1], whole.reshape(-1, whole.shape[2]).astype(dtype)))
            at = rows.stop

    def met(self, bank: Matrices) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(test rows, bank rows, similarities), tile by tile."""
        for at in range(0, len(bank), TILE_BANK):
            chunk = slice(at, min(at + TILE_BANK, len(bank)))
            by_token = np.ascontiguousarray(bank.padded(chunk, copies=True).transpose(1, 2, 0).astype(self.dtype))
            width = chunk.stop - chunk.start
            for rows, n_tokens, mine in self.parts:
                most = mine @ by_token[0]
                one = np.empty_like(most)
                for other in by_token[1:]:
                    np.matmul(mine, other, out=one)
                    np.maximum(most, one, out=most)
                yield rows, chunk, most.reshape(-1, n_tokens, width).sum(axis=1)


def _ids(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([p.column("id").to_numpy() for p in parts])


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


class All:
    """Largest, sum and number of the similarities of every test template to the bank."""

    SCHEMA = "test_id long, best double, total double, n long"

    def __init__(self, parts: list[pa.RecordBatch], unit: Unit):
        self.unit, test = unit, Matrices(parts, unit)
        self.ids, self.tiles = _ids(parts)[test.order], Tiles(test, np.float64)
        self.best, self.total = np.full(len(test), -np.inf), np.zeros(len(test))
        self.n = 0

    def meet(self, part: pa.RecordBatch) -> None:
        bank = Matrices([part], self.unit)
        self.n += len(bank)
        for rows, _, sims in self.tiles.met(bank):
            np.maximum(self.best[rows], sims.max(axis=1), out=self.best[rows])
            self.total[rows] += sims.sum(axis=1)

    def found(self) -> Iterator[pa.RecordBatch]:
        yield _batch(self.SCHEMA, self.ids, self.best, self.total, np.full(len(self.ids), self.n))


def pairs_of(test: Matrices, i: np.ndarray, bank: Matrices, j: np.ndarray) -> np.ndarray:
    """The similarity of single pairs."""
    out = np.empty(len(i))
    # pairs of like size together
    order = np.lexsort((bank.counts[j], test.counts[i]))
    largest = int(test.counts.max(initial=1)), int(bank.counts.max(initial=1))
    at = 0
    while at < len(order):
        width, (most, theirs) = test.tokens.shape[1], largest
        each = max(1, width * (most + theirs) + most * theirs)
        now = order[at : at + max(1, PAIR_FLOATS // each)]
        sims = test.padded(i[now], copies=False) @ bank.padded(j[now], copies=True).transpose(0, 2, 1)
        out[now] = sims.max(axis=2).sum(axis=1)
        at += len(now)
    return out


class Best:
    """The largest similarity of every test template, and of how many pairs it was computed."""

    SCHEMA = "test_id long, best double, pairs long, computed long"

    def __init__(self, parts: list[pa.RecordBatch], unit: Unit):
        self.unit, self.test = unit, Matrices(parts, unit)
        self.ids, self.tiles = _ids(parts)[self.test.order], Tiles(self.test, np.float32)
        self.best = np.full(len(self.test), -np.inf)
        self.computed = np.zeros(len(self.test), np.int64)
        self.pairs = 0
        # rounding of a similarity, but for the largest norm of a bank token: inputs,
        # products and sums each are off by one part in 2**24 at most; twice that here
        norms = np.append(np.linalg.norm(self.test.tokens, axis=1), 0)
        ends = self.test.starts + self.test.counts
        total = np.concatenate([[0], np.cumsum(norms)])
        steps = self.test.tokens.shape[1] + self.test.counts + 8
        self.norms = total[ends] - total[self.test.starts]
        self.slack = 2.0**-23 * steps * self.norms

    def meet(self, part: pa.RecordBatch) -> None:
        bank = Matrices([part], self.unit)
        self.pairs += len(bank)
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.linalg.norm(bank.tokens, axis=1).max()
            # the last term is for numbers too small for single precision
            slack = self.slack * size + 1e-35 * (1 + size + self.norms)
        # beyond what single precision holds every pair is computed
        rough = bool(np.isfinite(slack).all()) and slack.max(initial=0) < 1e25
        least = self.best.copy()  # no test template's best is below
        some: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not rough:
            for i in range(len(self.test)):
                self._computed(bank, np.full(len(bank), i), np.arange(len(bank)))
            return
        for rows, chunk, sims in self.tiles.met(bank):
            top = sims.max(axis=1).astype(np.float64)
            np.maximum(least[rows], top - slack[rows], out=least[rows])
            near = np.flatnonzero(top + slack[rows] >= least[rows])
            if len(near):
                at = rows.start + near
                i, j = np.nonzero(sims[near] >= (least[at] - slack[at])[:, None])
                some.append((at[i], chunk.start + j, sims[near[i], j].astype(np.float64)))
        if some:
            i, j, sims = (np.concatenate(x) for x in zip(*some))
            may = sims + slack[i] >= least[i]  # the bound has risen since
            self._computed(bank, i[may], j[may])

    def _computed(self, bank: Matrices, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.computed, i, 1)
        np.maximum.at(self.best, i, pairs_of(self.test, i, bank, j))

    def found(self) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        yield _batch(self.SCHEMA, self.ids, self.best, np.full(n, self.pairs), self.computed)


class Chosen(All):
    """As ``All``, but a bank row comes with the ids of the test templates that want it."""

    def __init__(self, parts: list[pa.RecordBatch], unit: Unit):
        self.unit, self.test = unit, Matrices(parts, unit)
        self.ids = _ids(parts)[self.test.order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.best, self.total = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids))
        self.n = np.zeros(len(self.ids), np.int64)

    def meet(self, part: pa.RecordBatch) -> None:
        bank = Matrices([part], self.unit)
        wanting = part.column("wanting").take(pa.array(bank.order))
        ids = wanting.flatten().to_numpy()
        row = np.repeat(np.arange(len(bank)), wanting.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        sorted_ids = self.ids[self.by_id]
        first = np.searchsorted(sorted_ids, ids, "left")
        # an id may stand for several rows of the block
        copies = np.searchsorted(sorted_ids, ids, "right") - first
        place = np.repeat(first, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        i, j = self.by_id[place], np.repeat(row, copies)
        for at in range(0, len(i), PAIR_FLOATS):
            mine, theirs = i[at : at + PAIR_FLOATS], j[at : at + PAIR_FLOATS]
            sims = pairs_of(self.test, mine, bank, theirs)
            np.maximum.at(self.best, mine, sims)
            np.add.at(self.total, mine, sims)
            np.add.at(self.n, mine, 1)

    def found(self) -> Iterator[pa.RecordBatch]:
        some = self.n > 0
        yield _batch(self.SCHEMA, self.ids[some], self.best[some], self.total[some], self.n[some])
