"""Words of texts as 64-bit hashes, for whole slices of rows at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from urlvane.llm.shared import mix, row_of, utf8

_ODD = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Runs of bytes other than white space (0x20, 0x09-0x0D), with A-Z lowered.

    hash: one number per word; start and end: its bytes; row: its row; first: each row's first word, and the end.
    """

    def __init__(self, column: pa.Array):
        self.data, offsets = utf8(column)
        solid = ~_SPACE[self.data]
        before = np.empty(len(solid), bool)
        before[1:] = solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(solid)]
        if len(solid):
            before[0] = False
            before[edges] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty(len(solid), bool)
        after[:-1] = solid[1:]
        if len(solid):
            after[-1] = False
            ends = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= len(solid))] - 1
            after[ends] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = row_of(self.first, len(self.start))
        power, inverse = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * power[:-1], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, a shorter row as one run, and the row of each."""
        sizes = np.diff(self.first)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        starts = np.flatnonzero(np.arange(len(self.row)) + n <= self.first[self.row + 1]) if len(self.row) else np.zeros(0, np.int64)
        total = np.zeros(len(starts), np.uint64)
        for i in range(n):
            total = mix(total + self.hash[starts + i])
        rows = self.row[starts]
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for at, row in enumerate(short):
                one = np.uint64(0)
                for h in self.hash[self.first[row]:self.first[row + 1]]:
                    one = mix(np.array([one + h + np.uint64(1)]))[0]
                extra[at] = one
            total, rows = np.concatenate([total, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            total, rows = total[order], rows[order]
        return total, rows


def distinct_per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and each row's first place among them, and the end. Rows must ascend."""
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [np.unique(values[cuts[i]:cuts[i + 1]]) for i in range(n_rows)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, n_rows)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])
