"""Terms of texts: runs of ASCII letters, digits and characters beyond ASCII, of which only A-Z are lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkernel import text_buffer, word_hashes

#: By UTF-8 byte: whether it belongs to a term, and itself in lower case.
TERM = np.zeros(256, dtype=bool)
TERM[128:] = True
for _first, _last in ("09", "AZ", "az"):
    TERM[ord(_first) : ord(_last) + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def bounds(term: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of each term, and each row's first term; a term ends where its row ends."""
    n = len(term)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = term[:-1], term[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(term & ~before)
    return start, np.flatnonzero(term & ~after) + 1, np.searchsorted(start, offsets)


class Terms:
    """The terms of a column of texts: `first` term of each row, 64-bit `hash` of each term."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        start, end, self.first = bounds(TERM[data], offsets)
        self.hash = word_hashes(LOWER[data], start, end)
        self.rows = len(offsets) - 1

    def counted(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of each distinct term of each row; only of `wanted` terms (sorted) if given."""
        row, term = np.repeat(np.arange(self.rows), np.diff(self.first)), self.hash.view(np.int64)
        if wanted is not None:
            at = np.searchsorted(wanted, term)
            keep = wanted[np.minimum(at, len(wanted) - 1)] == term if len(wanted) else np.zeros(len(term), bool)
            row, term = row[keep], term[keep]
        order = np.lexsort([term, row])
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(new)
        return row[first], term[first], np.diff(np.append(first, len(row)))
