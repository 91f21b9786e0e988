"""Vectorised word hashing on Arrow text buffers.

Words are the runs of `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes. Every function works on a
whole column of texts at once, so that cost per word is a few numpy operations; scratch
memory is bounded by `BLOCK` bytes of text, not by the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; scratch arrays are eight times that.
BLOCK = 1 << 18

_MASK = (1 << 64) - 1
#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a column of texts: `start` and `end` in `data`, `first` word of each row, 64-bit `hash`."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, offsets = text_buffer(column)
        data = self.data
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = np.where(upper, data + 32, data).astype(np.uint8)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[:-1] = word
        edge[-1] = False
        edge[1:] ^= word
        # rows touch without a space between them: a word ends where its row ends
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = inner[word[inner - 1] & word[inner]] if len(inner) else inner
        at = np.flatnonzero(edge)
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.rows = len(offsets) - 1
        self.lowered = data
        self.hash = word_hashes(data, self.start, self.end)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words at which a run of k words of one row starts, and the runs' hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(n) + k <= last)
        total = np.zeros(n - k + 1, dtype=np.uint64)
        step = 1
        for j in range(k):
            total += self.hash[j : n - k + 1 + j] * np.uint64(step)
            step = step * _STEP & _MASK
        return at, mix(total[at] + np.uint64(k))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, from prefix sums over blocks of the text."""
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    size = min(BLOCK, int(end[-1] - start[0])) + 1
    up, down = _powers(_BASE, size), _powers(_UNBASE, size)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + size - 1, side="right"))
        if j <= i:  # one word beyond a block
            out[i] = _long_word(data[start[i] : end[i]], up)
            i += 1
            continue
        low = start[i]
        part = data[low : end[j - 1]].astype(np.uint64) + np.uint64(1)
        part *= up[: len(part)]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def _long_word(word: np.ndarray, up: np.ndarray) -> int:
    total, size = 0, len(up)
    for at in range(0, len(word), size):
        part = word[at : at + size].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return total & _MASK


def slices(column: pa.Array, limit: int = 1 << 20):
    """Row ranges of a string column of about `limit` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    i, n = 0, len(sizes)
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
