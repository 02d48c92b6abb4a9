"""Burrows-Wheeler transform and common prefixes of many strings, built column by column.

Each round inserts one symbol of every string, from its last to its first: the
suffix that a string has reached is put at its place among all suffixes so far,
which follows from the symbol's rank in the transform, and its common prefixes
with its two neighbours follow from the minima between the symbol's last and
next occurrences. Transform and prefixes lie in files; each round reads the old
pair sequentially and writes the new pair sequentially.
"""

from __future__ import annotations

import tempfile

import numpy as np

from jobloom.llm.kernels import ragged


class _Pair:
    """Two files of bytes, one read and one written in each round."""

    def __init__(self, folder: str, name: str, size: int):
        self.files = [np.memmap(f"{folder}/{name}{i}", np.uint8, "w+", shape=max(1, size)) for i in (0, 1)]
        self.n = 0

    def now(self) -> np.ndarray:
        return self.files[0][: self.n]

    def merge(self, at: np.ndarray, values: np.ndarray, free: np.ndarray) -> None:
        n = self.n + len(at)
        new = self.files[1][:n]
        new[free] = self.files[0][: self.n]
        new[at] = values
        self.files.reverse()
        self.n = n


def collection(data: np.ndarray, start: np.ndarray, length: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings data[start:start+length]: for each place among the sorted suffixes its string, its offset, and its common prefix with the place before (at most ``cap``, which must be below 256)."""
    count = len(start)
    order = np.argsort(-length, kind="stable")  # longest first: the strings still active are a prefix
    start, length = start[order], length[order]
    used = np.flatnonzero(np.bincount(data, minlength=256)[:256])
    symbol = np.zeros(256, np.uint8)
    if len(used) > 255:
        raise ValueError("256 different bytes in one collection")
    symbol[used] = np.arange(1, len(used) + 1)
    total = int(length.sum()) + count
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = _Pair(folder, "bwt", total), _Pair(folder, "lcp", total)
        active = int((length > 0).sum())
        first = np.zeros(count, np.uint8)
        first[:active] = symbol[data[start[:active] + length[:active] - 1]]
        bwt.merge(np.arange(count), first, np.zeros(0, np.int64))
        lcp.merge(np.arange(count), np.zeros(count, np.uint8), np.zeros(0, np.int64))
        place, owner = np.arange(active), np.arange(active)  # of the newest suffixes, by place
        for j in range(1, int(length[0]) + 1 if count else 0):
            b, pre = bwt.now(), lcp.now()
            n = len(b)
            by_symbol = np.argsort(b, kind="stable")
            newest = np.zeros(n, bool)
            newest[place] = True
            where = np.flatnonzero(newest[by_symbol])
            place = by_symbol[where]
            # Owners in order of (symbol, place).
            sym = b[np.sort(place)]
            owner = owner[np.argsort(sym, kind="stable")]
            own = b[place]
            zeros = int(np.searchsorted(b[by_symbol[:count]], 1)) if n else 0
            at = count + where - zeros
            # Common prefix with the symbol's occurrence before, and of the next occurrence with this one.
            before = by_symbol[np.maximum(where - 1, 0)]
            has = (where > 0) & (b[before] == own)
            mine = np.zeros(len(where), np.int64)
            mine[has] = 1 + _minima(pre, before[has] + 1, place[has] + 1)
            nxt = by_symbol[np.minimum(where + 1, n - 1)]
            follows = (where < n - 1) & (b[nxt] == own) & ~newest[nxt]
            theirs = 1 + _minima(pre, place[follows] + 1, nxt[follows] + 1)
            free = np.ones(n + len(at), bool)
            free[at] = False
            # The next symbols; a string that has ended gives the end mark.
            left = length[owner] - j
            value = np.where(left > 0, symbol[data[start[owner] + np.maximum(left - 1, 0)]], 0).astype(np.uint8)
            bwt.merge(at, value, free)
            lcp.merge(at, np.minimum(mine, cap).astype(np.uint8), free)
            lcp.now()[at[follows] + 1] = np.minimum(theirs, cap)
            go = left > 0
            place, owner = at[go], owner[go]
        b, pre = bwt.now(), np.array(lcp.now())
        by_symbol = np.argsort(b, kind="stable")
        step = np.empty(len(b), np.int64)
        step[by_symbol] = np.arange(len(b))
        step += count - int((b == 0).sum())
        string, offset = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
        at, alive = np.arange(count), np.arange(count)
        for j in range(int(length[0]) + 1 if count else 0):
            string[at], offset[at] = order[alive], length[alive] - j
            go = length[alive] > j
            at, alive = step[at[go]], alive[go]
    return string, offset, pre


def _minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[start:end] for each range (none is empty)."""
    if not len(start):
        return np.zeros(0, np.int64)
    size = end - start
    return np.minimum.reduceat(values[ragged(start, size)], np.cumsum(size) - size).astype(np.int64)
