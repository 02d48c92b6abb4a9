"""Whole-batch numpy kernels on UTF-8 bytes: words, hashes of byte ranges, ragged copies.

A batch is one byte array with document offsets, as Arrow keeps it. Hashes of
ranges come from prefix sums of a polynomial over a random byte table modulo
2**64, so the hash of any byte range costs two look-ups; they depend on the
bytes alone, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that a kernel call handles at most, apart from a single longer document.
BATCH_BYTES = 3 << 20
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: Like BYTE_TABLE, with A-Z as a-z.
FOLDED_TABLE = BYTE_TABLE.copy()
FOLDED_TABLE[65:91] = BYTE_TABLE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BATCH_BYTES + 1)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (_BASE, _INVERSE))
        if size <= 4 * BATCH_BYTES:
            _POWERS[0] = have
    return have


class Hashes:
    """Hashes of byte ranges of one array."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_TABLE):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        terms = table[data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.down[start]
        h += (end - start).astype(U) * U(0xA24BAED4963EE407)
        return mix(h)

    def rolling(self, width: int) -> np.ndarray:
        """Of every range of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        h = self.sums[width:] - self.sums[:-width]
        h *= self.down[:n]
        return mix(h)


def column(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = column(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each document the number of words before it."""
    is_word = ~SPACE[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = is_word[edge]
    last[edge - 1] = is_word[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[i], start[i]+1, ... start[i]+length[i]-1 for all i, one after another."""
    length = length.astype(np.int64, copy=False)
    total = int(length.sum())
    kind = np.int32 if total < 2**31 and (not len(start) or int(start.max()) < 2**31 - 1) else np.int64
    out = np.ones(total, kind)
    some = np.flatnonzero(length)
    if not len(some):
        return out
    s, n = start[some].astype(np.int64), length[some]
    jump = s.copy()
    jump[1:] -= s[:-1] + n[:-1] - 1
    out[np.cumsum(n) - n] = jump
    return np.cumsum(out, out=out, dtype=kind)


def runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal neighbours: 0, ..., len(keys)."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def split_by(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that occurs: its number and the rows in it, in their order."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def groups(batches: Iterator[pa.RecordBatch], key: str = "part") -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each part, from batches sorted by part."""
    now, held = None, []
    for batch in batches:
        for p, blob in zip(batch.column(key).to_pylist(), batch.column("blob"), strict=True):
            if p != now:
                if held:
                    yield now, held
                now, held = p, []
            held.append(blob.as_py())
    if held:
        yield now, held
