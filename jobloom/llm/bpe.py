"""Byte-level BPE encoding and decoding from a public tokenizer's merge list.

Each distinct pre-token of a batch is encoded once. Words of the same length form
a matrix: a contiguous row of part ids (the boundaries) and one of the ranks of
adjacent parts. Each round finds every row's minimum rank (the leftmost of equal
ones), deletes that boundary, and looks up the ranks to its left and right anew;
rows without a mergeable pair are done. Words beyond ``LONG`` bytes, for which
rescanning would be quadratic, take the minimum from a heap instead.

Rows are encoded where they lie: there is no shuffle, so skew of any column does
not matter. Memory is bounded by ``kernels.BATCH_BYTES`` (or one longer text).

Defined results: a null text is an empty one; an empty text has no ids and
decodes to an empty text; repeated rows are encoded each; extra columns pass.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import kernels
from jobloom.llm.kernels import ragged
from jobloom.llm.pretokens import Store

NONE = np.int32(2**31 - 1)
LONG = 256
TOKENIZER = "byte_bpe_50k.json"


def public_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and following."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(byte_characters())}
        size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        parts = [b""] * size
        for token, i in vocab.items():
            parts[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            parts[i] = token.encode()
        self.start, self.length, self.bytes = self._flat(parts)
        self.dec_start, self.dec_length, self.dec_bytes = self._flat([f"{i},".encode() for i in range(size)])
        self.of_byte = np.array([vocab[c] for c in byte_characters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        a, b = (np.array([vocab[p[i]] for p in pairs], np.uint64) for i in (0, 1))
        self.merged = np.array([vocab[p[0] + p[1]] for p in pairs], np.int32)
        self._table(a << np.uint64(32) | b)
        self.lookup: dict[tuple[int, int], int] = {}
        self._pairs = (a, b)

    @staticmethod
    def _flat(parts: list[bytes]):
        length = np.array([len(p) for p in parts], np.int64)
        return np.cumsum(length) - length, length, np.frombuffer(b"".join(parts), np.uint8)

    def _table(self, keys: np.ndarray) -> None:
        """A table of buckets of four for pairs; tries multipliers until no bucket overflows."""
        self.bits, k = 18, 0
        while True:
            self.by = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
            slot = keys * self.by >> np.uint64(64 - self.bits)
            order = np.argsort(slot, kind="stable")
            bounds = kernels.runs(slot[order])
            within = np.arange(len(keys)) - np.repeat(bounds[:-1], np.diff(bounds))
            if not len(keys) or within.max() < 4:
                break
            k += 1
        self.key = np.full((1 << self.bits, 4), 2**64 - 1, np.uint64)
        self.rank = np.full((1 << self.bits, 4), NONE, np.int32)
        self.key[slot[order], within] = keys[order]
        self.rank[slot[order], within] = order

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = (key * self.by >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        for i in range(4):
            hit = self.key[slot, i] == key
            np.copyto(out, self.rank[slot, i], where=hit)
        return out

    def _short(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of a matrix of equally long words, as they get done."""
        rows = np.arange(len(ids))
        n, width = ids.shape
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            if rank.shape[1] == 0:
                yield rows, ids
                return
            j = rank.argmin(1)
            i = np.arange(len(rows))
            best = rank[i, j]
            done = best == NONE
            if done.any():
                yield rows[done], ids[done]
                go = ~done
                rows, ids, rank, j, best = rows[go], ids[go], rank[go], j[go], best[go]
                if not len(rows):
                    return
                i = np.arange(len(rows))
            width = ids.shape[1]
            keep = np.ones(ids.shape, bool)
            keep[i, j + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            ids[i, j] = self.merged[best]
            keep = np.ones(rank.shape, bool)
            keep[i, j] = False
            rank = rank[keep].reshape(len(rows), width - 2)
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self.ranks(ids[left, j[left] - 1], ids[left, j[left]])
            right = np.flatnonzero(j < width - 2)
            rank[right, j[right]] = self.ranks(ids[right, j[right]], ids[right, j[right] + 1])

    def _long(self, word: np.ndarray) -> np.ndarray:
        """One word, with a heap of (rank, position) and links between parts."""
        if not self.lookup:
            self.lookup = {(int(x), int(y)): r for r, (x, y) in enumerate(zip(*self._pairs, strict=True))}
        ids = self.of_byte[word].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        get = self.lookup.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = after[i]
            if ids[i] != a or k < 0 or ids[k] != b:
                continue
            ids[i], ids[k] = int(self.merged[r]), -1
            after[i] = after[k]
            if after[k] >= 0:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[begin:end] one after another, and how many each has."""
        length = end - begin
        size = np.zeros(len(begin), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        names = {k.encode(): v for k, v in self.special.items()}
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            if n > LONG:
                for row in rows:
                    ids = self._long(data[begin[row] : end[row]])
                    size[row] = len(ids)
                    found.append((np.array([row]), ids[None]))
                continue
            matrix = data[begin[rows][:, None] + np.arange(n)]
            for name, i in names.items():
                if len(name) == n and (hit := (matrix == np.frombuffer(name, np.uint8)).all(1)).any():
                    size[rows[hit]] = 1
                    found.append((rows[hit], np.full((int(hit.sum()), 1), i, np.int32)))
                    rows, matrix = rows[~hit], matrix[~hit]
            for a in range(0, len(rows), 1 << 15):
                for own, ids in self._short(self.of_byte[matrix[a : a + (1 << 15)]]):
                    size[rows[a + own]] = ids.shape[1]
                    found.append((rows[a + own], ids))
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for rows, ids in found:
            out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the number of bytes of each."""
        n = self.length[ids]
        return self.bytes[ragged(self.start[ids], n)], n

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in decimal, each with a comma behind it, and the number of bytes of each."""
        n = self.dec_length[ids]
        return self.dec_bytes[ragged(self.dec_start[ids], n)], n


def encoder(path: str):
    """A function from an Arrow column of texts to (ids, ids a text), and its tables."""
    bpe = Bpe(path)
    store = Store(bpe.words)
    special = next(iter(bpe.special), None)
    if len(bpe.special) > 1:
        raise ValueError("more than one special token")

    def encode(col) -> tuple[np.ndarray, np.ndarray]:
        return store.batch(*kernels.column(col), special)

    return encode, bpe


def encode_decode(df: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids and the decoded text in place of ``text``.

    The columns added replace columns of the same name.
    """
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if with_ids else {})
    kept = [c for c in df.columns if c not in added and c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"{k} {v}" for k, v in added.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bpe = encoder(path)
        for batch in kernels.pieces(batches, text, 2 << 20):
            ids, count = encode(batch.column(text))
            bound = np.concatenate([[0], np.cumsum(count)])
            at = lambda n: np.concatenate([[0], np.cumsum(n)])[bound]  # noqa: E731, B023
            raw, n = bpe.decode(ids)
            ends = at(n)
            raw = raw.tobytes()
            decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            digits, n = bpe.decimals(ids)
            ends = at(n)
            digits = digits.tobytes()
            own = [hashlib.sha256(memoryview(digits)[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out = [batch.column(c) for c in kept] + [pa.array(count, pa.int64()), pa.array(own), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            if with_ids:
                out += [pa.ListArray.from_arrays(bound.astype(np.int32), pa.array(ids)), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(out, [*kept, *added])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(work, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_path())
