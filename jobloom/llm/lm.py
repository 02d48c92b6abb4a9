"""Scores of an interpolated modified Kneser-Ney n-gram model that is counted in Spark.

Tokens are words (A-Z lower-cased) and one end of text; a text's first tokens
follow begin marks. Tokens are 64-bit hashes of their bytes. ``ORDER`` is the
default length of n-grams; any other is a parameter.

Counting: a task counts the n-grams of many batches together, deals them by the
hash of the whole n-gram, and a task sums a part: neither a hot word nor a hot
context is one task's work, and a hot n-gram is one row a flush. Parts are
written as sorted hash arrays (hash, count). Each part hands on, in one exchange,
what it knows of contexts (total, and numbers of successors seen once, twice,
more often), dealt by context, and of the n-grams without their first token
(different predecessors and raw count), dealt by their hash: the next level is
counted from these in the same way, down to words. Discounts come from counts of
counts, of which each part gives four numbers.

Scoring: workers map the arrays into memory, look up a batch's distinct n-grams
in sorted order, level by level, and add up log probabilities by document;
nothing is gathered on the driver but a few sums. Mounted shared folders are
mapped in place, page by page; files of other stores are copied to the worker
when a batch first asks for one.

Defined results: a null text is empty, its only token the end; a null doc_id
counts as an empty id; repeated rows are scored (and learned from) each; extra
columns are ignored; without training texts every token has probability 1; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import kernels, shared
from jobloom.llm.kernels import FOLDED_TABLE, U, mix

BEGIN, END = U(0x1234567), U(0x89ABCDEF01)
FOLDS, HELD_OUT = 7, 2
ORDER = 2
#: Tokens for which a part of the arrays is made; n-grams that a counting task holds before it deals them out.
PART_TOKENS, HELD = 1_500_000, 1_000_000


def tokens(data: np.ndarray, off: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each token the n-gram that ends in it, as ``order`` columns, and bounds by document."""
    begin, end, first = kernels.words(data, off)
    h = kernels.Hashes(data, FOLDED_TABLE).of(begin, end)
    token = np.insert(h, first[1:], END)
    bound = first + np.arange(len(first))
    columns = [token]
    for _ in range(order - 1):
        before = np.empty_like(token)
        before[1:] = columns[0][:-1]
        before[bound[:-1]] = BEGIN
        columns.insert(0, before)
    return columns, bound


def pair_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) ^ token)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams; of one column the token's own."""
    h = columns[0]
    for c in columns[1:]:
        h = pair_hash(h, c)
    return h


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


_ZSTD = pa.Codec("zstd", compression_level=1)


def _summed(key: np.ndarray, columns: list[np.ndarray], *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Different keys in order, their columns, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    bounds = kernels.runs(key[order])[:-1]
    first = order[bounds]
    return key[first], [c[first] for c in columns], [np.add.reduceat(v[order], bounds) if len(bounds) else v[:0] for v in values]


def _dealt(to: np.ndarray, parts: int, shift: int, **arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Blobs of the rows that go to each part (numbers from ``shift``); the first array, if its values repeat, as runs."""
    rows = []
    for p, own in kernels.split_by(to, parts):
        name, *rest = arrays
        head = arrays[name][own]
        order = np.argsort(head, kind="stable")
        own, head = own[order], head[order]
        runs = kernels.runs(head)
        blob = shared.pack(**{name: head[runs[:-1]], "size": small(np.diff(runs))}, **{k: (arrays[k][own] if arrays[k].dtype == U else small(arrays[k][own])) for k in rest})
        rows.append((shift + p, np.uint32(len(blob)).tobytes() + _ZSTD.compress(blob, asbytes=True)))
    return rows


def _read(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The arrays of a part's blobs one after another, runs written out."""
    found = [shared.unpack(_ZSTD.decompress(b[4:], int(np.frombuffer(b[:4], np.uint32)[0]), asbytes=True)) for b in blobs]
    names = [k for k in found[0] if k != "size"]
    out = {names[0]: np.concatenate([np.repeat(x[names[0]], x["size"].astype(np.int64)) for x in found])}
    for k in names[1:]:
        out[k] = np.concatenate([x[k] if x[k].dtype == U else x[k].astype(np.int64) for x in found])
    return out


def _count(parts: int, order: int):
    """Rows (part, blob): counts of the batches' n-grams, put together as far as memory is meant for it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def dealt() -> pa.RecordBatch:
            key, columns, counts = (held[0][0], held[0][1], [held[0][2]]) if len(held) == 1 else _summed(np.concatenate([x[0] for x in held]), [np.concatenate(c) for c in zip(*(x[1] for x in held), strict=True)], np.concatenate([x[2] for x in held]))
            held.clear()
            return _blobs(_dealt(part_of(key, parts), parts, 0, **{f"t{i}": c for i, c in enumerate(columns)}, count=counts[0]))

        for batch in kernels.pieces(batches, "text"):
            columns, _ = tokens(*kernels.column(batch.column("text")), order)
            key, columns, counts = _summed(gram_hash(columns), columns, np.ones(len(columns[0]), np.int64))
            held.append((key, columns, counts[0]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield dealt()
        if held:
            yield dealt()

    return work


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _contexts(at: str, level: int, part: int, blobs: list[bytes]) -> None:
    """Sum what is known of a part's contexts and write it."""
    x = _read(blobs)
    key, _, sums = _summed(x["context"], [], *(x[k] for k in ("total", "ones", "twos", "more")))
    shared.put(f"{at}/contexts{level}/{part:08d}", shared.pack(context=key, **dict(zip(("total", "ones", "twos", "more"), map(small, sums), strict=True))))


def _level(at: str, parts: int, level: int, top: bool):
    """Sum a part's n-grams of ``level`` tokens, write their arrays, and hand on contexts (parts from ``parts``), the n-grams one shorter, and counts of counts (parts below 0)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in kernels.groups(batches):
            if part < 0:
                yield _blobs([(part, b) for b in blobs])
                continue
            if part >= parts:
                _contexts(at, level + 1, part - parts, blobs)
                continue
            x = _read(blobs)
            columns = [x[f"t{i}"] for i in range(level)]
            key, columns, (count, raw) = _summed(gram_hash(columns), columns, x["count"], x["count" if top else "raw"])
            shared.put(f"{at}/grams{level}/{part:08d}", shared.pack(key=key, count=small(count)))
            context, _, sums = _summed(gram_hash(columns[:-1]), [], count, *((count == k).astype(np.int64) for k in (1, 2)), (count > 2).astype(np.int64))
            rows = _dealt(part_of(context, parts), parts, parts, context=context, **dict(zip(("total", "ones", "twos", "more"), sums, strict=True)))
            low, columns, (types, raw) = _summed(gram_hash(columns[1:]), columns[1:], np.ones(len(key), np.int64), raw)
            rows += _dealt(part_of(low, parts), parts, 0, **{f"t{i}": c for i, c in enumerate(columns)}, count=types, raw=raw)
            yield _blobs([*rows, (-1 - part % 64, shared.pack(level=np.array([level]), stats=np.array(_of_counts(count))))])

    return work


_SUMS = "level int, words long, raw long, types long, n1 long, n2 long, n3 long, n4 long"


def _words(at: str, parts: int, order: int):
    """Sum a part's words and write them. Rows: by level, the sums that discounts and totals need."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in kernels.groups(batches):
            if part >= parts:
                _contexts(at, 2, part - parts, blobs)
                continue
            if part < 0:
                rows = [[int(x["level"][0]), 0, 0, 0, *x["stats"].tolist()] for x in map(shared.unpack, blobs)]
            else:
                x = _read(blobs)
                word, _, (types, raw) = _summed(x["t0"], [], x["count"], x["raw" if order > 1 else "count"])
                shared.put(f"{at}/words/{part:08d}", shared.pack(word=word, types=small(types), raw=small(raw)))
                rows = [[1, len(word), int(raw.sum()), int(types.sum()), *_of_counts(types)]]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], [x.split()[0] for x in _SUMS.split(", ")])

    return work


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) of modified Kneser-Ney smoothing from n1..n4; never so small that an unseen token would be impossible."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d = [0.0] + [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.clip(d, [0.0, 0.01, 0.01, 0.01], [0.0, 0.999, 1.999, 2.999])


class Arrays:
    """The model's files, mapped when first asked for."""

    def __init__(self, at: str, parts: int, order: int, sums: dict[int, list[int]]):
        self.at, self.parts, self.order, self.files = at, parts, order, {}
        none = [0] * 7
        self.vocabulary, self.total, self.types, *ones = sums.get(1, none)
        self.discounts = {level: discounts(sums.get(level, none)[3:]) for level in range(1, order + 1)}
        rest = self.vocabulary - ones[0] - ones[1]
        self.left = (self.discounts[1][1:] @ [ones[0], ones[1], rest]) / self.types if self.types else 1.0

    def part(self, kind: str, p: int) -> dict[str, np.ndarray] | None:
        if (kind, p) not in self.files:
            try:
                self.files[kind, p] = shared.unpack(shared.mapped(f"{self.at}/{kind}/{p:08d}"))
            except FileNotFoundError:
                self.files[kind, p] = None  # no pair or word of this part was learned
        return self.files[kind, p]

    def look_up(self, kind: str, key: str, of: np.ndarray, wanted: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Values by name for each wanted hash (0 where it is not there); ``of`` is the hash that its part goes by."""
        out = [np.zeros(len(wanted), np.int64) for _ in names]
        for p, rows in kernels.split_by(part_of(of, self.parts), self.parts):
            if (x := self.part(kind, p)) is None:
                continue
            rows = rows[np.argsort(wanted[rows])]
            where = np.searchsorted(x[key], wanted[rows])
            where[where == len(x[key])] = 0
            hit = x[key][where] == wanted[rows]
            for a, name in zip(out, names, strict=True):
                a[rows[hit]] = x[name][where[hit]]
        return out

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of different n-grams, given as columns."""
        level = len(columns)
        if level == 1:
            (types,) = self.look_up("words", "word", columns[0], columns[0], ("types",))
            return self.left / (self.vocabulary + 1) + np.maximum(types - self.discounts[1][np.minimum(types, 3)], 0) / max(self.types, 1)
        context, at_context = np.unique(gram_hash(columns[:-1]), return_inverse=True)
        total, ones, twos, more = self.look_up(f"contexts{level}", "context", context, context, ("total", "ones", "twos", "more"))
        key, d = gram_hash(columns), self.discounts[level]
        (count,) = self.look_up(f"grams{level}", "key", key, key, ("count",))
        seen = np.maximum(total, 1)
        back = np.where(total > 0, (d[1] * ones + d[2] * twos + d[3] * more) / seen, 1.0)
        _, first, at_low = np.unique(gram_hash(columns[1:]), return_index=True, return_inverse=True)
        low = self.probability([c[first] for c in columns[1:]])
        return np.maximum(count - d[np.minimum(count, 3)], 0) / seen[at_context] + back[at_context] * low[at_low]

    def score(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the model's and the base's probability of each token, and whether it was learned."""
        _, first, gram = np.unique(gram_hash(columns), return_index=True, return_inverse=True)
        own = np.log10(self.probability([c[first] for c in columns]))
        word, at_word = np.unique(columns[-1], return_inverse=True)
        (raw,) = self.look_up("words", "word", word, word, ("raw",))
        base = np.log10((raw + 1) / (self.total + self.vocabulary + 1))
        return own[gram], base[at_word], (raw > 0)[at_word]


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(at: str, parts: int, order: int, sums: dict[int, list[int]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Arrays(at, parts, order, sums)
        train = sums.get(1, [0, 0])[1]
        for batch in kernels.pieces(batches, "text"):
            columns, bound = tokens(*kernels.column(batch.column("text")), order)
            own, base, known = model.score(columns)
            at_docs = bound[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(bound)), pa.array(np.add.reduceat(known.astype(np.int64), at_docs)), pa.array(np.full(batch.num_rows, train)), pa.array(np.add.reduceat(base, at_docs)), pa.array(np.add.reduceat(own, at_docs))], [x.split()[0] for x in _SCORED.split(", ")])

    return work


def learn(texts: DataFrame, at: str, order: int = ORDER) -> tuple[int, dict[int, list[int]]]:
    """Count ``text`` and write the arrays below ``at``: the number of parts and, by level, the sums of the model."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, size // 6 // PART_TOKENS)
    tasks = min(parts, 20_000)
    dealt = lambda df, work: df.mapInArrow(work, "part int, blob binary").repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")
    grams = dealt(texts.select("text"), _count(parts, order))
    for level in range(order, 1, -1):
        grams = dealt(grams, _level(at, parts, level, level == order))
    found = shared.written(grams.mapInArrow(_words(at, parts, order), _SUMS), f"{at}/sums")
    names = [x.split()[0] for x in _SUMS.split(", ")][1:]
    sums = {r.level: [int(r[k]) for k in names] for r in found.groupBy("level").agg(*(F.sum(k).alias(k) for k in names)).collect()}  # a row a level
    shared.free_shuffles(spark)
    return parts, sums


def score_texts(docs: DataFrame, at: str, order: int = ORDER) -> DataFrame:
    """Learn from the documents that are not held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"))
    parts, sums = learn(rows.filter("not held_out"), at, order)
    return rows.mapInArrow(_score(at, parts, order, sums), _SCORED)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, shared.folder(spark, "op5"))
