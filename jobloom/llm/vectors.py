"""Compression of vectors to codes of equal parts, with codebooks trained by filtering Lloyd rounds.

Vectors become integers and are cut into equal consecutive parts; each part
position has a codebook of a few entries. Every task packs its vectors into
blocks and builds, for each part position of a block, a kd-tree over the block's
parts: a node keeps its bounding box, the number of parts, their sum and their
sum of squares. A round takes the entries down the trees, level by level for all
nodes of a level at once. An entry leaves a node if another one is at least as
near everywhere in the node's box; where one entry is left, the whole subtree is
its own, by the cached sums. Only parts in leaves with several entries left are
compared one by one. All arithmetic is on integers, so results are exact, and do
not depend on how the rows are dealt.

Blocks with their trees are written once to the shared folder and read by each
round, which hands one row for each position and entry of a block to a sum by
(position, entry); nothing but the codebooks (parts x entries) reaches the driver.
Vectors are never shuffled, so a label or a group of copies with a third of all
rows does not matter; copies are one box, which one entry gets undivided.

Defined results: rows whose vector is null or holds null or non-finite
components are left out. Vectors whose length is not that of the smallest id's
vector keep their row, with null code and error. Equal ids are ordered by their
components, null ids come last; repeated rows count (and are returned) each;
with fewer vectors than entries the codebooks are as short; an empty table gives
no rows, and empty codebooks. Errors of a null label are summed together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import shared
from jobloom.llm.kernels import ragged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and components of all of them at most; parts of a leaf.
BLOCK, BLOCK_NUMBERS, LEAF = 16_384, 4 << 20, 12
#: Components of which squared distances and their sums fit into 64 bits.
LARGEST = 1 << 24
#: Sums of labels that may be broadcast (about 3 MB); beyond them labels are spread over so many salts.
FEW_LABELS, SALTS = 100_000, 16


# Trees ----------------------------------------------------------------------------------------


@dataclass
class Level:
    """Nodes of one depth: ranges of the tree's order, boxes, sums, and the first of their two children below (-1: leaf)."""

    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    square: np.ndarray
    child: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[Level]]:
    """Order of the points and the levels of their kd-tree; each node is halved along its box's longest side."""
    order, levels = np.arange(len(points)), []
    start, end = np.array([0]), np.array([len(points)])
    while len(start):
        size = end - start
        at, first = ragged(start, size), np.cumsum(size) - size
        own = points[order[at]]
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        level = Level(start, end, low, high, np.add.reduceat(own, first), np.add.reduceat((own * own).sum(1), first), np.full(len(start), -1))
        levels.append(level)
        split = np.flatnonzero((size > leaf) & (low != high).any(1))
        level.child[split] = 2 * np.arange(len(split))
        side = (high - low).argmax(1)
        node = np.repeat(np.arange(len(start)), size)
        inside = level.child[node] >= 0
        at, node, own = at[inside], node[inside], own[inside]
        order[at] = order[at][np.lexsort((own[np.arange(len(own)), side[node]], node))]
        middle = start[split] + size[split] // 2
        start, end = np.stack([start[split], middle], 1).ravel(), np.stack([middle, end[split]], 1).ravel()
    return order, levels


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to entries (columns)."""
    out = np.zeros((len(points), len(book)), np.int64)
    for j in range(book.shape[1]):
        out += (points[:, j, None] - book[None, :, j]) ** 2
    return out


def assign(points: np.ndarray, order: np.ndarray, levels: list[Level], book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, tuple[np.ndarray, ...] | None]]:
    """Groups of parts and their entries: (starts, ends, entries, sums) of whole subtrees, and (places, entries, None, None) of single parts, in the tree's order."""
    everywhere = np.iinfo(np.int64).max
    number = np.arange(len(book))
    node, left = np.array([0]), np.ones((1, len(book)), bool)
    for level in levels:
        if not len(node):
            return
        low, high = level.low[node], level.high[node]
        # The nearest entry to the box's middle (all doubled), of equal ones the first.
        best = np.where(left, distances(low + high, 2 * book), everywhere).argmin(1)
        gain = np.zeros(left.shape, np.int64)
        for j in range(book.shape[1]):
            apart = book[None, :, j] - book[best, j][:, None]
            corner = np.where(apart > 0, high[:, j, None], low[:, j, None])  # where the entry is best off against ``best``
            gain += apart * (book[None, :, j] + book[best, j][:, None] - 2 * corner)
        left &= ~((gain > 0) | (gain == 0) & (number > best[:, None]))
        whole = left.sum(1) == 1
        if whole.any():
            some = node[whole]
            yield level.start[some], level.end[some], left[whole].argmax(1), (level.total[some], level.square[some])
        leaf = ~whole & (level.child[node] < 0)
        if leaf.any():
            start, size = level.start[node[leaf]], (level.end - level.start)[node[leaf]]
            place, among = ragged(start, size), np.repeat(left[leaf], size, axis=0)
            yield place, np.where(among, distances(points[order[place]], book), everywhere).argmin(1), None, None
        down = ~whole & ~leaf
        child = level.child[node[down]]
        node, left = np.stack([child, child + 1], 1).ravel(), np.repeat(left[down], 2, axis=0)


def sums_of(points: np.ndarray, order: np.ndarray, levels: list[Level], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the parts that each entry gets."""
    total, count = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    for a, b, entry, cached in assign(points, order, levels, book):
        if cached is None:
            np.add.at(total, b, points[order[a]])
            np.add.at(count, b, 1)
        else:
            np.add.at(total, entry, cached[0])
            np.add.at(count, entry, b - a)
    return total, count


def codes_of(points: np.ndarray, order: np.ndarray, levels: list[Level], book: np.ndarray) -> np.ndarray:
    """Each point's entry."""
    out = np.zeros(len(points), np.int64)
    for a, b, entry, cached in assign(points, order, levels, book):
        if cached is None:
            out[order[a]] = b
        else:
            out[order[ragged(a, b - a)]] = np.repeat(entry, b - a)
    return out


# Blocks ---------------------------------------------------------------------------------------


def _packed(points: np.ndarray) -> bytes:
    """A block's parts at one position, with their tree."""
    order, levels = build(points)
    narrow = lambda a: a.astype(np.int32)
    arrays = {"points": narrow(points.ravel()), "order": narrow(order), "shape": np.array([points.shape[1], len(levels)])}
    for i, x in enumerate(levels):
        arrays |= {f"s{i}": narrow(x.start), f"e{i}": narrow(x.end), f"c{i}": narrow(x.child), f"l{i}": narrow(x.low.ravel()), f"h{i}": narrow(x.high.ravel()), f"t{i}": x.total.ravel(), f"q{i}": x.square}
    return shared.pack(**arrays)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[Level]]:
    x = shared.unpack(blob)
    wide = lambda a: a.astype(np.int64)
    width, depth = x["shape"]
    levels = [Level(wide(x[f"s{i}"]), wide(x[f"e{i}"]), *(wide(x[f"{k}{i}"]).reshape(-1, width) for k in "lht"), x[f"q{i}"], wide(x[f"c{i}"])) for i in range(depth)]
    return wide(x["points"]).reshape(-1, width), wide(x["order"]), levels


def _blocks(dimension: int, parts: int, scale: int, ids: list[str]):
    """Rows of ids and vectors -> one row a block: its ids as lists, and a tree for each part position."""
    most = max(1, min(BLOCK, BLOCK_NUMBERS // dimension))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            raw = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks])
            whole = np.floor(raw.astype(np.float64) * scale)
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST // scale} cannot be compressed exactly")
            vectors = whole.astype(np.int64).reshape(table.num_rows, parts, dimension // parts)
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.concat_arrays(table.column(c).chunks)) for c in ids]
            blobs = [_packed(vectors[:, p]) for p in range(parts)]
            return pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays(pa.array([0, parts], pa.int32()), pa.array(blobs, pa.binary()))], [*ids, "trees"])

        n = 0
        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, most - n)
                held.append(head)
                n += head.num_rows
                batch = batch.slice(head.num_rows)
                if n == most:
                    yield block()
                    n = 0
        if n:
            yield block()

    return work


def _sums(books: np.ndarray):
    """Blocks -> (position, entry, sums, n), one row of each in the batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for trees in batch.column("trees"):
                for p, blob in enumerate(trees):
                    t, c = sums_of(*_unpacked(blob.as_py()), books[p])
                    total[p] += t
                    count[p] += c
        some = np.flatnonzero(count.ravel())
        if len(some):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(total.reshape(-1, width)[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some // entries, pa.int32()), pa.array(some % entries, pa.int32()), lists, pa.array(count.ravel()[some])], ["position", "entry", "sums", "n"])

    return work


def _codes(books: np.ndarray, ids: list[str]):
    """Blocks -> ids, code, error of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(batch.column("trees")):
                code, error = [], 0
                for p, blob in enumerate(trees):
                    points, order, levels = _unpacked(blob.as_py())
                    code.append(codes_of(points, order, levels, books[p]))
                    error = error + ((points - books[p][code[-1]]) ** 2).sum(1)
                hexed = np.stack(code, 1).astype(np.uint8).tobytes().hex()
                own = [hexed[k : k + 2 * len(code)] for k in range(0, len(hexed), 2 * len(code))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i].values for c in ids), pa.array(own), pa.array(error)], [*ids, "code", "error"])

    return work


# The operator ---------------------------------------------------------------------------------


def usable(vector) -> F.Column:
    """Neither null nor with null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def compress(df: DataFrame, at: str, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every usable row, and the codebooks (position, entry, component). ``at``: a shared folder for the trees."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    spark = df.sparkSession
    ids = ["key", "label"]
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    first = [r.vector for r in rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).collect()]
    dimension = len(first[0]) if first else 0
    if dimension % parts:
        raise ValueError(f"{dimension} components cannot be cut into {parts} equal parts")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ids}
    fields = ", ".join(f"{c} {kind[c]}" for c in ids)
    uncoded = lambda x: x.select(*ids, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not dimension:
        return uncoded(rows), np.zeros((parts, 0, 0), np.int64)
    fit = rows.filter(F.size("vector") == dimension)
    start = fit.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()  # bounded by ``entries``
    books = np.floor(np.array([r.vector for r in start]) * scale).astype(np.int64).reshape(-1, parts, dimension // parts).transpose(1, 0, 2)
    lists = ", ".join(f"{c} array<{kind[c]}>" for c in ids)
    trees = shared.written(fit.mapInArrow(_blocks(dimension, parts, scale, ids), f"{lists}, trees array<binary>"), f"{at}/trees")
    for _ in range(rounds):
        found = trees.select("trees").mapInArrow(_sums(books), "position int, entry int, sums array<long>, n long")
        each = found.select("position", "entry", "n", F.posexplode("sums").alias("component", "value"))
        books = books.copy()
        for r in each.groupBy("position", "entry", "component").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect():  # bounded by the codebooks
            books[r.position, r.entry, r.component] = r.value // r.n
    coded = trees.mapInArrow(_codes(books, ids), f"{fields}, code string, error long")
    return coded.unionAll(uncoded(rows.filter(F.size("vector") != dimension))), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by position, entry and component, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (key, label, code, error) with label_error; no label's rows meet in one task."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    salted = sums.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = coded.withColumn("__own", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__own") == F.col("__salt"))).drop("__label", "__own", "__salt")


def _sql() -> str:
    """DuckDB: the same rounds, every part against every entry."""
    floor = f"CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)"
    square = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT"
    steps = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT k.vec_id, k.label, j AS position, k.v[j * len(k.v) // {PARTS} + 1 : (j + 1) * len(k.v) // {PARTS}] AS v FROM kept k, range({PARTS}) r(j))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT p.position, f.entry, p.v FROM p JOIN f USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.label, p.position, p.v, arg_min(b.entry, {square} * {ENTRIES} + b.entry) AS entry, min({square}) AS error FROM p JOIN b{k} b USING (position) GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(f"u{k} AS (SELECT position, entry, i, floor(sum(v[i]) / count(*))::BIGINT AS c FROM a{k}, range(1, (SELECT max(len(v)) FROM p) + 1) r(i) GROUP BY ALL)")
            steps.append(f"n{k} AS (SELECT position, entry, list(c ORDER BY i) AS v FROM u{k} GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.position, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN n{k} n USING (position, entry))")
    steps.append("c AS (SELECT vec_id, label, string_agg(printf('%02x', entry::INT), '' ORDER BY position) AS code, sum(error)::BIGINT AS error FROM " + f"a{ROUNDS} GROUP BY ALL)")
    steps.append(f"d AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, d"


SQL = _sql()


def op11(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), shared.folder(spark, "op11"))
    return label_errors(coded).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
