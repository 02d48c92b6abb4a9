"""Best-fit packing of documents into sequences of a fixed number of tokens, by the linear grouping scheme.

A document longer than a sequence is cut into full pieces behind a first one of
what is left over; full pieces are sequences by themselves. All other pieces are
packed by their lengths alone, of which there are fewer than a sequence has
tokens: the scheme runs over the histogram of lengths, whose size (and time) does
not depend on the number of documents.

Large lengths (above ``capacity // SMALL_SHARE``) are ordered and cut into groups
of equally many pieces; each is rounded up to the longest of its group. For these
few sizes the best mixture of configurations (which sizes share a sequence) is a
linear programme, solved by column generation with a knapsack over exact lengths;
its whole multiples are taken, and what is left is solved again. Then pieces take
the places of their group, and the small ones (and what the last solutions leave)
go, longest first, to the sequence that they fill best. Everything is kept as runs
of sequences with equal contents.

Rows meet the plan by rank among the pieces of their length. Ranks are counted in
(length, bucket) and offset by the sums of earlier buckets, so a length or a group
of copies with a third of all rows is dealt out; texts are encoded where they lie
and never shuffled, only the pieces' few numbers are (with ``with_ids`` their ids).

Defined results: a null or empty text is a document of the end id only; null and
repeated ids are documents each; rows equal in everything may exchange places;
extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm import kernels, shared
from jobloom.llm.bpe import public_path
from jobloom.llm.pretokens import Store
from jobloom.llm.tokenfiles import END_ID, library

CAPACITY = 2048
#: Groups of large lengths; lengths up to this share of a sequence are small; how often the rest is solved again.
GROUPS, SMALL_SHARE, SOLUTIONS = 256, 3, 24
#: Buckets in which the pieces of a length are ranked at least, and pieces for which there is one more.
BUCKETS, BUCKET_ROWS = 1024, 100_000

Run = tuple[list[int], int]  # lengths that share a sequence, number of such sequences


# The plan, over the histogram -------------------------------------------------------------------


def grouped(count: np.ndarray, small: int, groups: int) -> list[list[list[int]]]:
    """Groups of [length, number], longest first, of the lengths above ``small``: equally many pieces in each; groups of one rounded length are one."""
    each = -(-int(count[small + 1 :].sum()) // groups)
    found: list[list[list[int]]] = []
    room = 0
    for length in range(len(count) - 1, small, -1):
        left = int(count[length])
        while left:
            if not room:
                room = each
                if not found or found[-1][0][0] != length:
                    found.append([])
            n = min(left, room)
            if found[-1] and found[-1][-1][0] == length:
                found[-1][-1][1] += n
            else:
                found[-1].append([length, n])
            left, room = left - n, room - n
    return found


def best_configuration(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the largest value: a knapsack by number of pieces."""
    place = np.arange(capacity + 1)[None] - size[:, None]
    place[place < 0] = capacity + 1
    now, chosen = np.append(np.zeros(capacity + 1), -np.inf), []
    for _ in range(capacity // int(size.min())):
        ahead = now[place] + value[:, None]
        item = ahead.argmax(0)
        gain = ahead[item, np.arange(capacity + 1)]
        better = gain > now[:-1] + 1e-12
        if not better.any():
            break
        chosen.append(np.where(better, item, -1))
        now[:-1] = np.where(better, gain, now[:-1])
    held, at = np.zeros(len(size), np.int64), capacity
    for step in reversed(chosen):
        if step[at] >= 0:
            held[step[at]] += 1
            at -= int(size[step[at]])
    return held, float(held @ value)


def mixture(size: np.ndarray, demand: np.ndarray, capacity: int, near: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often each is taken, in fractions: within ``near`` sequences of the fewest that meet the demand."""
    many = capacity // size
    columns, inverse = np.diag(many), np.diag(1.0 / many)
    times = demand / many
    for _ in range(40 * len(size)):
        prices = inverse.sum(0)
        new, value = best_configuration(prices, size, capacity)
        if value <= 1 + 1e-9 or times.sum() * (1 - 1 / value) < near:
            break
        step = inverse @ new
        ratio = np.full(len(size), np.inf)
        np.divide(times, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        times = np.maximum(times - ratio[out] * step, 0)
        times[out] = ratio[out]
        columns[:, out] = new
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return columns, times


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole numbers of configurations, and the demand that they leave."""
    found, left = [], demand.copy()
    for solution in range(SOLUTIONS):
        live = np.flatnonzero(left)
        if not len(live):
            break
        columns, times = mixture(size[live], left[live].astype(float), capacity)
        whole = np.floor(times + 1e-6).astype(np.int64)
        if not whole.sum() or solution and whole.sum() < 0.5 * times.sum():
            # Little is whole: round up what is at least half there, and the most nearly whole one in any case.
            up = np.flatnonzero(times - whole >= min(0.5, (times - whole).max()))
            whole[up] += 1
        for c in np.argsort(-times):
            own = np.zeros(len(size), np.int64)
            own[live] = columns[:, c]
            used = own > 0
            n = min(int(whole[c]), int((left[used] // own[used]).min()) if used.any() else 0)
            if n:
                found.append((own, n))
                left = left - n * own
            elif whole[c] and used.any() and not (whole > 1).any():
                own = np.minimum(own, left)
                if own.any():
                    found.append((own, 1))
                    left = left - own
    return found, left


def substituted(groups: list[list[list[int]]], found: list[tuple[np.ndarray, int]]) -> list[Run]:
    """Runs of sequences in which actual lengths, longest first, take their group's places."""
    queue = [[list(x) for x in reversed(g)] for g in groups]
    out: list[Run] = []
    for held, times in found:
        slots = [g for g in np.flatnonzero(held) for _ in range(int(held[g]))]
        taken: list[list[list[int]]] = []  # of each slot, the lengths of the ``times`` sequences
        for g in slots:
            need, own = times, []
            while need:
                length, n = queue[g][-1]
                take = min(n, need)
                own.append([length, take])
                need -= take
                queue[g][-1][1] -= take
                if not queue[g][-1][1]:
                    queue[g].pop()
            taken.append(own[::-1])
        while taken[0]:
            n = min(own[-1][1] for own in taken)
            out.append(([own[-1][0] for own in taken], n))
            for own in taken:
                own[-1][1] -= n
                if not own[-1][1]:
                    own.pop()
    return out


def best_fit(runs: list[Run], count: np.ndarray, capacity: int) -> list[Run]:
    """The runs with all of ``count`` (pieces by length) added, longest first, each to the fullest sequence that has room, or to a new one."""
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for lengths, n in runs:
        by_room[capacity - sum(lengths)].append((lengths, n))
    for length in range(capacity, 0, -1):
        left, room = int(count[length]), length
        while left:
            while room < capacity and not by_room[room]:
                room += 1
            lengths, n = by_room[room].pop() if by_room[room] else ([], left)
            each = room // length  # with one piece more it is fuller still, so it gets the next one too
            full = min(n, left // each)
            if full:
                by_room[room - each * length].append((lengths + [length] * each, full))
                left -= full * each
            if full < n and 0 < left < each:
                by_room[room - left * length].append((lengths + [length] * left, 1))
                left, full = 0, full + 1
            if full < n and lengths:
                by_room[room].append((lengths, n - full))
    return [run for runs in by_room for run in runs]


def plan(count: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold ``count[length]`` pieces of each length (up to ``capacity``)."""
    count = count.astype(np.int64).copy()
    out: list[Run] = [([capacity], int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    small = capacity // SMALL_SHARE
    large = grouped(count, small, groups)
    if large:
        size, demand = np.array([g[0][0] for g in large]), np.array([sum(n for _, n in g) for g in large])
        found, _ = configurations(size, demand, capacity)
        runs = substituted(large, found)
        for lengths, n in runs:
            np.subtract.at(count, lengths, n)
    else:
        runs = []
    return out + best_fit(runs, count, capacity)


# Pieces and their places ------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special, _ = library(path)
        store = Store(encode)
        for batch in kernels.pieces(batches, "text", 2 << 20):
            ids, size = store.batch(*kernels.column(batch.column("text")), special)
            ids = np.insert(ids, np.cumsum(size), END_ID).astype("<u4")
            size = size + 1
            many = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = size - (many - 1) * capacity
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            bound = np.concatenate([[0], np.cumsum(length)])
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def _places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each length and range of ranks the sequences and the offset: key (length, first rank), sequence of the first, offset."""
    next_rank: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in runs:
        at = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, base, at))
            next_rank[length] = rank + n
            at += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T.copy(), strict=True))


def placed(found: DataFrame, runs: list[Run]) -> DataFrame:
    """Pieces (with length and rank among those of their length) with sequence_id and offset."""
    table = _places(runs)
    key = table["length"] << 44 | table["rank"]
    columns = [c for c in found.columns if c != "rank"]
    schema = ", ".join([*(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in columns), "sequence_id long, offset long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])], [*columns, "sequence_id", "offset"])

    return found.mapInArrow(work, schema)


def ranked(found: DataFrame, buckets: int) -> DataFrame:
    """Pieces (with a number ``row`` of their own) with their rank among those of their length."""
    rows = found.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    rows = rows.withColumn("own", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    return rows.withColumn("rank", F.col("own") + F.col("before")).drop("row", "bucket", "own", "before")


def pack(docs: DataFrame, at: str, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece of every document. ``at``: a shared folder for the pieces."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    found = shared.written(pieces(docs, path, capacity, with_ids).withColumn("row", F.monotonically_increasing_id()), f"{at}/pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # a row for each length up to the capacity
        count[r.length] = r["count"]
    return placed(ranked(found, max(BUCKETS, int(count.sum()) // BUCKET_ROWS)), plan(count, capacity)).select(*names)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from a packing with ids: the pieces of each sequence one after another."""
    each = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return each.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op13(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shared.folder(spark, "op13"), public_path())
