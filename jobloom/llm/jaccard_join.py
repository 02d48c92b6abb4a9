"""N-gram Jaccard join of all documents: a chosen-path join with exact verification.

Sets are the distinct five-word shingles of a text (a text of one to four words
has one shingle, all its words). Documents with equal sets are one node from
then on, counted with their copies.

1. Each node's set is embedded in ``WIDTH`` coordinates by one-permutation
   min-hashing with densification: two nodes agree in a coordinate with a
   probability of their similarity.
2. Chosen paths: in each run the root samples ``FANOUT`` coordinates; nodes that
   share the token of a sampled coordinate fall into one bucket. A bucket of
   more than ``SMALL`` nodes samples coordinates anew and is split again, up to
   ``DEPTH`` times; small ones are compared by brute force on eight-bit sketches.
   In a large bucket, nodes are first compared with up to ``LEADERS`` leaders of
   it, and only those that are like none go deeper, so a group of near copies
   costs one comparison a node and not a path for each level. Runs are repeated
   until a pair at the threshold is found with ``RECALL`` (``runs_for``).
3. Buckets yield spanning edges, never their pairs; their connected components
   are candidates.
4. In each candidate component all similarities are computed exactly from the
   whole texts, by blocks of a sparse product; larger components are dealt to
   pairs of blocks, so none is gathered in one task. Each link is counted once.

What is broadcast is counted first.

Defined results: null and empty texts have no shingles, no links and a class of
their own; repeated rows are copies of each other; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import kernels, shared
from jobloom.llm.components import components
from jobloom.llm.kernels import U, mix

WORDS = 5
#: Similarity of a link, as a fraction of integers.
THRESHOLD = (4, 5)
RECALL = 0.9999
WIDTH, FANOUT, SMALL, DEPTH = 128, 3, 48, 4
#: Agreement of sketches from which nodes of a small bucket are candidates; from which a node of a large bucket follows a leader; from which it is joined to a leader.
#: Of a pair at the threshold, if one is as near as FOLLOWER to a leader, the other is not farther from it than by 0.2 more; the rest is for the sketches' error.
CANDIDATE, FOLLOWER, NEAR_LEADER = 0.5, 0.7, 0.35
#: Leaders of a large bucket; at the last level there is no limit.
LEADERS = 64
#: Nodes of a component that are compared in one task.
BLOCK = 2000
#: Rows (of 24 bytes) that may be broadcast.
BROADCAST_ROWS = 1_000_000
_SHINGLE = [U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]
_FIFTY = U((1 << 50) - 1)


def runs_for(recall: float, similarity: float = THRESHOLD[0] / THRESHOLD[1], fanout: int = FANOUT, depth: int = DEPTH) -> int:
    """Runs after which a pair is found with ``recall``, even if its paths go ``depth`` levels down: a branching process in which each of ``fanout`` samples keeps the pair with its similarity."""
    found = 1.0
    for _ in range(depth):
        found = 1 - (1 - similarity * found) ** fanout
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 50-bit shingle hashes, sorted in each document, and their bounds by document. At most 16,384 documents."""
    begin, end, first = kernels.words(data, off)
    h = kernels.Hashes(data).of(begin, end)
    count = np.diff(first)
    total = np.zeros(len(h), U)
    for k in range(min(words, len(h))):
        total[: len(h) - k] += (h[k:] ^ _SHINGLE[k % 5]) * (_SHINGLE[(k + 1) % 5] | U(1))
    full = np.maximum(count - (words - 1), 0)
    doc = np.repeat(np.arange(len(count)), full)
    key = mix(total[kernels.ragged(first[:-1], full)])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):  # all words as one shingle, apart from those of five words by their number
        own = [mix((h[first[d] : first[d + 1]] * _SHINGLE[0] + np.arange(count[d], dtype=U) * _SHINGLE[1]).sum(keepdims=True) + U(count[d]))[0] for d in short]
        doc, key = np.concatenate([doc, short]), np.concatenate([key, np.array(own, U)])
    both = np.sort(doc.astype(U) << U(50) | key >> U(14))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return both & _FIFTY, np.searchsorted(both, np.arange(len(count) + 1).astype(U) << U(50))


_TRIES = mix(np.arange(WIDTH * 512, dtype=U)).reshape(512, WIDTH) % U(WIDTH)


def sketches(h: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One-permutation min-hash values (uint32) in WIDTH coordinates; empty coordinates borrow from others in an order that is theirs."""
    n = len(bound) - 1
    doc = np.repeat(np.arange(n), np.diff(bound))
    z = mix(h)
    out = np.full(n * WIDTH, 2**32 - 1, np.uint32)
    np.minimum.at(out, doc * WIDTH + (z >> U(57)).astype(np.int64), (z & U(0xFFFFFFFE)).astype(np.uint32))
    out = out.reshape(n, WIDTH)
    empty = out == 2**32 - 1
    r, c = np.nonzero(empty & ~empty.all(1)[:, None])
    for t in range(len(_TRIES)):
        if not len(r):
            break
        source = _TRIES[t, c].astype(np.int64)
        got = ~empty[r, source]
        out[r[got], c[got]] = out[r[got], source[got]] ^ np.uint32(1)
        r, c = r[~got], c[~got]
    for i, j in zip(r, c, strict=True):
        out[i, j] = out[i, np.flatnonzero(~empty[i])[0]] ^ np.uint32(1)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kernels.pieces(batches, "text", 2 << 20):
        h, bound = shingles(*kernels.column(batch.column("text")))
        n = np.diff(bound)
        sums = np.zeros((2, len(n)), U)
        some = np.flatnonzero(n)
        if len(some):
            for k, salt in enumerate((U(0), U(0x5851F42D4C957F2D))):
                sums[k, some] = np.add.reduceat(mix(h + salt), bound[some])
        sketch = sketches(h, bound)
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * WIDTH), len(n), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *(pa.array(x.view(np.int64)) for x in sums), pa.array(n), rows], ["doc_id", "h", "k1", "k2", "n", "sketch"])


def _matrix(col, kind) -> np.ndarray:
    data, off = kernels.column(col)
    return data.view(kind).reshape(len(off) - 1, -1)


def _children(path: np.ndarray, sketch: np.ndarray, fanout: int) -> np.ndarray:
    """Paths of the buckets into which each node falls below its path: (rows, fanout)."""
    out = np.empty((len(path), fanout), U)
    rows = np.arange(len(path))
    for k in range(fanout):
        sampled = mix(path + U(0x632BE59BD9B4E019 * (k + 1) % 2**64))
        out[:, k] = mix(sampled ^ sketch[rows, (sampled % U(WIDTH)).astype(np.int64)].astype(U) * U(0xD6E8FEB86659FD93))
    return out


def _roots(runs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                sketch = _matrix(part.column("sketch"), np.uint32)
                for r in range(runs):
                    yield _paths(part, sketch, _children(np.full(len(sketch), r, U), sketch, FANOUT))

    return work


def _paths(part: pa.RecordBatch, sketch: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    k, n = path.shape[1], len(path)
    low = np.ascontiguousarray((sketch >> np.uint32(1)).astype(np.uint8))
    check = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), n, [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())
    rows = pa.array(np.repeat(np.arange(n), k))
    return pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), part.column("node").take(rows), check.take(rows)], ["path", "node", "check"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sketch = _matrix(part.column("sketch"), np.uint32)
            yield _paths(part, sketch, _children(part.column("path").to_numpy().view(U), sketch, FANOUT))


def _alike(path: np.ndarray, node: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges between the alike nodes of small buckets, which lie one after another."""
    n, i, j = len(path), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(SMALL, n)):
        same = np.flatnonzero(path[d:] == path[:-d])
        if not len(same):
            break
        for s in range(0, len(same), 20000):
            x = same[s : s + 20000]
            near = (check[x] == check[x + d]).sum(1) >= CANDIDATE * WIDTH
            i.append(x[near])
            j.append(x[near] + d)
    label = _labels(n, np.concatenate(i), np.concatenate(j))
    rows = np.flatnonzero(label != np.arange(n))
    return node[rows], node[label[rows]]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of ``n`` things: the smallest one that links (i, j) join it to."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


class _Leaders:
    """The leaders of one large bucket, to which its nodes are shown in blocks.

    A node near several leaders gives one edge, and the leaders are joined once
    for all nodes: no more edges than nodes and leaders.
    """

    def __init__(self, most: int | None):
        self.most, self.checks, self.names, self.top = most, np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64), []

    def _root(self, k: int) -> int:
        while self.top[k] != k:
            self.top[k] = self.top[self.top[k]]
            k = self.top[k]
        return k

    def show(self, node: np.ndarray, check: np.ndarray) -> tuple[list, list, np.ndarray]:
        """Edges (a, b), and the rows that follow no leader and found no place as one."""
        n = len(node)
        # Agreement with the leaders so far; new leaders add a column for the rows behind them.
        like = np.concatenate([np.zeros((n, 0), np.int64), *((check[:, None] == self.checks[k : k + 64]).sum(2) for k in range(0, len(self.checks), 64))], 1)
        free = ~(like >= FOLLOWER * WIDTH).any(1)
        for r in range(n):
            if free[r]:
                if self.most is not None and len(self.names) >= self.most:
                    break
                own = (check == check[r]).sum(1)
                own[:r] = 0
                free &= own < FOLLOWER * WIDTH
                like = np.concatenate([like, own[:, None]], 1)
                self.checks, self.names = np.concatenate([self.checks, check[r][None]]), np.append(self.names, node[r])
                self.top.append(len(self.top))
        near = like >= NEAR_LEADER * WIDTH
        if not near.shape[1]:
            return [], [], np.flatnonzero(free)
        i, first = np.flatnonzero(near.any(1)), near.argmax(1)
        a, b = node[i].tolist(), self.names[first[i]].tolist()
        r, c = np.nonzero(near)
        for both in np.unique(first[r] * len(self.names) + c).tolist():
            p, q = self._root(both // len(self.names)), self._root(both % len(self.names))
            if p != q:
                self.top[max(p, q)] = min(p, q)
                a.append(int(self.names[max(p, q)]))
                b.append(int(self.names[min(p, q)]))
        return a, b, np.flatnonzero(free)


def _buckets(most: int | None):
    """Rows (path, node, check) sorted by path: kind 0, edges (a, b) between nodes that look alike; kind 1, (path, node) of large buckets that go deeper."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, leaders = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("path").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("check"), np.uint8))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            path, node, check = now
            bounds = kernels.runs(path)
            large = (np.diff(bounds) > SMALL) | (path[bounds[:-1]] == at if at is not None else False)
            a, b, alone = [], [], []
            for g in np.flatnonzero(large):
                s, e = bounds[g], bounds[g + 1]
                if path[s] != at:
                    at, leaders = path[s], _Leaders(most)
                for x in range(s, e, 256):
                    y = min(e, x + 256)
                    p, q, rest = leaders.show(node[x:y], check[x:y])
                    a += p
                    b += q
                    alone.append(x + rest)
            # The last bucket may go on in the next batch; until it is large it waits.
            cut = len(path) if large[-1] else bounds[-2]
            held = None if large[-1] else tuple(x[cut:] for x in now)
            small = np.flatnonzero(~np.repeat(large, np.diff(bounds))[:cut])
            x, y = _alike(path[small], node[small], check[small])
            alone = np.concatenate([np.zeros(0, np.int64), *alone])
            yield _found(np.concatenate([np.array(a, np.int64), x]), np.concatenate([np.array(b, np.int64), y]), path[alone], node[alone])
        if held is not None:
            z = np.zeros(0, np.int64)
            yield _found(*_alike(*held), z, z)

    return work


def _found(a: np.ndarray, b: np.ndarray, path: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    kind = np.repeat(np.arange(2, dtype=np.int32), [len(a), len(path)])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a, path])), pa.array(np.concatenate([b, node]))], ["kind", "a", "b"])


def _intersections(h: np.ndarray, doc: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|A & B| of all left x right documents, from (shingle, document) pairs: rare shingles pair by pair, frequent ones as a product of blocks."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    bounds = kernels.runs(h)
    df = np.diff(bounds)
    place_l, place_r = np.full(n, -1), np.full(n, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    rare = np.flatnonzero((df > 1) & (df <= 8))
    s, k = bounds[:-1][rare], df[rare]
    for d in range(1, 8):
        for e in range(8 - d):
            own = s[k > d + e]
            if len(own):
                x, y = doc[own + e], doc[own + e + d]
                for p, q in ((x, y), (y, x)):
                    ok = (place_l[p] >= 0) & (place_r[q] >= 0)
                    np.add.at(out, (place_l[p[ok]], place_r[q[ok]]), 1)
    often = np.flatnonzero(df > 8)
    for c in range(0, len(often), 1024):
        cols = often[c : c + 1024]
        rows = doc[kernels.ragged(bounds[:-1][cols], df[cols])]
        col = np.repeat(np.arange(len(cols)), df[cols])
        m = np.zeros((n, len(cols)), np.float32)
        m[rows, col] = 1
        out += m[left] @ m[right].T
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: each node's number of linked documents in it, and the smallest node of its links' closure there."""

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        # Batch by batch: one string column of all of them could pass Arrow's 2 GiB.
        node, first = np.unique(np.concatenate([x.column("node").to_numpy() for x in parts]), return_index=True)
        half, copies = (np.concatenate([x.column(c).to_numpy() for x in parts])[first] for c in ("half", "copies"))
        n = len(node)
        place = np.full(sum(x.num_rows for x in parts), -1)
        place[first] = np.arange(n)
        hs, docs, size, at = [], [], np.zeros(n, np.int64), 0
        for rows in parts:
            own = place[at : at + rows.num_rows]
            at += rows.num_rows
            kept = np.flatnonzero(own >= 0)
            own, done = own[kept], 0
            for part in kernels.pieces([rows.select(["text"]).take(pa.array(kept))], "text"):
                h, bound = shingles(*kernels.column(part.column("text")))
                here = own[done : done + part.num_rows]
                size[here] = np.diff(bound)
                hs.append(h)
                docs.append(np.repeat(here, np.diff(bound)))
                done += part.num_rows
        h, doc = np.concatenate(hs), np.concatenate(docs)
        inside = (half == 2).all()
        left = np.arange(n) if inside else np.flatnonzero(half == 0)
        right = np.arange(n) if inside else np.flatnonzero(half == 1)
        links, i, j = np.zeros(n, np.int64), [], []
        if len(left) and len(right):
            for s in range(0, len(left), 512):
                own = left[s : s + 512]
                both = _intersections(h, doc, n, own, right)
                near = both * THRESHOLD[1] >= THRESHOLD[0] * (size[own][:, None] + size[right] - both)
                near &= own[:, None] != right
                links[own] += near @ copies[right]
                if not inside:
                    links[right] += copies[own] @ near
                a, b = np.nonzero(near)
                i.append(own[a])
                j.append(right[b])
        label = _labels(n, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (i, j)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[label])], ["node", "links", "label"])

    now, held = None, []
    for batch in batches:
        keys = batch.column("grp").to_numpy()
        bounds = kernels.runs(keys)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if keys[s] != now and held:
                yield group(held)
                held = []
            now = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield group(held)


def few(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def candidates(nodes: DataFrame, at: str, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between nodes that share a bucket and look alike, by chosen paths. ``nodes``: node, sketch."""
    edges = None
    rows = nodes.mapInArrow(_roots(runs_for(recall)), "path long, node long, check binary")
    for depth in range(1, DEPTH + 1):
        # One shuffle a level, of rows of fixed size; a bucket's rows meet in order of arrival.
        met = rows.repartition("path").sortWithinPartitions("path").mapInArrow(_buckets(LEADERS if depth < DEPTH else None), "kind int, a long, b long")
        found = shared.written(met, f"{at}/level{depth}")
        own = found.filter("kind = 0").select("a", "b").distinct()
        edges = own if edges is None else edges.unionAll(own)
        alone = found.filter("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("node"))
        shared.free_shuffles(nodes.sparkSession)
        if alone.isEmpty():
            break
        rows = alone.join(nodes, "node").select("path", "node", "sketch").mapInArrow(_deeper, "path long, node long, check binary")
    return edges


def jaccard_join(docs: DataFrame, at: str, recall: float = RECALL) -> DataFrame:
    """From doc_id and text: row, doc_id, h (xxhash64 of the text), class_id (smallest doc_id), class_row (smallest row), n_links, n_shingles. ``at``: a shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = texts.mapInArrow(_sets, "doc_id long, h long, k1 long, k2 long, n long, sketch binary")
    sets = shared.written(found.withColumn("row", F.monotonically_increasing_id()), f"{at}/sets")
    keys = sets.filter("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    members = shared.written(sets.drop("sketch").join(keys, ["k1", "k2"], "left").withColumns({"node": F.coalesce("node", "row"), "copies": F.coalesce("copies", F.lit(1).cast("long"))}), f"{at}/members")
    own = members.filter("row = node and n > 0")
    nodes = shared.written(sets.select("row", "sketch").join(own.select("row", "node"), "row").select("node", "sketch"), f"{at}/nodes")
    near = components(candidates(nodes, at, recall), f"{at}/near")
    near = shared.written(near.groupBy("label").count().join(near, "label"), f"{at}/candidates")
    # Candidates meet their components; in large ones, blocks of nodes meet in pairs.
    key = F.coalesce("doc_id", F.lit(-(2**63)))  # rows without doc_id meet as well
    wanted = near.join(own, "node").select("node", "label", "count", key.alias("k"), "h", "copies")
    shared.free_shuffles(spark)
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meet = texts.withColumn("k", key).join(few(wanted), ["k", "h"]).withColumn("blocks", blocks).withColumn("block", block)
    meet = meet.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    half = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    meet = meet.select(F.xxhash64("label", low, high).alias("grp"), "node", "copies", half.alias("half"), "text")
    exact = shared.written(meet.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verify, "node long, links long, label long"), f"{at}/exact")
    linked = exact.filter("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(exact.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")), f"{at}/classes")
    out = members.join(linked, "node", "left").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = out.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("class_row"))
    n_links = F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    return out.join(least, "label").select("row", "doc_id", "h", "class_id", "class_row", n_links.alias("n_links"), F.col("n").alias("n_shingles"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs, shared.folder(spark, "op1")).select("doc_id", "class_id", "n_links", "n_shingles")
