"""Removing repeated byte strings across all documents with a column-wise suffix structure.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier (in
a document earlier in order of doc_id, or earlier in its own). Strings never
cross documents and are judged on the input.

A transform over all whole texts would take as many rounds as the longest text
has bytes. So texts are cut into pieces between which no equal strings are lost:
every window of SPAN bytes belongs to the least hash among its substrings of
``ANCHOR`` bytes, and neighbouring windows with the same anchor make one piece,
of less than 2 * SPAN bytes. Equal windows have equal anchors. Then

1. copies of whole texts are found by digest; all but the first go entirely;
2. pieces are dealt out by anchor, without their bytes; of equal pieces all but
   the first go entirely (also within a batch, before the shuffle);
3. the different pieces of an anchor are one part of a collection of strings, of
   which ``bwt.collection`` builds the Burrows-Wheeler transform and the common
   prefixes, one symbol of each string in a round, through sequential files;
   neighbouring suffixes with SPAN bytes in common are equal windows, and all
   but the first of them go;
4. the spans of each document are united and cut out of its text.

Pieces of 1 to 3 are bounded, whatever the length of a text. Collections are
built for many anchors at a time, up to ``COLLECTION`` bytes.

Defined results: null texts are empty; texts below SPAN bytes lose nothing; ties
in doc_id go by the text's hash; of repeated rows (equal doc_id and text) the
first in order of their other columns' hash is the first; null doc_ids come
first; an empty table gives no rows; extra columns are ignored or, with
``with_text``, kept as they are, each row its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import bwt, kernels, shared
from jobloom.llm.jaccard_join import few
from jobloom.llm.kernels import U, mix, ragged

SPAN = 100
ANCHOR = 40
#: Bytes of pieces in one collection, unless one anchor has more; records in one part of the exchange; window starts handled at a time.
COLLECTION, PART, BLOCK = 2 << 20, 1_000_000, 1 << 21
_LOW = U((1 << 22) - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, U(2**64 - 1))
    full[: len(keys)] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, piece hash, document, start in it and number of windows of all pieces."""
    out = []
    hashes = kernels.Hashes(data)
    rolling = hashes.rolling(ANCHOR)
    width = SPAN - ANCHOR + 1
    for a in range(0, max(0, len(data) - SPAN + 1), BLOCK):
        b = min(len(data) - SPAN + 1, a + BLOCK)
        own = rolling[a : b + width - 1]
        best = a + (_least(own & ~_LOW | np.arange(len(own), dtype=U), width) & _LOW).astype(np.int64)
        doc = np.searchsorted(off, np.arange(a, b), "right") - 1 if len(off) > 2 else np.zeros(b - a, np.int64)
        valid = np.arange(a, b) + SPAN <= off[doc + 1]
        new = valid.copy()
        new[1:] &= (best[1:] != best[:-1]) | ~valid[:-1]
        start = np.flatnonzero(new)
        if not len(start):
            continue
        stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
        out.append((mix(rolling[best[start]]), start + a, stop - start, doc[start]))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(U), z.astype(U), z, z, z
    anchor, start, count, doc = (np.concatenate(x) for x in zip(*out, strict=True))
    return anchor, hashes.of(start, start + count + SPAN - 1), doc, start - off[doc], count


def _deal(parts: int):
    """Rows (part, blob): records of the pieces by anchor; below 0, spans that go at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches, "text"):
            anchor, piece, doc, start, count = pieces_of(*kernels.column(batch.column("text")))
            if not len(anchor):
                continue
            seq = batch.column("seq").to_numpy()[doc]
            order = np.lexsort((start, seq, piece))
            first = np.append(True, piece[order][1:] != piece[order][:-1])
            gone, keep = order[~first], order[first]
            keep.sort()
            part = (anchor[keep] >> U(32)).astype(np.int64) * parts >> 32
            key, blob = [], []
            for p, rows in kernels.split_by(part, parts):
                r = keep[rows]
                docs, at = np.unique(seq[r], return_inverse=True)
                key.append(p)
                blob.append(shared.pack(anchor=anchor[r], piece=piece[r], docs=docs, doc=at.astype(np.uint32), start=start[r].astype(np.uint32), count=count[r].astype(np.uint8)))
            if len(gone):
                gone = gone[np.lexsort((start[gone], seq[gone]))]
                key.append(-1 - int(seq[gone[0]] % 64))
                blob.append(shared.pack(seq=seq[gone], start=start[gone].astype(np.uint32), size=(count[gone] + SPAN - 1).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

    return work


_SPANS = "kind int, seq long, start int, size int, anchor long"


def _rows(kind: int, seq, start, size, anchor) -> pa.RecordBatch:
    n = len(seq)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(seq, pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.zeros(n, np.int64) if anchor is None else anchor.view(np.int64))], ["kind", "seq", "start", "size", "anchor"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By part: kind 0, spans that go as copies of an equal piece; kind 1, the different pieces of anchors that have several."""
    for part, blobs in kernels.groups(batches):
        if part < 0:
            for x in map(shared.unpack, blobs):
                yield _rows(0, x["seq"], x["start"], x["size"], None)
            continue
        found = [shared.unpack(b) for b in blobs]
        seq = np.concatenate([x["docs"][x["doc"]] for x in found])
        anchor, piece, start, count = (np.concatenate([x[k] for x in found]) for k in ("anchor", "piece", "start", "count"))
        del found, blobs
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        if not (a[1:] == a[:-1]).any():
            continue
        twice = np.append(a[1:] == a[:-1], False)
        twice[1:] |= twice[:-1].copy()
        order = order[twice]
        order = order[np.lexsort((start[order], seq[order], piece[order], anchor[order]))]
        a, p = anchor[order], piece[order]
        same = np.append(False, (a[1:] == a[:-1]) & (p[1:] == p[:-1]))
        gone = order[same]
        if len(gone):
            yield _rows(0, seq[gone], start[gone], count[gone].astype(np.int64) + SPAN - 1, None)
        order, a = order[~same], a[~same]  # never empty: a piece is left of each anchor
        several = np.append(a[1:] == a[:-1], False)
        several[1:] |= several[:-1].copy()
        r = order[several]
        if len(r):
            yield _rows(1, seq[r], start[r], count[r].astype(np.int64) + SPAN - 1, anchor[r])


def _fetch(parts: int):
    """Rows (part, blob): the bytes of the wanted pieces (seq, text, refs) by anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches, "text"):
            data, off = kernels.column(batch.column("text"))
            refs = batch.column("refs")
            n = np.diff(refs.offsets.to_numpy())
            flat = refs.flatten()
            anchor, start, size = flat.field("anchor").to_numpy().view(U), flat.field("start").to_numpy().astype(np.int64), flat.field("size").to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            seq = batch.column("seq").to_numpy()[doc]
            key, blob = [], []
            for p, r in kernels.split_by((anchor >> U(32)).astype(np.int64) * parts >> 32, parts):
                key.append(p)
                blob.append(shared.pack(anchor=anchor[r], seq=seq[r], start=start[r].astype(np.uint32), size=size[r].astype(np.uint8), bytes=data[ragged(off[doc[r]] + start[r], size[r])]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

    return work


def repeated_windows(data: np.ndarray, at: np.ndarray, size: np.ndarray, seq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings data[at:at+size], which lie at ``start`` in document ``seq``: (string, offset) of each window of SPAN bytes that an earlier window equals."""
    string, offset, common = bwt.collection(data, at, size, SPAN)
    inside = (size[string] - offset >= SPAN)
    group = np.cumsum(~((common >= SPAN) & inside))
    string, offset, group = string[inside], offset[inside], group[inside]
    order = np.lexsort((start[string] + offset, seq[string], group))
    string, offset, group = string[order], offset[order], group[order]
    if not len(string):
        return string, offset
    # Overlapping pieces never share a window, so equal places do not occur but for repeated rows.
    later = np.append(False, group[1:] == group[:-1])
    where, own = start[string] + offset, seq[string]
    head = np.flatnonzero(~later)
    of = np.cumsum(~later) - 1
    later &= (where != where[head][of]) | (own != own[head][of])
    return string[later], offset[later]


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By part: spans (kind 0) of repeated windows, from the transform of the part's pieces."""
    for _, blobs in kernels.groups(batches):
        found = [shared.unpack(b) for b in blobs]
        anchor, seq, start, size, data = (np.concatenate([x[k] for x in found]) for k in ("anchor", "seq", "start", "size", "bytes"))
        del found, blobs
        start, size = start.astype(np.int64), size.astype(np.int64)
        at = np.cumsum(size) - size
        order = np.argsort(anchor, kind="stable")
        bounds = kernels.runs(anchor[order])
        filled = np.concatenate([[0], np.cumsum(size[order])])[bounds]
        i = 0
        while i < len(bounds) - 1:
            j = max(i + 1, int(np.searchsorted(filled, filled[i] + COLLECTION, "right")) - 1)
            rows = order[bounds[i] : bounds[j]]
            own = data[ragged(at[rows], size[rows])]
            string, offset = repeated_windows(own, np.cumsum(size[rows]) - size[rows], size[rows], seq[rows], start[rows])
            if len(string):
                o = np.lexsort((offset, string))
                string, offset = string[o], offset[o]
                new = np.append(True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))
                head = np.flatnonzero(new)
                length = np.diff(np.append(head, len(string)))
                r = rows[string[head]]
                yield _rows(0, seq[r], start[r] + offset[head], length + SPAN - 1, None)
            i = j


def united(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + size)[order])
    new = np.append(True, s[1:] > e[:-1])
    head = np.flatnonzero(new)
    return s[head], e[np.append(head[1:] - 1, len(s) - 1)]


def whole_characters(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the bytes of characters that they cover in part only."""
    out = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(kept: list[str], with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches, "text", 8 << 20):
            n_bytes, n_removed, n_spans, digest, left = [], [], [], [], []
            for text, spans, is_copy in zip(batch.column("text"), batch.column("spans"), batch.column("is_copy").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if is_copy and len(raw) >= SPAN:
                    start, end = np.zeros(1, np.int64), np.full(1, len(raw))
                elif spans.is_valid:
                    start, end = united(spans.values.field("start").to_numpy().astype(np.int64), spans.values.field("size").to_numpy().astype(np.int64))
                if with_text:
                    start, end = whole_characters(raw, start, end)
                n_bytes.append(len(raw))
                n_removed.append(int((end - start).sum()))
                n_spans.append(len(start))
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    left.append(rest.decode("utf-8", "replace"))
            out = [*(batch.column(c) for c in kept), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(left, pa.string())] * with_text, [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    return work


def remove_repeats(docs: DataFrame, at: str, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``with_text`` also kept_text, for which spans shrink to whole characters, and all other columns of ``docs``. ``at``: a shared folder."""
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in extra)), {"ignoreNullFields": "false"})) if extra else F.lit(0).cast("long")
    base = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("__h"), others.alias("__o"), *(F.col(f"`{c}`").alias(f"__x{i}") for i, c in enumerate(extra)))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    digest = shared.written(base.select(key.alias("k"), "__h", "__o", F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("b")), f"{at}/digests")
    total, ids, size = digest.agg(F.count("*"), F.countDistinct("k"), F.sum("b")).first()
    if total == ids:  # doc_id is the order
        base = base.withColumn("seq", key)
        order = digest.withColumn("seq", F.col("k"))
    else:  # number the rows, and the repeats of each, in one order; ids of a sorted frame rise with it
        order = digest.groupBy("k", "__h", "g", "__o").count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).orderBy("k", "__h", "g", "__o", "copy")
        order = shared.written(order.select("k", "__h", "g", "__o", F.monotonically_increasing_id().alias("seq")), f"{at}/order")
        once = base.withColumn("k", key).dropDuplicates(["k", "__h", "__o"])
        base = once.join(order.select("k", "__h", "__o", "seq"), ["k", "__h", "__o"]).drop("k")
    first = order.groupBy("__h", "g").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = shared.written(order.join(first, ["__h", "g"]).filter("seq > first").select("seq", F.lit(True).alias("is_copy")), f"{at}/copies")
    # Pieces by anchor, without their bytes.
    firsts = base.select("seq", "text").join(few(copies.select("seq")), "seq", "left_anti")
    parts = max(2 * spark.sparkContext.defaultParallelism, (size or 0) // 30 // PART * 2)
    tasks = min(parts, 20_000)
    dealt = firsts.mapInArrow(_deal(parts), "part int, blob binary").repartition(tasks, "part").sortWithinPartitions("part")
    spans = shared.written(dealt.mapInArrow(_match, _SPANS), f"{at}/spans")
    shared.free_shuffles(spark)
    # The bytes of different pieces with an anchor in common.
    wanted = spans.filter("kind = 1")
    n = wanted.count()
    refs = wanted.groupBy("seq").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("refs"))
    meet = firsts.join(F.broadcast(refs) if n <= 200_000 else refs, "seq")
    parts = max(4 * spark.sparkContext.defaultParallelism, n // 10_000)
    tasks = min(parts, 20_000)
    fetched = meet.mapInArrow(_fetch(parts), "part int, blob binary").repartition(tasks, "part").sortWithinPartitions("part")
    more = shared.written(fetched.mapInArrow(_collections, _SPANS), f"{at}/windows")
    shared.free_shuffles(spark)
    every = spans.filter("kind = 0").unionAll(more).groupBy("seq").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    out = base.join(few(copies), "seq", "left").join(every, "seq", "left")
    kept = ["doc_id", *(f"__x{i}" for i in range(len(extra)))]
    types = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in kept)
    done = out.mapInArrow(_cut(kept, with_text), f"{types}, {_CUT}" + ", kept_text string" * with_text)
    return done.select("doc_id", *(F.col(f"__x{i}").alias(c) for i, c in enumerate(extra)), *(x.split()[0] for x in _CUT.split(", ")), *["kept_text"] * with_text)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, shared.folder(spark, "op6"))
