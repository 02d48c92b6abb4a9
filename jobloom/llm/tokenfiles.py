"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Ids are renumbered by falling frequency over all documents, so that the most
frequent take one byte. Four numbers share a control byte of two bits each (the
number of data bytes less one); control and data bytes lie apart, and a table
of 256 rows gives the four lengths of each control byte when decoding.

A file holds the documents of one range of doc_id, in ascending order, as framed
blocks (byte count, then named arrays); file numbers ascend with doc_id. Three
passes: texts are dealt to ranges by doc_id and encoded into raw files while ids
are counted (the only shuffle, of texts); raw files are recoded by rank; the
result is read back. Every file is written under a passing name and renamed when
whole, under a name that depends on its range alone, so a repeated task does no
harm; all of them lie in the shared folder.

A source, an id or a group of copies that holds a third of all rows does not
matter: ranges are even in rows, and those of one id lie in neighbouring ones.
The count table is bounded by the vocabulary.

Defined results: a null text is empty and has the end id only; null doc_ids come
first; equal doc_ids keep all their rows, side by side; extra columns are left
out; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm import kernels, shared
from jobloom.llm.bpe import public_path
from jobloom.llm.pretokens import Store

END_ID = 0
#: Bytes of text that a range (and so a file) should have.
RANGE_BYTES = 48 << 20
_SHIFTS = np.arange(4, dtype=np.uint32) * 8
#: Of each control byte: the lengths of its four numbers.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1).astype(np.uint8)


def pack_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    n = numbers.astype(np.uint32)
    size = 1 + (n > 0xFF).astype(np.uint8) + (n > 0xFFFF) + (n > 0xFFFFFF)
    four = np.ones(-(-len(n) // 4) * 4, np.uint8)
    four[: len(n)] = size
    code = (four - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    four_bytes = np.ascontiguousarray(n.astype("<u4")).view(np.uint8).reshape(-1, 4)
    data = four_bytes[np.arange(4) < size[:, None]]
    return control.astype(np.uint8), data


def unpack_numbers(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(size > k)
        out[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Frames:
    """Framed blocks of arrays, written to a shared file that appears when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = shared._fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)

    def add(self, **arrays: np.ndarray) -> None:
        block = shared.pack(**arrays)
        self.out.write(np.uint64(len(block)).tobytes() + block)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def frames(uri: str) -> Iterator[dict[str, np.ndarray]]:
    fs, path = shared._fs(uri)
    with fs.open_input_stream(path) as f:
        while head := f.read(8):
            yield shared.unpack(f.read(int(np.frombuffer(head, np.uint64)[0])))


def library(path: str):
    """Encodes pre-tokens with the tokenizers library; the special token's string is a pre-token of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        lists: list[list[int]] = []
        for i in range(0, len(begin), 4096):
            part = [raw[a:b].decode() for a, b in zip(begin[i : i + 4096].tolist(), end[i : i + 4096].tolist(), strict=True)]
            lists += [x.ids for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(size.sum())), size

    special = next(iter(t.content for t in tokenizer.get_added_tokens_decoder().values()), None)
    return encode, special, tokenizer.get_vocab_size()


def raw_files(docs: DataFrame, at: str, path: str, ranges: int) -> DataFrame:
    """Encode and count; writes at/raw/<range>. Rows: part (the range), id (-1: all ids of the range), n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special, size = library(path)
        store, part, out, total = Store(encode), TaskContext.get().partitionId(), None, 0
        counts = np.zeros(size, np.int64)
        for batch in kernels.pieces(batches, "text", 2 << 20):
            out = out or Frames(f"{at}/raw/{part:08d}")
            ids, count = store.batch(*kernels.column(batch.column("text")), special)
            ids = np.insert(ids, np.cumsum(count), END_ID)
            counts += np.bincount(ids, minlength=size)
            total += len(ids)
            key = batch.column("doc_id")
            out.add(doc=key.fill_null(0).to_numpy(), null=np.asarray(key.is_null()).astype(np.uint8), count=(count + 1).astype(np.uint32), ids=ids.astype(np.uint16 if size <= 1 << 16 else np.uint32))
        if out:
            out.done()
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some) + 1, part)), pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], ["part", "id", "n"])

    # Rows of one id, and equal rows, are dealt to neighbouring ranges by hashes of their text and place.
    order = [F.col("doc_id").asc_nulls_first(), "hash", "place"]
    placed = docs.withColumns({"hash": F.xxhash64("text"), "place": F.xxhash64(F.monotonically_increasing_id())}).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(work, "part long, id long, n long")


def ranked_files(parts: DataFrame, at: str, rank: np.ndarray, tasks: int) -> DataFrame:
    """Recode at/raw/<range> by rank into at/ids/<range>; the raw file goes. Rows: part, start, mb."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for part in batch.column("part").to_pylist():
                raw, to, size = f"{at}/raw/{part:08d}", f"{at}/ids/{part:08d}", 0
                fs, local = shared._fs(raw)
                if fs.get_file_info(local).type != 0 or fs.get_file_info(shared._fs(to)[1]).type == 0:
                    out = Frames(to)
                    for x in frames(raw):
                        control, data = pack_numbers(rank[x["ids"]])
                        out.add(doc=x["doc"], null=x["null"], count=x["count"], control=control, data=data)
                        size += len(control) + len(data)
                    out.done()
                    fs.delete_file(local)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("start"), pa.array(sizes, pa.int64())], ["part", "start", "bytes"])

    return parts.repartition(tasks, "part").mapInArrow(work, "part long, start long, bytes long")


def read_files(parts: DataFrame, at: str, tasks: int, with_ids: bool = False) -> DataFrame:
    """Rows of (part, start) -> doc_id, start, n_tokens, ids_crc32 (and ids), decoded from at/ids/<range>."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = shared.unpack(shared.get(f"{at}/ids/ranks"))["id"]
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for x in frames(f"{at}/ids/{part:08d}"):
                    count = x["count"].astype(np.int64)
                    ids = by_rank[unpack_numbers(x["control"], x["data"], int(count.sum()))]
                    bound = np.concatenate([[0], np.cumsum(count)])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]
                    out = [pa.array(x["doc"], mask=x["null"].astype(bool)), pa.array(start + bound[:-1]), pa.array(count), pa.array(crc, pa.int64())]
                    start += int(bound[-1])
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(bound.astype(np.int32), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in fields.split(", ")])

    return parts.repartition(tasks, "part").mapInArrow(work, fields)


def write_tokens(docs: DataFrame, at: str, path: str) -> DataFrame:
    """Encode all ``text`` in order of doc_id into files below ``at``; returns the files: part, start (ids before it), bytes."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    ranges = max(spark.sparkContext.defaultParallelism, min(200_000, 2 * size // RANGE_BYTES))
    counted = shared.written(raw_files(docs, at, path, ranges), f"{at}/counts")
    shared.free_shuffles(spark)
    totals = counted.filter("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    by_rank = np.array([r.id for r in totals.select("id").collect()], np.int64)  # bounded by the vocabulary
    shared.put(f"{at}/ids/ranks", shared.pack(id=by_rank.astype(np.uint32)))
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a file
    parts = counted.filter("id = -1").select("part", before.alias("start"))
    return shared.written(ranked_files(parts, at, rank, ranges), f"{at}/files")


def op10(spark, sf_dir: str) -> DataFrame:
    at = shared.folder(spark, "op10")
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), at, public_path())
    return read_files(files, at, max(spark.sparkContext.defaultParallelism, files.count()))
