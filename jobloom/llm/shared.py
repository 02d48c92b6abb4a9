"""Folders that the driver and all executors share, and the files in them.

Everything an operator keeps between jobs lies below ``spark.checkpoint.dir``
(see ``jobloom.folders``, which refuses a cluster that has not set it).
"""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from jobloom.folders import root

_LIVE: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator; ``release`` deletes it."""
    at = f"{root(spark)}/jobloom/{name}-{uuid.uuid4().hex}"
    _LIVE[at] = spark
    return at


def hadoop(spark: SparkSession, at: str):
    """Hadoop's FileSystem and Path of a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete what earlier runs keep. Only for when their results were read or written."""
    for at in [x for x in _LIVE if not x.startswith(keep)] if keep else list(_LIVE):
        drop(spark, at)
    free_shuffles(spark)


def drop(spark: SparkSession, at: str) -> None:
    fs, path = hadoop(spark, at)
    fs.delete(path, True)
    _LIVE.pop(at, None)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files that no frame refers to any more."""
    for _ in range(2):  # the cleaner works beside the driver
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def written(df: DataFrame, at: str) -> DataFrame:
    """The rows of ``df``, written as Parquet: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@atexit.register
def _last() -> None:
    for at, spark in list(_LIVE.items()):
        try:
            drop(spark, at)
        except Exception:  # the session has ended: a job's folder is left to the cluster's own clean-up
            _LIVE.pop(at, None)


# Files that Python workers write and read -------------------------------------------------


def _fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data) -> None:
    """Write one file under its final name only when it is whole, so a repeated task does no harm."""
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(memoryview(data).cast("B") if not isinstance(data, bytes) else data)
    fs.move(part, path)


def get(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file as a memory map; of a remote file, a local copy whose name is gone at once."""
    fs, path = _fs(uri)
    if uri.startswith("file:"):
        if not os.path.getsize(path):
            return np.zeros(0, np.uint8)
        return np.memmap(path, np.uint8, "r")
    with tempfile.NamedTemporaryFile() as local:
        with fs.open_input_stream(path) as f:
            while block := f.read(8 << 20):
                local.write(block)
        local.flush()
        return np.memmap(local.name, np.uint8, "r") if local.tell() else np.zeros(0, np.uint8)


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one string of bytes; each starts at a multiple of 64."""
    head, body, at = [], io.BytesIO(), 0
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(f"{k}:{a.dtype.str}:{at}:{len(a)}")
        body.write(a.tobytes())
        at += a.nbytes
        body.write(b"\0" * (-at % 64))
        at += -at % 64
    top = ";".join(head).encode()
    return np.uint32(len(top)).tobytes() + top + b"\0" * (-(len(top) + 4) % 64) + body.getvalue()


def unpack(data) -> dict[str, np.ndarray]:
    """Views of the arrays in ``data`` (bytes or a memory map)."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview)) else data
    n = int(raw[:4].view(np.uint32)[0])
    start, out = (n + 4 + 63) // 64 * 64, {}
    for item in bytes(raw[4 : 4 + n]).decode().split(";") if n else []:
        k, kind, at, count = item.split(":")
        size = np.dtype(kind).itemsize * int(count)
        out[k] = raw[start + int(at) : start + int(at) + size].view(kind)
    return out
