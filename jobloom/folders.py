"""Folders that the driver and all executors share, for what is kept between jobs.

They lie below ``spark.checkpoint.dir``. Only a local session that has not set it
(tests, a laptop) gets a folder of the machine; elsewhere that is an error, since
executors would write where nobody reads.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, SparkSession] = {}
#: Rows of a table that a join may send to every worker.
FEW = 10_000


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"jobloom-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def folder(spark: SparkSession, name: str) -> str:
    """A new folder, deleted when the driver ends."""
    at = f"{root(spark)}/jobloom/{name}-{uuid.uuid4().hex}"
    _KEPT[at] = spark
    return at


def hadoop(spark: SparkSession, at: str):
    """Hadoop's FileSystem and Path of a URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop(spark: SparkSession, at: str) -> None:
    fs, path = hadoop(spark, at)
    fs.delete(path, True)
    _KEPT.pop(at, None)


def appear(spark: SparkSession, passing: str, final: str) -> bool:
    """Give a whole file its final name, in one step that replaces no file; False if the name is taken."""
    if final.startswith("file:"):
        source, target = ("/" + x.removeprefix("file:").lstrip("/") for x in (passing, final))
        try:
            os.link(source, target)  # FileContext looks before it renames on local and mounted folders; a link does not
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(path(passing), path(final), none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        drop(spark, passing)
        return False


def written(df: DataFrame, at: str) -> DataFrame:
    """The rows of ``df``, written as Parquet: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def beside(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table as a side of joins: of more than FEW rows it is shuffled, never sent to every worker by way of the driver.

    Spark goes by the size of a table's files, which for narrow columns of
    compressed ones is a small part of what they take in memory. ``rows``: how many
    there are, if that is known.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > FEW else df


@atexit.register
def _last() -> None:
    for at, spark in list(_KEPT.items()):
        try:
            drop(spark, at)
        except Exception:  # the session has ended: its folder is left to the cluster's own clean-up
            _KEPT.pop(at, None)
