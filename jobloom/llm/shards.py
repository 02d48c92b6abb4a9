"""A store of immutable shards with size-tiered compaction and versioned manifests.

``append`` writes arrivals as small Parquet shards; ``compact`` merges shards of
similar size (a tier is a power of ``fan_in`` of bytes) into files of about
``target`` bytes; each commits one new version of the manifest, a table of the
shards that make up the snapshot. A version is one small file. It is written
under a passing name and gets its own by a step that never replaces a file (a
hard link on local and mounted folders, ``FileContext.rename`` elsewhere; stores
without such a rename need one writer), so readers see the old snapshot or the
new one and nothing between. A version file that is not whole is passed over and
its number is not used again. Shards are never changed; ``vacuum`` deletes those
that no kept version names, and what failed writers left.

Merging moves no row through a shuffle: a task reads the shards of one group and
writes one file, under a passing name until it is whole, so it can be repeated
anywhere. Groups are bounded by ``target``; a hot source only makes more of them.
The driver holds the paths of a snapshot, as for any Parquet table.

Defined results: all rows are kept, repeated ones too, with all columns and
nulls as they are; an empty table commits a version without new shards, and a
store without shards reads as no rows of its schema; rows from before a column
was added have null in it; a column that changes its type is an error of the
append.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobloom.llm import shared

#: Bytes of a full file and the number of shards of a tier that are merged at least.
TARGET, FAN_IN = 128 << 20, 4
_MANIFEST = "path string, bytes long, rows long, tier int, full boolean, version long"


class Conflict(Exception):
    """Another writer has committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, at: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.at, self.target, self.fan_in = spark, at, target, fan_in

    # Versions ------------------------------------------------------------------

    def _names(self) -> list[int]:
        fs, path = shared.hadoop(self.spark, f"{self.at}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit())

    def _head(self, version: int) -> dict | None:
        """What a version file says; None if it is not whole."""
        fs, path = shared.hadoop(self.spark, f"{self.at}/versions/{version:010d}")
        f = fs.open(path)
        try:
            return json.loads(bytes(f.readAllBytes()).decode() or "null")
        except ValueError:
            return None
        finally:
            f.close()

    def versions(self) -> list[int]:
        return [v for v in self._names() if self._head(v)]

    def _last(self, version: int | None = None) -> dict | None:
        if version is not None:
            return self._head(version)
        return next((h for v in reversed(self._names()) if (h := self._head(v))), None)

    def manifest(self, version: int | None = None) -> DataFrame:
        head = self._last(version)
        return self.spark.read.schema(_MANIFEST).parquet(head["manifest"]) if head else self.spark.createDataFrame([], _MANIFEST)

    def schema(self, version: int | None = None) -> StructType:
        head = self._last(version)
        return StructType.fromJson(head["schema"]) if head else StructType()

    def _commit(self, shards: DataFrame, version: int, schema: StructType) -> int:
        """Write the manifest, then make it the next version in one step."""
        table = f"{self.at}/manifests/{version:010d}-{uuid.uuid4().hex}"
        shards.select(*(x.split()[0] for x in _MANIFEST.split(", "))).coalesce(1).write.parquet(table)
        passing, final = f"{self.at}/versions/_{uuid.uuid4().hex}", f"{self.at}/versions/{version:010d}"
        fs, path = shared.hadoop(self.spark, passing)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps({"manifest": table, "schema": schema.jsonValue()}).encode()))
        out.close()
        try:
            self._place(passing, final)
        except Exception as e:
            if shared.hadoop(self.spark, final)[0].exists(shared.hadoop(self.spark, final)[1]):
                raise Conflict(version) from e
            raise
        finally:
            fs.delete(path, False)
        return version

    def _place(self, passing: str, final: str) -> None:
        """Give a whole file its name, unless another file has it."""
        if passing.startswith("file:"):
            os.link(*(shared._fs(x)[1] for x in (passing, final)))
            return
        jvm = self.spark._jvm
        path, rename = jvm.org.apache.hadoop.fs.Path, jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(final).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(path(passing), path(final), options)

    def _next(self) -> int:
        return (self._names() or [0])[-1] + 1

    def _tier(self, size):
        return F.greatest(F.floor(F.log(F.greatest(size, F.lit(1)) / F.lit(64 << 10)) / F.log(F.lit(float(self.fan_in)))), F.lit(0)).cast("int")

    def _listed(self, folder: str, version: int) -> DataFrame:
        """The files of a folder as manifest rows."""
        fs, path = shared.hadoop(self.spark, folder)
        if not fs.exists(path) or not any(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(path)):
            return self.spark.createDataFrame([], _MANIFEST)
        files = self.spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return files.withColumns({"tier": self._tier(F.col("bytes")), "full": F.col("bytes") >= self.target // 2, "version": F.lit(version).cast("long")})

    # Writing -------------------------------------------------------------------

    def append(self, arrivals: DataFrame) -> int:
        """Write the rows as small shards and commit them beside those of the last version."""
        version, schema = self._next(), _united(self.schema(), arrivals.schema)
        folder = f"{self.at}/data/{version:010d}-{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(folder)
        new = self._listed(folder, version)
        return self._commit(self.manifest().unionByName(new), version, schema)

    def plan(self) -> DataFrame:
        """path, bytes, grp: shards to be merged. Of each tier with ``fan_in`` shards or more, runs of shards up to the target size."""
        shards = self.manifest().filter("not full")
        order = Window.partitionBy("tier").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        runs = shards.withColumn("many", F.count("*").over(Window.partitionBy("tier"))).filter(F.col("many") >= self.fan_in)
        runs = runs.withColumn("grp", F.concat_ws("-", "tier", F.floor((F.sum("bytes").over(order) - 1) / F.lit(self.target)).cast("string")))
        size = F.count("*").over(Window.partitionBy("grp"))
        return runs.withColumn("n", size).filter("n > 1").select("path", "bytes", "grp")

    def compact(self) -> int | None:
        """Merge once and commit; None if nothing is to be merged."""
        version = self._next()
        groups = shared.written(self.plan(), f"{self.at}/plans/{version:010d}-{uuid.uuid4().hex}")
        tasks = groups.groupBy("grp").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        n = groups.select("grp").distinct().count()
        if not n:
            return None
        folder = f"{self.at}/data/{version:010d}-{uuid.uuid4().hex}"
        tasks.repartition(n, "grp").mapInArrow(_merge(folder), "path string").write.format("noop").mode("overwrite").save()
        kept = self.manifest().join(groups.select("path"), "path", "left_anti")
        return self._commit(kept.unionByName(self._listed(folder, version)), version, self.schema())

    def compact_all(self) -> int:
        """Merge until no tier has shards to be merged: the last version."""
        while self.compact() is not None:
            pass
        return self.versions()[-1]

    def vacuum(self, keep: int = 1, failed_after_hours: float = 24.0) -> None:
        """Delete, in parallel, data that none of the last ``keep`` versions names: of older versions at once; of failed or conflicting writers, which no version names, when it is ``failed_after_hours`` old."""
        known = self.versions()
        kept = known[-keep:]
        used = self.spark.createDataFrame([], "path string")
        for v in kept:
            used = used.unionAll(self.manifest(v).select("path"))
        for v in known[: len(known) - len(kept)]:
            old = self.manifest(v).select("path").join(used, "path", "left_anti").distinct()
            old.mapInArrow(_delete, "path string").write.format("noop").mode("overwrite").save()
            fs, path = shared.hadoop(self.spark, f"{self.at}/versions/{v:010d}")
            fs.delete(path, False)
        fs, path = shared.hadoop(self.spark, f"{self.at}/data")
        if fs.exists(path):
            there = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.at}/data").select("path", "modificationTime")
            there = there.filter(F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(3600.0 * failed_after_hours)))
            bare = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")  # listings and manifests write a scheme's slashes apart
            left = there.join(used.select(bare.alias("__p")), bare == F.col("__p"), "left_anti")
            left.select("path").mapInArrow(_delete, "path string").write.format("noop").mode("overwrite").save()

    # Reading -------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot in its schema; its paths are as many as its files."""
        paths = [r.path for r in self.manifest(version).select("path").collect()]
        schema = self.schema(version)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _united(old: StructType, new: StructType) -> StructType:
    """The columns of both; a type that has changed is an error."""
    out, have = StructType(list(old)), {f.name: f.dataType for f in old}
    for f in new:
        if f.name not in have:
            out.add(f.name, f.dataType, True)
        elif have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()} in the store, {f.dataType.simpleString()} in the rows")
    return out


def _fitted(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The rows in the columns of ``schema``, absent ones null."""
    there = set(rows.schema.names)
    return pa.RecordBatch.from_arrays([rows.column(f.name).cast(f.type) if f.name in there else pa.nulls(rows.num_rows, f.type) for f in schema], schema=schema)


def _merge(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for grp, paths in zip(batch.column("grp").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                to = f"{folder}/part-{grp}.parquet"
                fs, local = shared._fs(to)
                fs.create_dir(shared._fs(folder)[1], recursive=True)
                part = f"{folder}/{uuid.uuid4().hex}.part"  # only names in .parquet are listed
                schema = pa.unify_schemas([_schema(x) for x in paths])
                out = fs.open_output_stream(shared._fs(part)[1])
                writer = pq.ParquetWriter(out, schema, compression="zstd")
                for path in paths:
                    own, at = shared._fs(path)
                    with own.open_input_file(at) as f:
                        for rows in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(2000):
                            writer.write_batch(_fitted(rows, schema))
                writer.close()
                out.close()
                fs.move(shared._fs(part)[1], local)
                made.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return work


def _schema(path: str) -> pa.Schema:
    """A shard's columns, without Spark's own note of them; Spark's 96-bit timestamps are instants."""
    fs, at = shared._fs(path)
    with fs.open_input_file(at) as f:
        file = pq.ParquetFile(f)
        wide = {c.path for c in (file.schema.column(i) for i in range(len(file.schema))) if c.physical_type == "INT96"}
        return pa.schema([pa.field(x.name, pa.timestamp("us", "UTC") if x.name in wide else x.type) for x in file.schema_arrow])


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, at = shared._fs(path)
            if fs.get_file_info(at).type != 0:
                fs.delete_file(at)
        yield batch


#: Deliveries into which op3 deals the table, by a digest of doc_id.
ARRIVALS = 5


def op3(spark, sf_dir: str) -> DataFrame:
    """Append the documents in ARRIVALS deliveries, compact, and read the last version back: doc_id, shard, tier, version, text_hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, shared.folder(spark, "op3"))
    delivery = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.filter(delivery == k))
    last = store.compact_all()
    store.vacuum()
    rows = store.read(last).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("_metadata.file_path").alias("path"))
    shards = store.manifest(last).select("path", "tier", F.col("bytes").alias("shard_bytes"))
    return rows.join(shards, "path").select("doc_id", F.regexp_extract("path", "([^/]+)$", 1).alias("shard"), "tier", "shard_bytes", F.lit(last).cast("long").alias("version"), "text_hash")
