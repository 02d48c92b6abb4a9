"""The stages of the corpus pipeline: each maps a table of documents to one, by one operator.

A stage is called when the result of the stage before has been written and read
again, so it first deletes what that stage's operator kept in the shared folder.
All stages but the last return the columns of ``documents``, whatever other
columns came in. Null texts are empty texts to every operator; a null doc_id is
an id like others; repeated rows and repeated ids are rows of their own to every
stage but the second, in which they are copies or links by their texts (texts
without words stay, each of them); an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import bpe, jaccard_join, mixing, quality, repeats, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _start(spark: SparkSession, docs: DataFrame) -> DataFrame:
    shared.release(spark)
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = _start(spark, docs)
    return quality.quality_rules(docs, out="__quality").filter("__quality.kept").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the one with the smallest doc_id."""
    docs = _start(spark, docs)
    found = shared.written(jaccard_join.jaccard_join(docs, shared.folder(spark, "join")), shared.folder(spark, "classes"))
    least = found.groupBy("class_row").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "row")).alias("m")).select(F.col("m.row").alias("row"))
    gone = found.join(least, "row", "left_anti")
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if found.select(F.countDistinct(key("doc_id")) == F.count("*")).first()[0]:
        ids = gone.select(key("doc_id").alias("__k"))
        return docs.withColumn("__k", key("doc_id")).join(jaccard_join.few(ids), "__k", "left_anti").select(*COLUMNS)
    # doc_id repeats: rows are told apart by their texts too. Equal rows are copies and one of them stays, but rows without words are classes of their own.
    kept = found.join(least, "row", "left_semi").select(key("doc_id").alias("__k"), F.col("h").alias("__h"), (F.col("n_shingles") > 0).alias("__copies")).distinct()
    rows = docs.withColumns({"__k": key("doc_id"), "__h": F.xxhash64(text)}).join(jaccard_join.few(kept), ["__k", "__h"])
    return rows.filter("__copies").dropDuplicates(["__k", "__h"]).unionByName(rows.filter("not __copies")).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated byte strings (whole characters of them); documents that lose everything go."""
    docs = _start(spark, docs)
    cut = repeats.remove_repeats(docs, shared.folder(spark, "repeats"), with_text=True)
    left = cut.filter("n_removed = 0 or n_removed < n_bytes")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times)."""
    docs = _start(spark, docs)
    same = {"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__s": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))}
    mixed = mixing.mix(docs, shared.folder(spark, "mix")).withColumns(same)
    per = mixed.groupBy("__k", "__s", F.col("text_hash").alias("__h")).agg(F.sum("n_taken").alias("__n"), F.count("*").alias("__rows")).filter("__n > 0")
    rows = docs.withColumns(same).withColumn("__h", F.xxhash64(F.col("text").cast("string"))).join(jaccard_join.few(per), ["__k", "__s", "__h"])
    copies = rows.filter("__rows = 1").drop("__rows")
    again = per.filter("__rows > 1")
    if not again.isEmpty():
        # Rows equal in id, source and text share what they were given: which of them comes once more does not matter.
        equal = shared.written(rows.filter("__rows > 1").withColumn("row", F.monotonically_increasing_id()), shared.folder(spark, "equal"))
        nth = mixing.numbered(equal, ["__k", "__s", "__h"])
        share = F.floor(F.col("__n") / F.col("__rows")) + (F.col("number") < F.col("__n") % F.col("__rows")).cast("long")
        copies = copies.unionByName(nth.withColumn("__n", share).filter("__n > 0").select(copies.columns))
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in the public 50k byte-level vocabulary."""
    docs = _start(spark, docs)
    return bpe.encode_decode(docs.select("doc_id", "text"), bpe.public_path())


def run(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    """Apply the stages to the table documents, each to the written result of the one before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    at = f"{shared.root(spark)}/jobloom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(stages):
        docs = shared.written(stage(spark, docs, sf_dir), f"{at}/{k}")
        if before:
            shared.drop(spark, before)
        before = f"{at}/{k}"
    shared._LIVE[at] = spark
    return docs
