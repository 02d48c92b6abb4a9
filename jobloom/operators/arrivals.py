"""New postings against history, by url and by company-title-place key.

A posting is new if neither is known; one that is not new is not recorded, so it
blocks nothing after it. Within a batch this is sequential, but only along rows
that share a url or a key. Rows that are first in both are new at once, and what
shares a url or a key with these is not; a few such rounds of partial aggregates
and anti-joins settle nearly every batch. What is still in doubt (long chains, each
row hanging on the one before) is parted into the components of the graph of urls
and keys, found in the logarithm of their length, and each component is passed
through once in order. So the jobs do not grow with the chains.

A row without url shares none with other rows: it is judged by its key alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom import folders
from jobloom.functions.text import company_title_key
from jobloom.operators.components import components

#: Rounds that settle the first rows of every url and key, before components are passed through in order.
ROUNDS = 3


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("company_title_key", company_title_key(F.col("company"), F.col("title"), F.col("location")))


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of a keyed batch whose url and key are both unknown: two anti-joins, never a join on either."""
    return batch.join(seen.select("url").distinct(), "url", "left_anti").join(seen.select("company_title_key").distinct(), "company_title_key", "left_anti").select(batch.columns)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordinals of the new rows of components that come one after another, each in order. Holds the urls and keys of one component's new rows."""
    now, urls, keys = None, set(), set()
    for batch in batches:
        new = []
        for label, ordinal, url, key in zip(*(batch.column(c).to_pylist() for c in ("label", "ordinal", "u", "k")), strict=True):
            if label != now:
                now, urls, keys = label, set(), set()
            if url not in urls and key not in keys:
                urls.add(url)
                keys.add(key)
                new.append(ordinal)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], ["ordinal"])


def new_postings(batch: DataFrame, seen: DataFrame, at: str | None = None) -> DataFrame:
    """The new rows of a batch (url, company, title, location, a different ``ordinal`` each, ...), in arrival order by ``ordinal``.

    What the rounds find is written below the shared folder ``at`` (a new one by
    default), so none works out again what those before it did.
    """
    spark, n = batch.sparkSession, 0
    at = at or folders.folder(spark, "arrivals")

    def kept(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        return folders.written(df, f"{at}/{n}")

    rows = kept(unseen(with_key(batch), seen))
    size = rows.count()
    side = lambda df: folders.beside(df, size)
    # Nulls meet nobody: a url's stand-in is the row's own number, behind a sign that tells it from urls.
    alone = F.concat(F.lit("#"), F.col("ordinal").cast("string"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), alone)
    open_ = rows.select(F.col("ordinal").cast("long").alias("ordinal"), named("url").alias("u"), named("company_title_key").alias("k"))
    chosen = None
    for _ in range(ROUNDS):
        first = {c: open_.groupBy(c).agg(F.min("ordinal").alias("ordinal")).select("ordinal") for c in "uk"}
        new = kept(open_.join(side(first["u"]), "ordinal", "left_semi").join(side(first["k"]), "ordinal", "left_semi"))
        if chosen is None and new.count() == size:
            return rows
        chosen = new.select("ordinal") if chosen is None else chosen.unionAll(new.select("ordinal"))
        # Rows behind a new one in either are seen; the rest waits for those before it.
        open_ = kept(open_.join(side(new.select("u")), "u", "left_anti").join(side(new.select("k")), "k", "left_anti").select("ordinal", "u", "k"))
        if open_.isEmpty():
            return rows.join(side(chosen), "ordinal", "left_semi")
    edges = None
    for c in "uk":
        first = open_.groupBy(F.col(c).alias("__c")).agg(F.min("ordinal").alias("b"))
        own = side(open_).join(side(first), F.col(c) == F.col("__c")).filter("ordinal <> b").select(F.col("ordinal").alias("a"), "b")
        edges = own if edges is None else edges.unionAll(own)
    labels = components(edges, f"{at}/components")
    chained = side(open_).join(side(labels), open_.ordinal == labels.node, "left").select(F.coalesce("label", "ordinal").alias("label"), "ordinal", "u", "k")
    passed = kept(chained.repartition("label").sortWithinPartitions("label", "ordinal").mapInArrow(_in_order, "ordinal long"))
    return rows.join(side(chosen.unionAll(passed)), "ordinal", "left_semi")


def new_in_store(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """url, is_new against the store alone."""
    keyed = with_key(batch)
    new = unseen(keyed, seen).select("url", F.lit(True).alias("is_new")).distinct()
    return keyed.select("url").distinct().join(new, "url", "left").select("url", F.coalesce("is_new", F.lit(False)).alias("is_new"))
