"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Each source's documents are shuffled by a digest of their id; a source may give
each document up to ``EPOCHS`` times, the second round after the first. A
document's virtual finish time is the tokens that its source has given up to and
with it, divided by the source's target; all copies are put in order of finish
time and cut off where the total budget is spent.

No source is ever gathered in one task: prefix sums are taken over
(source, digest bucket), of which only the sums meet, and the global order is
cut by finish-time bins before the one bin in which the budget ends is ordered.

Defined results: a null or empty text has size 0, costs nothing, and is taken 0
times; a null source is a source of its own, last in order; ties in finish time
go by source, round and digest; an empty table stays empty. Null and repeated ids
are documents of their own: where an id (or null) occurs more than once, the
digest is of the text's hash and of the row's number among equal rows as well, so
each row has its own place, and which of equal rows is taken does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm import shared

#: Weights that the sources get in turn, in order of their code points.
WEIGHTS = (5, 2, 1)
#: Percent of all sizes that the mix holds, and how often a document can be taken.
PERCENT, EPOCHS = 150, 2
#: Hex digits of the digest that make a bucket of a source's shuffled order.
BUCKET_DIGITS = 3
#: Bins of the finish time between 0 and 1.
BINS = 65536
#: Buckets in which equal rows are numbered, and salts of the rows that meet the table of repeated ids.
NUMBERED, SALTS = 1024, 16
#: Sources that may be broadcast: about 8 MB.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = EPOCHS) -> DataFrame:
    """From (source, size) rows: source, source_size, target, rank. Water-filling: targets stop at ``most`` times the source's size, the excess is shared by weight.

    Sources fill up in order of size per weight, so one ordered pass over the
    sources' sums finds the level; no loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("budget", F.least(F.sum("source_size").over(every) * F.lit(percent / 100.0), F.sum("cap").over(every)))
    per = per.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # A source fills up if its cap is below its share of what those before it have left.
    per = per.withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    first_open = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("rank"), (F.col("left") / F.col("open")).alias("level")))).over(every)
    per = per.withColumn("level", first_open["level"])
    return per.select("source", "source_size", "rank", F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"), "budget")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (each with a ``row`` of its own) with their ``number`` among those of equal keys; no group is counted in one task."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("row"), F.lit(NUMBERED)))
    sums = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__own"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    met = F.col("__part") == F.col("__own")
    for k in keys:
        met &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("row"))
    rows = rows.withColumn("number", inside - 1).join(sums, met)
    return rows.withColumn("number", F.col("number") + F.col("__before")).drop("__part", "__own", "__before", *(f"__{k}" for k in keys))


def told_apart(sizes: DataFrame, at: str) -> DataFrame:
    """``sizes`` with ``label``: empty where the id occurs once, else the text's hash and the row's number among equal rows."""
    again = sizes.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
    if again.isEmpty():
        return sizes.withColumn("label", F.lit(""))
    rows = sizes.withColumn("__own", F.pmod("row", F.lit(SALTS)).cast("int"))
    rows = rows.join(again, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__salt")), "left")
    marked = shared.written(rows.select(*sizes.columns, F.col("__salt").isNotNull().alias("again")), f"{at}/marked")
    once = marked.filter("not again").drop("again").withColumn("label", F.lit(""))
    more = numbered(marked.filter("again").drop("again"), ["doc_id", "source", "text_hash"])
    return shared.written(once.unionByName(more.withColumn("label", F.concat_ws(":", F.lit(""), "text_hash", "number")).drop("number")), f"{at}/labelled")


def shuffled_key(doc_id: Column, label: Column, epoch: Column) -> Column:
    return F.md5(F.concat(epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")), label))


def copies(sizes: DataFrame, per: DataFrame, few: bool, epochs: int = EPOCHS) -> DataFrame:
    """row, size, budget, rank, epoch, key, finish of every copy of a document with words that could be taken."""
    own = per.withColumnRenamed("source", "__source")
    near = sizes.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__source"))).filter("size > 0")
    each = near.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    each = each.withColumn("key", shuffled_key(F.col("doc_id"), F.col("label"), F.col("epoch")))
    each = each.withColumn("bucket", F.concat(F.col("epoch").cast("string"), F.substring("key", 1, BUCKET_DIGITS)))
    sums = each.groupBy("rank", "bucket").agg(F.sum("size").alias("own"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("rank").alias("__rank"), F.col("bucket").alias("__bucket"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("own", F.sum("size").over(inside))
    each = each.join(offsets, (F.col("rank") == F.col("__rank")) & (F.col("bucket") == F.col("__bucket")))
    return each.select("row", "size", "budget", "rank", "epoch", "key", ((F.col("offset") + F.col("own")).cast("double") / F.col("target")).alias("finish"))


def taken_copies(each: DataFrame) -> DataFrame:
    """The copies that come first in order of finish time, as far as the budget goes."""
    binned = each.withColumn("bin", F.floor(F.col("finish") * BINS).cast("long"))
    sums = binned.groupBy("bin").agg(F.sum("size").alias("own"), F.first("budget").alias("budget"))
    upto = F.sum("own").over(Window.orderBy("bin"))
    cut = sums.withColumn("before", upto - F.col("own")).filter(F.col("before") + F.col("own") > F.col("budget")).agg(F.min(F.struct("bin", "before")).alias("cut"))
    cut = cut.select(F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))  # one row; null where the budget takes all
    near = binned.join(F.broadcast(cut), F.lit(True))
    whole = near.filter(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")))
    part = near.filter(F.col("bin") == F.col("cut_bin"))
    order = Window.partitionBy("bin").orderBy("finish", "rank", "epoch", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("__sum", F.sum("size").over(order) + F.col("before")).filter("__sum <= budget").drop("__sum")
    return whole.unionByName(part).select("row", "size")


def mix(docs: DataFrame, at: str, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, n_taken (copies), taken (words) of every row. ``at``: a shared folder for sizes and finish times."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), n_words(text).alias("size"))
    sizes = told_apart(shared.written(rows.withColumn("row", F.monotonically_increasing_id()), f"{at}/sizes"), at)
    per = shared.written(targets(sizes, weights, percent, epochs), f"{at}/targets")
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    each = shared.written(copies(sizes, per, few, epochs), f"{at}/copies")
    got = taken_copies(each).groupBy("row").agg(F.count("*").alias("n_taken"), F.sum("size").alias("taken"))
    own = per.select(F.col("source").alias("__source"), "source_size", "target")
    out = sizes.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("__source"))).join(got, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("n_taken", zero).alias("n_taken"), F.coalesce("taken", zero).alias("taken"))


#: DuckDB: the same mix, with one window over all copies.
SQL = rf"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size FROM documents),
p0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
p1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM p0),
p2 AS (SELECT *, ([{", ".join(f"{w}.0" for w in WEIGHTS)}])[rank % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {float(EPOCHS)}::DOUBLE AS cap FROM p1),
p3 AS (SELECT *, least(sum(source_size) OVER () * ({PERCENT} / 100.0)::DOUBLE, sum(cap) OVER ()) AS budget,
              sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
              coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM p2),
p4 AS (SELECT *, budget - filled AS room, cap * open <= (budget - filled) * weight AS is_full FROM p3),
p5 AS (SELECT *, (SELECT room / open FROM p4 WHERE NOT is_full ORDER BY cap / weight, rank LIMIT 1) AS level FROM p4),
t AS (SELECT source, source_size, rank, budget, CASE WHEN is_full OR level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM p5),
c AS (SELECT s.doc_id, s.size, t.budget, t.rank, t.target, e.epoch, md5(e.epoch::VARCHAR || ':' || coalesce(s.doc_id::VARCHAR, 'null')) AS key
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source, (VALUES {", ".join(f"({e})" for e in range(EPOCHS))}) e(epoch) WHERE s.size > 0),
f AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY epoch, key, doc_id)::DOUBLE / target AS finish FROM c),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, key, doc_id) AS upto FROM f),
g AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM k WHERE upto <= budget GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (doc_id)"""


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, shared.folder(spark, "op8")).select("doc_id", "size", "source_size", "target", "taken")
