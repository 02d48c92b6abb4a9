"""Connected components of an edge table in rounds that grow with the logarithm of the longest path.

Edges always point at a smaller node. A round first hangs each node's larger
neighbours on the smallest neighbour of all, then the node itself and its smaller
ones; stars are left when nothing changes. Smallest neighbours are partial
aggregates that are joined back, so a node with very many edges is no task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom import folders


def _hung_below(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours on its smallest neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _hung_above(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    smaller = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return smaller.unionAll(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, label) of every node with an edge (a, b) to another: the smallest node of its component. Rounds are written below the shared folder ``at``."""
    now = folders.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{at}/0")
    before, k = None, 0
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before, k = state, k + 1
        now = folders.written(_hung_above(_hung_below(now)), f"{at}/{k}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
