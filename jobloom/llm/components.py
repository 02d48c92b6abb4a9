"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b: each node's neighbours (larger ones, or smaller ones and itself) are hung on its smallest neighbour.

    The smallest neighbour is a partial aggregate that is joined back, so no
    node's neighbours meet in one task unless the join finds them few.
    """
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return hung.filter("a > b").distinct()


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, label) of every node with an edge (a, b), label being its component's smallest node. Each round is written below ``at``."""
    now = shared.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), f"{at}/0")
    last, k = None, 0
    while True:
        k += 1
        now = shared.written(_star(_star(now, True), False), f"{at}/{k}")
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots.select("node", F.col("node").alias("label")))
