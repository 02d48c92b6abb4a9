"""Set operations on term arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def three_ways(terms: Column, on_cv: Column, in_master: Column) -> Column:
    """struct(on_cv, master_only, neither) of an array of terms."""
    return F.struct(F.array_intersect(terms, on_cv).alias("on_cv"), F.array_except(F.array_intersect(terms, in_master), on_cv).alias("master_only"), F.array_except(F.array_except(terms, on_cv), in_master).alias("neither"))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
