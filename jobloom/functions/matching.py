"""Regular expressions with match positions, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes and case folding, as the patterns were written for.
FLAGS = "(?iU)"


def has(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def names_that_match(text: Column, patterns: Mapping[str, str]) -> Column:
    """Array of the names whose pattern occurs, in their order; texts without any (most) are searched once, for all patterns together."""
    names = F.array_compact(F.array(*(F.when(has(text, p), F.lit(n)) for n, p in patterns.items())))
    return F.when(has(text, "(?:" + "|".join(patterns.values()) + ")"), names).otherwise(F.array().cast("array<string>"))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start int, match string>> of all matches, start from 0; the pattern must not match the empty string.

    Positions come from the lengths of the pieces between the matches.
    """
    p = FLAGS + pattern
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.split(text, p, -1)
    empty = F.array().cast("array<struct<start:int,match:string>>")
    walked = F.aggregate(
        F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), x["m"].alias("match")))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(has(text, pattern), walked).otherwise(empty)


def before(text: Column, start: Column, n: int) -> Column:
    """Up to ``n`` characters in front of position ``start`` (from 0)."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))
