"""Postings added by hand: canonical address, refusal of what is stored, warnings, and no rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom import schemas
from jobloom.functions import text
from jobloom.operators import board, screen, store


def add(details: DataFrame, rows: DataFrame, now: str, update: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new details, report) of rows in schemas.POSTING.

    The report has url, added, twin (another stored posting of the same company,
    title and place) and failing (screens that the row fails, for information): a
    row added by hand always passes. Stored addresses are refused unless ``update``.
    """
    rows = rows.withColumn("url", text.canonical_url(F.col("url"))).withColumn("source", F.coalesce("source", F.lit("manual")))
    fresh = screen.enrich(rows)
    fresh = fresh.withColumns({"failing": F.array_join(screen.failing_reasons(), "+"), "fetched_at": F.lit(now), "passed_filters": F.lit(True), "last_listed_at": F.lit(None).cast("string"), "duplicate_of": F.lit(None).cast("string")})
    known = details.select("url").distinct().withColumn("__known", F.lit(True))
    fresh = fresh.join(known, "url", "left").withColumn("added", F.lit(update) | F.col("__known").isNull())
    report = fresh.select("url", "added", "failing").join(board.twins(fresh, details), "url", "left")
    return store.replace(details, fresh.filter("added").select(*schemas.JOB_DETAILS.names)), report.select("url", "added", "twin", "failing")
