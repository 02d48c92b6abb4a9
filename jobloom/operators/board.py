"""The review board and the queues: joins of the stored tables, filters, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import dates, text

#: The board's sort keys and their columns.
SORT_KEYS = {"score": "match_score", "company": "company", "title": "title", "location": "location", "source": "source", "posted": "posted_ts", "type": "employment_type", "rate": "day_rate_max", "language": "language_rank", "status": "my_status"}


def board(details: DataFrame, evaluations: DataFrame, statuses: DataFrame, tailorings: DataFrame | None = None, scans: DataFrame | None = None) -> DataFrame:
    """Postings that pass, with score, status and what else is known; best score first, unscored last."""
    rows = details.filter("passed_filters")
    rows = rows.join(evaluations.select("url", "match_score", "recommendation"), "url", "left").join(statuses.select("url", "my_status", "notes", "inherited_from"), "url", "left")
    for extra, columns in ((tailorings, ("cv_status",)), (scans, ("scan_verdict", "scan_coverage"))):
        if extra is not None:
            rows = rows.join(extra.select("url", *columns), "url", "left")
    rows = rows.withColumn("recommendation", F.coalesce("recommendation", F.lit("not_evaluated")))
    return rows.orderBy(F.desc_nulls_last("match_score"), "url")


def filter_board(rows: DataFrame, ai: str = "all", status: str = "all", kind: str = "all", language: str = "all", search: str = "") -> DataFrame:
    """The board's filters (F13). Type 'permanent' is everything but contract; language 'known' is everything but none."""
    ok: Column = F.lit(True)
    if ai != "all":
        ok &= F.col("recommendation") == ai
    if status != "all":
        ok &= F.col("my_status").isNull() if status == "none" else F.col("my_status") == status
    if kind != "all":
        contract = F.coalesce(F.col("employment_type") == "contract", F.lit(False))
        ok &= contract if kind == "contract" else ~contract
    tier = F.col("language_tier")
    ok &= {"all": F.lit(True), "priority": tier == "priority", "priority+": tier.isin("priority", "secondary"), "known": tier.isNotNull() & (tier != "none")}[language]
    if search.strip():
        ok &= F.lower(F.concat_ws(" ", "company", "title")).contains(search.strip().lower())
    return rows.filter(ok)


def windowed(rows: DataFrame, now: Column, window: str) -> DataFrame:
    """Rows posted inside the window, without a date, or seen listed inside it (D3, D4), with posted_ts and age."""
    step = text.staged(rows, posted_ts=dates.parse_posted_at(F.col("posted_at"), now)).withColumn("age", dates.age_days(F.col("posted_ts"), now))
    return step.filter(dates.within_window(F.col("age"), window) | dates.listed_recently(F.col("last_listed_at"), now, window))


def _order(rows: DataFrame, key: str, descending: bool) -> list[Column]:
    c = SORT_KEYS[key]
    value = F.lower(c) if dict(rows.dtypes)[c] == "string" else F.col(c)
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col("url")]


def sort_board(rows: DataFrame, key: str = "score", descending: bool = True) -> DataFrame:
    """Nulls last in both directions, texts without regard to case (O1); ties by url."""
    return rows.orderBy(*_order(rows, key, descending))


def first_page(rows: DataFrame, key: str = "score", descending: bool = True, size: int = 50) -> DataFrame:
    """The first ``size`` rows of the sorted board, with their position from 1: each task hands on as many, never its whole sort."""
    top = sort_board(rows, key, descending).limit(size)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*_order(rows, key, descending))))


def status_counts(rows: DataFrame) -> DataFrame:
    """my_status ('none' where unset), n (A10)."""
    return rows.groupBy(F.coalesce("my_status", F.lit("none")).alias("my_status")).agg(F.count("*").alias("n"))


def unevaluated(details: DataFrame, evaluations: DataFrame, include_all: bool = False, limit: int | None = None) -> DataFrame:
    """Passing postings without a score, oldest first."""
    rows = details.filter("passed_filters")
    rows = rows if include_all else rows.join(evaluations.select("url"), "url", "left_anti")
    rows = rows.orderBy("fetched_at", "url")
    return rows if limit is None else rows.limit(limit)


def scored(details: DataFrame, evaluations: DataFrame) -> DataFrame:
    """All scored postings, those filtered since included, best first."""
    return details.join(evaluations, "url").orderBy(F.desc_nulls_last("match_score"), "url")


def manual(details: DataFrame, evaluations: DataFrame, statuses: DataFrame, source: str = "manual", pending: bool = False) -> DataFrame:
    """Rows of one source with score and status, newest first."""
    rows = details.filter(F.col("source") == source).join(evaluations.select("url", "match_score", "recommendation"), "url", "left").join(statuses.select("url", "my_status"), "url", "left")
    return (rows.filter("match_score is null") if pending else rows).orderBy(F.desc("fetched_at"), "url")


def rescore_count(details: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row, n: stored postings that have a score already."""
    return details.select("url").join(evaluations.select("url"), "url").agg(F.count("*").alias("n"))


def not_older(rows: DataFrame, now: Column, days: int | None) -> DataFrame:
    """Rows posted at most ``days`` ago or without a date (ST5: what an aggregator is asked for); None keeps all."""
    if days is None:
        return rows
    step = text.staged(rows, __posted=dates.parse_posted_at(F.col("posted_at"), now))
    return step.filter(F.coalesce(dates.age_days(F.col("__posted"), now) <= days, F.lit(True))).drop("__posted")


def twins(rows: DataFrame, details: DataFrame) -> DataFrame:
    """url, twin: the smallest url of another stored posting with equal company, title and location, whatever their case."""
    key = [F.lower(F.coalesce(c, F.lit(""))).alias(f"k_{c}") for c in ("company", "title", "location")]
    keys = ["k_company", "k_title", "k_location"]
    # Two smallest urls of a key are enough to find one that is not the row's own.
    two = details.select("url", *key).groupBy(keys).agg(F.min("url").alias("a")).alias("x")
    second = details.select("url", *key).join(two, keys).filter("url > a").groupBy(keys).agg(F.min("url").alias("b"))
    met = rows.select("url", *key).join(two.join(second, keys, "left"), keys)
    return met.select("url", F.when(F.col("a") != F.col("url"), F.col("a")).otherwise(F.col("b")).alias("twin")).filter("twin is not null")


def top_per(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
