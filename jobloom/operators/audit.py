"""Tallies, re-screening of stored rows, board audits and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.operators import screen


def tallies(enriched: DataFrame) -> DataFrame:
    """measure, value, n: counts by rate verdict, language tier and clearance, of contracts and of rows with a rate (A1), from one pass."""
    each = F.explode(F.array(
        F.struct(F.lit("rate_verdict").alias("measure"), F.col("rate_verdict").alias("value")),
        F.struct(F.lit("language_tier").alias("measure"), F.col("language_tier").alias("value")),
        F.struct(F.lit("clearance_status").alias("measure"), F.col("clearance_status").alias("value")),
        F.struct(F.lit("contract").alias("measure"), (F.col("employment_type") == "contract").cast("string").alias("value")),
        F.struct(F.lit("with_rate").alias("measure"), F.coalesce(F.col("day_rate_max"), F.col("day_rate_min")).isNotNull().cast("string").alias("value")),
    ))
    return enriched.select(each.alias("e")).groupBy("e.measure", "e.value").agg(F.count("*").alias("n"))


def totals(enriched: DataFrame) -> list[Column]:
    """Aggregates of a run: fetched, candidates, contracts among them, clearance and rate rejections that alone kept a row out (A2); for ``agg`` or ``observe``."""
    passes = screen.passes_filters()
    rate = screen.passes_content_filters() & screen.rate_reject().isNotNull()
    return [F.count(F.lit(1)).alias("fetched"), F.count_if(passes).alias("candidates"), F.count_if(passes & (F.col("employment_type") == "contract")).alias("contracts"), F.count_if(screen.would_show_but_for_clearance()).alias("clearance_only"), F.count_if(rate).alias("rate_only")]


def run_totals(enriched: DataFrame) -> DataFrame:
    """One row of the aggregates of a run (A2)."""
    return enriched.agg(*totals(enriched))


def per_source(batch: DataFrame, new: DataFrame) -> DataFrame:
    """source, fetched, new (A3)."""
    fresh = new.groupBy("source").agg(F.count("*").alias("__n"))
    return batch.groupBy("source").agg(F.count("*").alias("fetched")).join(fresh, "source", "left").select("source", "fetched", F.coalesce("__n", F.lit(0)).alias("new"))


def distinct_companies(details: DataFrame) -> DataFrame:
    return details.filter("company is not null and company <> ''").select("company").distinct().orderBy("company")


def cluster_sizes(links: DataFrame) -> DataFrame:
    """root, size from (root, url) rows."""
    return links.groupBy("root").agg(F.count("*").alias("size"))


def rejected(postings: DataFrame, limit: int | None = None) -> DataFrame:
    """url, reasons ('title+location+stack') of rows that fail, newest first.

    Reasons come from title, place and description alone, so rows need not be enriched.
    They are worked out once: the filter reads them, and the sort's sample and the sort
    itself read what was shuffled.
    """
    ok = screen.content_checks()
    reasons = F.concat_ws("+", F.when(~ok["title"], "title"), F.when(~ok["location"], "location"), F.when(~ok["language"], "stack"))
    rows = text.staged(postings.select("url", "title", "location", "fetched_at", "description"), reasons=reasons).filter("reasons <> ''")
    rows = rows.select("url", "title", "location", "fetched_at", "reasons").repartition("url").orderBy(F.desc("fetched_at"), "url")
    return rows if limit is None else rows.limit(limit)


def first_and_more(rows: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows, each with the number of rows not shown."""
    left = rows.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return rows.orderBy(*order).limit(n).join(F.broadcast(left), F.lit(True))


def refilter(details: DataFrame) -> DataFrame:
    """url, passed_filters, change of stored (enriched) rows whose verdict has flipped: rescued or demoted."""
    now = screen.passes_filters()
    rows = details.select("url", F.col("passed_filters").alias("__old"), now.alias("passed_filters")).filter("__old <> passed_filters")
    return rows.select("url", "passed_filters", F.when(F.col("passed_filters"), "rescued").otherwise("demoted").alias("change"))


def backfill(details: DataFrame, demote: bool = False, once: bool = False) -> DataFrame:
    """All derived columns written anew; passing rows are demoted only on request, none is rescued. ``once``: see ``screen.enrich``."""
    fresh = screen.enrich(details.drop(*[c for c in ("ir35_status", "ir35_evidence", "rate_verdict", "rate_required", "perm_equivalent", "rate_reason", "language_tier", "language_rank", "language_hits", "clearance_status", "clearance_evidence") if c in details.columns]), once=once)
    return fresh.withColumn("passed_filters", F.col("passed_filters") & screen.passes_filters()) if demote else fresh


def board_audit(postings: DataFrame, titles: int = 8) -> DataFrame:
    """By company: n, london, uk, candidates and the first titles of candidates by ordinal."""
    low = F.lower(F.coalesce("location", F.lit("")))
    ok = screen.title_is_relevant(F.col("title")) & screen.location_is_allowed(F.col("location"))
    rows = postings.withColumns({"__ok": ok, "__low": low})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("company", "__ok").orderBy("ordinal", "url")))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__ok") & (F.col("__n") <= titles), F.struct("__n", "title")))), lambda x: x["title"]), "; ")
    return rows.groupBy("company").agg(F.count("*").alias("n"), F.count_if(F.col("__low").contains("london")).alias("london"), F.count_if(screen.location_is_allowed(F.col("location"))).alias("uk"), F.count_if("__ok").alias("candidates"), shown.alias("titles"))


def unknown_companies(details: DataFrame, registry: DataFrame) -> DataFrame:
    """Stored companies that no registry row names."""
    known = registry.select(F.lower("name").alias("__k")).distinct()
    return distinct_companies(details).withColumn("__k", F.lower("company")).join(known, "__k", "left_anti").select("company")


def redirect_report(urls: DataFrame) -> DataFrame:
    """category, n, percent of final hosts (S18), most frequent first."""
    counts = urls.groupBy(text.host_category(F.col("url")).alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2)).orderBy(F.desc("n"), "category")


def latest_per(rows: DataFrame, name: str, at: str) -> DataFrame:
    """The latest row of each name."""
    cols = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.max_by(F.struct(*cols), F.struct(at, *[c for c in cols if c != at])).alias("s")).select(name, "s.*")


def first_per(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in arrival order."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), ordinal).alias("s")).select(*keys, "s.*")
