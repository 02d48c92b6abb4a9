"""Texts of CV documents through a cache: which copy is used, how old it is, and why.

The cache is a table with versions, the last of each owner counting. A copy inside
its time to live is what a scan is meant to use; one that could not be refreshed
is used and called stale. Fetching is someone else's work: ``due`` says what is to
be fetched, and the attempts come in as rows, failures among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_HOURS = 24.0
CACHE = "owner string, doc_id string, text string, source string, fetched_at string"


def latest(cache: DataFrame) -> DataFrame:
    """The last copy of each owner."""
    last = cache.groupBy("owner").agg(F.max_by(F.struct("doc_id", "text", "source", "fetched_at"), F.coalesce("fetched_at", F.lit(""))).alias("c"))
    return last.select("owner", F.lit(True).alias("cached"), F.col("c.doc_id").alias("cached_doc"), F.col("c.text").alias("cached_text"), F.col("c.source").alias("cached_source"), F.col("c.fetched_at").alias("cached_at"))


def _age(now: Column) -> Column:
    """Hours since the copy was fetched; null where its time cannot be read."""
    return F.round((now.cast("timestamp").cast("double") - F.col("cached_at").try_cast("timestamp").cast("double")) / 3600, 2)


def _known(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    rows = requests.select("owner", "doc_id").join(latest(cache), "owner", "left").withColumn("age", _age(now))
    fresh = F.coalesce((F.col("cached_doc") == F.col("doc_id")) & (F.col("age") <= ttl_hours), F.lit(False))
    return rows.withColumn("fresh", fresh)


def due(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = TTL_HOURS, force: bool = False) -> DataFrame:
    """owner, doc_id of what is to be fetched: documents without a copy inside its time (``force``: all)."""
    rows = _known(requests, cache, now, ttl_hours).filter("doc_id IS NOT NULL")
    return (rows if force else rows.filter("NOT fresh")).select("owner", "doc_id")


def texts(requests: DataFrame, cache: DataFrame, attempts: DataFrame, now: Column, ttl_hours: float = TTL_HOURS, force: bool = False) -> DataFrame:
    """One row for each request (owner, doc_id): text, source, cached_source, doc_id, fetched_at, stale, age_hours, reason, error.

    ``attempts``: owner, position, source, text, error; the first by position that
    gave a text counts, an empty one is a failure. Without it the owner's copy is
    used and is stale, whatever document it is of; without a copy ``error`` says
    why there is no text. A request without document can only use the copy, which
    is stale if its age is unknown or beyond the time to live.
    """
    said = F.struct("position", "source", "text", F.concat(F.col("source"), F.lit(": "), F.coalesce("error", F.when(F.trim("text") == "", "the document is empty"), F.lit("no text"))).alias("why"), (F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).alias("ok"))
    tried = attempts.groupBy("owner").agg(F.array_sort(F.collect_list(said)).alias("tried"))
    rows = _known(requests, cache, now, ttl_hours).join(tried, "owner", "left")
    good = F.get(F.filter("tried", lambda x: x["ok"]), F.lit(0))
    use = F.col("fresh") & F.lit(not force)
    how = F.when(F.col("doc_id").isNull(), F.when(F.col("cached"), "alone").otherwise("nothing")).when(use, "hit").when(good.isNotNull(), "fetched").when(F.col("cached"), "stale").otherwise("nothing")
    rows = rows.withColumns({"how": how, "good": good})
    fetched = F.col("how") == "fetched"
    copied = F.col("how").isin("alone", "hit", "stale")
    errors = F.transform("tried", lambda x: x["why"])
    reason = F.when(F.col("how") == "alone", "no document configured").when(F.col("how") == "stale", F.coalesce(F.array_join(errors, "; "), F.lit("")))
    error = F.when(F.col("how") == "nothing", F.when(F.col("doc_id").isNull(), "no document configured").otherwise(F.concat_ws(" ", F.lit("could not read the document"), F.array_join(errors, " | "))))
    stale = F.when(F.col("how") == "alone", F.coalesce(F.col("age") > ttl_hours, F.lit(True))).when(F.col("how") == "stale", True).when(F.col("how") != "nothing", False)
    return rows.select(
        "owner", F.when(fetched, F.col("good.text")).when(copied, F.coalesce("cached_text", F.lit(""))).alias("text"), F.when(fetched, F.col("good.source")).when(copied, "cache").alias("source"), F.when(copied, F.col("cached_source")).alias("cached_source"),
        F.when(fetched, F.col("doc_id")).when(copied, F.col("cached_doc")).alias("doc_id"), F.when(fetched, now.cast("string")).when(copied, F.col("cached_at")).alias("fetched_at"), stale.alias("stale"), F.when(fetched, 0.0).when(copied, F.col("age")).alias("age_hours"), reason.alias("reason"), error.alias("error"),
    )


def versions(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with a new version for each text that was fetched; what came from it is not written again."""
    new = found.filter("source IS NOT NULL AND source <> 'cache'").select("owner", "doc_id", "text", "source", "fetched_at")
    return cache.select("owner", "doc_id", "text", "source", "fetched_at").unionByName(new)
