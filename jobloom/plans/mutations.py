"""Registered queries of the store's mutations and queues over the posting views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import schemas
from jobloom.operators import audit, board, coverage, duplicates, manual, store
from jobloom.plans import fixtures


def _some(p: DataFrame, n: int) -> DataFrame:
    return p.filter(F.col("ordinal") % n == 0)


def _mark_seen(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d).select("url", "company", "ordinal")
    old = _some(p, 3).withColumn("known", F.lit(True)).drop("ordinal")
    return store.insert_new(old, p.withColumn("known", F.lit(False)).drop("ordinal"))


def _save_details(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d).select("url", "title", "company", "fetched_at", "ordinal")
    return store.replace(p.drop("ordinal"), _some(p, 4).select("url", "title", F.lit("changed").alias("company")))


def _save_derived(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d).select("url", "title", "company", "location", "ordinal")
    return store.update(p.drop("ordinal"), _some(p, 4).select("url", F.lit("changed").alias("company"), F.lit(None).cast("string").alias("location")), ["company", "location"])


def _mark_listed(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d).select("url", F.lit(None).cast("string").alias("last_listed_at"), "ordinal")
    return store.mark_listed(p.drop("ordinal"), _some(p, 5), fixtures.NOW)


def _save_evaluation(s: SparkSession, d: str) -> DataFrame:
    return store.replace(fixtures.scores(s, d), _some(fixtures.postings(s, d), 6).select("url", F.lit(50).alias("match_score")))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    delta = _some(fixtures.postings(s, d), 5).select("url", F.lit("saved").alias("my_status"))
    return store.upsert(fixtures.statuses(s, d), delta, ["my_status", "notes"]).select("url", "my_status", "updated_at")


def _save_guarded(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d)
    linked = p.join(duplicates.originals(p, p).withColumnRenamed("original", "duplicate_of"), "url", "left")
    decided = _some(p, 11).select("url", F.lit("skipped").alias("my_status"))
    return store.save_status(fixtures.statuses(s, d), linked, decided, fixtures.NOW, refresh_inherited=False).select("url", "my_status", "inherited_from")


def _candidates(s: SparkSession, d: str) -> DataFrame:
    third = {c: F.col(c) / 3 for c in ("day_rate_min", "day_rate_max")}
    rows = fixtures.postings(s, d).withColumns(third).withColumns({c: F.lit(None).cast("double") for c in ("perm_equivalent",)} | {c: F.lit(None).cast("string") for c in ("ir35_status", "rate_verdict")})
    return store.candidate_rows(rows).drop("perm_equivalent", "ir35_status", "rate_verdict")


def _manual(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d)
    # A page address of the network, or the stored address itself.
    page = F.concat(F.lit("https://www.linkedin.com/jobs/view/qa-"), (1_000_000 + F.col("ordinal")).cast("string"), F.lit("/?trk=x"))
    rows = _some(p, 2).withColumn("url", F.when(F.col("ordinal") % 4 == 0, F.col("url")).otherwise(page))
    stored = schemas.conform(p.select("url", "company", "title", "location"), schemas.JOB_DETAILS)
    _, report = manual.add(stored, schemas.conform(rows.select("url", "company", "title", "location"), schemas.POSTING), fixtures.NOW)
    return report.select("url", "added", "twin")


def _remove(s: SparkSession, d: str) -> DataFrame:
    scores = fixtures.scores(s, d).select("url")
    left = store.remove({"ai_evaluations": scores, "user_status": fixtures.statuses(s, d).select("url"), "cv_scans": scores}, _some(fixtures.postings(s, d), 3))
    out = None
    for name, rows in left.items():
        rows = rows.select(F.lit(name).alias("tab"), "url")
        out = rows if out is None else out.unionAll(rows)
    return out


def _companies(s: SparkSession, d: str) -> DataFrame:
    slug = F.concat(F.lit("slug-"), (F.col("c_custkey") % 97).cast("string"))
    found = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), F.lit("lever").alias("ats"), slug.alias("slug"), F.col("c_custkey").alias("ordinal"))
    known = s.range(0, 97, 4).select(F.lit("lever").alias("ats"), F.concat(F.lit("slug-"), F.col("id").cast("string")).alias("slug"))
    return store.append_companies(known, found)


def _clean(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d).select("url", F.concat("description", F.lit(" \n\n\n end ")).alias("description"))
    return store.clean_descriptions(p)


def _better(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.postings(s, d)
    return coverage.best_sibling(duplicates.clusters(p).join(p.select("url", F.length("description").cast("long").alias("chars")), "url"))


def _links(s: SparkSession, d: str) -> DataFrame:
    return duplicates.audit(fixtures.postings(s, d).withColumn("duplicate_of", F.lit(None).cast("string")), fixtures.statuses(s, d))[0]


QUERIES = {
    "duplicate_links": _links,
    "mark_seen": _mark_seen,
    "save_details": _save_details,
    "save_derived": _save_derived,
    "mark_listed": _mark_listed,
    "save_evaluation": _save_evaluation,
    "upsert": _upsert,
    "save_status_guarded": _save_guarded,
    "candidate_rows": _candidates,
    "manual_rows": _manual,
    "remove": _remove,
    "append_companies": _companies,
    "requeue": lambda s, d: store.requeue_polluted(fixtures.postings(s, d).select("url"), fixtures.postings(s, d)),
    "clean_descriptions": _clean,
    "rescore_count": lambda s, d: board.rescore_count(fixtures.postings(s, d), fixtures.scores(s, d)),
    "latest_runs": lambda s, d: audit.latest_per(s.read.parquet(f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id"), "event_type", "ts"),
    "first_and_more": lambda s, d: audit.first_and_more(fixtures.postings(s, d).select("url", "fetched_at"), [F.desc("fetched_at"), F.col("url")]),
    "better_texts": _better,
    "not_older": lambda s, d: board.not_older(fixtures.postings(s, d), F.lit(fixtures.NOW).cast("timestamp"), 28).select("url"),
}
