"""The registered queries of the engine: each operator over the posting views or the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import dates, rates, text
from jobloom.operators import arrivals, audit, board, coverage, duplicates, screen, store
from jobloom.plans import documents, fixtures, landings, mutations, oracle_contracts, oracle_store, oracles, responses, runs, shapes, term_shapes
from jobloom.sources import pages

__all__ = ["QUERIES", "SQL"]

SQL = oracles.SQL | oracle_contracts.SQL | oracle_store.SQL | responses.SQL | documents.SQL | shapes.SQL | landings.SQL | term_shapes.SQL | runs.SQL


def _now():
    return F.lit(fixtures.NOW).cast("timestamp")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Postings as rows that were stored once: with the verdict of the screens for title, place and stack, and columns derived long ago."""
    ok = screen.title_is_relevant(F.col("title")) & screen.location_is_allowed(F.col("location")) & ~screen.stack_mismatch(F.col("description"))
    return text.staged(_unlinked(fixtures.postings(spark, sf)), passed_filters=ok)


def _unlinked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"duplicate_of": F.lit(None).cast("string"), "last_listed_at": F.lit(None).cast("string")})


def _passing(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``_stored`` that pass, with their languages: short columns are screened first, then descriptions of what is left, then languages."""
    p = fixtures.postings(spark, sf).filter(screen.title_is_relevant(F.col("title")) & screen.location_is_allowed(F.col("location")))
    rows = p.filter(~screen.stack_mismatch(F.col("description")))
    return _unlinked(screen.with_language(screen.with_advert(rows)).drop("__own", "__flat").withColumn("passed_filters", F.lit(True)))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return screen.enrich(fixtures.postings(spark, sf), once=True)


def _board(spark: SparkSession, sf: str) -> DataFrame:
    rows = board.board(_passing(spark, sf), fixtures.scores(spark, sf), fixtures.statuses(spark, sf))
    return rows.select("url", "company", "title", "location", "language_tier", "match_score", "recommendation", "my_status")


def _board_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = board.board(_passing(spark, sf), fixtures.scores(spark, sf), fixtures.statuses(spark, sf))
    return board.filter_board(rows, ai="apply", status="none", kind="permanent", language="priority+").select("url", "my_status")


def _windowed(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.when(F.col("ordinal") % 13 == 0, "2026-09-01 00:00:00").when(F.col("ordinal") % 13 == 1, "2026-05-01 00:00:00")
    # The window asks for dates alone, so no text is read; rows are parsed once, and the sort and its sample read what was shuffled.
    rows = fixtures.postings(spark, sf).select("url", "posted_at", listed.alias("last_listed_at"))
    rows = board.windowed(rows, _now(), "90").select("url", "posted_ts", "age").repartition("url")
    return board.sort_board(rows, "posted").select("url", F.col("posted_ts").cast("timestamp_ntz").alias("posted_ts"), "age", dates.age_label(F.col("age")).alias("label"), dates.age_class(F.col("age")).alias("age_class"))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = text.with_body(fixtures.postings(spark, sf), "description")
    return rows.select("url", F.col("__marker").alias("marker"), F.length("__body").cast("long").alias("body_chars"), (F.col("__marker").isNotNull() & F.col("__body").isNotNull()).alias("recoverable"))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return fixtures.postings(spark, sf).select("url", text.company_title_key(c("company"), c("title"), c("location")).alias("company_title_key"), text.company_key(c("company")).alias("company_key"), F.array_join(text.title_tokens(c("title")), " ").alias("tokens"), F.array_join(text.cities_in(c("location")), " ").alias("cities"), text.is_vague_location(c("location")).alias("vague"))


def _language(spark: SparkSession, sf: str) -> DataFrame:
    return screen.with_language(screen.with_advert(fixtures.postings(spark, sf))).select("url", "language_tier", "language_rank", "language_hits")


def _content(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return fixtures.postings(spark, sf).select("url", screen.title_is_relevant(c("title")).alias("title_ok"), screen.location_is_allowed(c("location")).alias("place_ok"), screen.stack_mismatch(c("description")).alias("mismatch"))


def _is_new(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.postings(spark, sf)
    return arrivals.new_in_store(p, arrivals.with_key(p.filter("ordinal % 3 = 0")))


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.postings(spark, sf)
    return arrivals.new_postings(p.filter("ordinal % 3 <> 0"), arrivals.with_key(p.filter("ordinal % 3 = 0"))).select("url", "company_title_key")


def _details_linked(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.postings(spark, sf)
    found = duplicates.originals(p, p).withColumnRenamed("original", "duplicate_of")
    return p.join(found, "url", "left")


def _posted(spark: SparkSession, sf: str) -> DataFrame:
    ts = dates.parse_posted_at(F.col("posted_at"), _now())
    return fixtures.postings(spark, sf).select("url", ts.cast("timestamp_ntz").alias("posted_ts"), dates.age_days(ts, _now()).alias("age"))


def _refresh(spark: SparkSession, sf: str) -> DataFrame:
    rows = _enriched(spark, sf)
    delta = rows.filter("ordinal % 2 = 0").withColumns({"day_rate_max": F.col("day_rate_max") + F.col("ordinal") % 3, "employment_type": F.lit("unknown")})
    return store.refresh_contract(rows, delta).select("url", "employment_type", "day_rate_max", "changed")


def _save_inherited(spark: SparkSession, sf: str) -> DataFrame:
    found = fixtures.postings(spark, sf).filter("ordinal % 2 = 0").select("url", F.lit("applied").alias("my_status"), F.lit("https://jobs.example.com/1").alias("inherited_from"))
    return store.save_inherited(fixtures.statuses(spark, sf), found, fixtures.NOW).select("url", "my_status")


def _save_status(spark: SparkSession, sf: str) -> DataFrame:
    decided = fixtures.postings(spark, sf).filter("ordinal % 11 = 0").select("url", F.lit("skipped").alias("my_status"))
    return store.save_status(fixtures.statuses(spark, sf), _details_linked(spark, sf), decided, fixtures.NOW).select("url", "my_status", "inherited_from")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return store.lessons(e.select(F.col("event_type").alias("mode"), F.col("ts").cast("string").alias("at"), F.col("event_id").alias("evidence")))


def _first_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role").withColumn("at", F.struct("turn", "role"))
    return audit.first_per(c, ["conv_id"], "at").select("conv_id", "turn", "role")


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("url", "ir35_status", "ir35_evidence", "day_rate_min", "day_rate_max", "day_rate_source", "rate_verdict", F.round("rate_required", 4).alias("rate_required"), F.round(F.col("perm_equivalent") + oracle_contracts.HAIR, 4).alias("perm_equivalent"), "rate_reason")


def _rejections(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("url", screen.passes_filters().alias("passes"), screen.rejection_reason().alias("reason"), F.array_join(screen.failing_reasons(), "+").alias("failing"))


def _tax(spark: SparkSession, sf: str) -> DataFrame:
    m, v = rates.RateModel(), F.col("o_totalprice")
    out = m.outside(v)
    cols = {"income_tax": m.income_tax(v), "employee_nic": m.employee_nic(v), "employer_nic": m.employer_nic(v), "net_salary": m.net_salary(v), "inside_salary": m.inside_salary(v), "outside_net": out["net_pay"], "dividend_tax": out["dividend_tax"], "corporation_tax": out["corporation_tax"]}
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", *(F.round(x + oracle_contracts.HAIR, 4).alias(k) for k, x in cols.items()))


def _thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer is a contractor with 0 to 260 working days a year."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 261).cast("int").alias("days"))
    return rates.with_thresholds(rows).select("c_custkey", "days", "salary", F.round("inside_rate", 4).alias("inside_rate"), F.round("outside_rate", 4).alias("outside_rate"))


#: A CV and a fact base for the coverage queries.
CV = "Test engineer. Java, JUnit and Maven suites for payment services.\nSelenium and REST-assured checks in Jenkins pipelines."
MASTER = CV + "\nRuby on Rails with RSpec and Capybara. Groovy and Spock for contract tests. Python scripts for stakeholder management."
_ADVERT = "\n\nRequirements\n\n- Java, Selenium and Docker\n- Stakeholder management\n\nWhat you will do\n\n- Maintain Jenkins pipelines with Groovy\n\nNice to have\n\n- Kubernetes\n"


def _adverts(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.postings(spark, sf)
    return p.select("url", "title", "company", F.concat(F.col("description"), F.when(F.col("ordinal") % 3 == 0, F.lit("")).otherwise(F.lit(_ADVERT)), F.repeat(F.lit(" calm words"), F.when(F.col("ordinal") % 4 == 0, 5).otherwise(120))).alias("post_text"))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.posting_terms(_adverts(spark, sf)).select("url", "term", "count", "weight", "section", "skill", "priority")


def _told(spark: SparkSession, sf: str, surfaces: bool = False) -> DataFrame:
    return coverage.posting_terms(_adverts(spark, sf), marks={"on_cv": CV, "in_master": MASTER}, surfaces=surfaces)


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("url", "verdict", "unreliable", "priority_coverage", "all_term_coverage", "hard_gap_count", "terms_found")
    return coverage.scan(_adverts(spark, sf), CV, MASTER).select(*cols)


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.gap_report(_told(spark, sf), CV, MASTER)


def _suggested(spark: SparkSession, sf: str) -> DataFrame:
    rows = coverage.with_coverage(_told(spark, sf, surfaces=True), CV, MASTER)
    facts = spark.createDataFrame([("r1", f"a{i}", x, ["tag"], []) for i, x in enumerate(MASTER.splitlines())], "role_id string, achievement_id string, text string, tags array<string>, metrics array<string>")
    return coverage.suggestions(rows, facts, CV).select("url", "achievement_id", "kind", "weight_closed", "rank")


#: Final hosts that pages get by their number.
HOSTS = ("boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "apply.workable.com", "acme.wd3.myworkdayjobs.com", "jobs.smartrecruiters.com", "uk.linkedin.com", "www.adzuna.co.uk", "example.com")


def _redirects(spark: SparkSession, sf: str) -> DataFrame:
    host = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % 11 % 9).cast("int"))
    return audit.redirect_report(spark.read.parquet(f"{sf}/pages.parquet").select(F.when(F.col("page_id") % 5 == 4, "").when(F.col("page_id") % 7 == 6, F.col("url")).otherwise(F.concat(F.lit("https://"), host, F.lit("/x"))).alias("url")))


def _of(f):
    """A query over the postings."""
    return lambda spark, sf: f(fixtures.postings(spark, sf))


QUERIES = {
    "board": _board,
    "board_filtered": _board_filtered,
    "board_windowed": _windowed,
    "postings": lambda s, d: fixtures.postings(s, d).select("url", "company", "title", "location", "posted_at", F.length("description").cast("long").alias("n"), "employment_type", "day_rate_min", "day_rate_max", "day_rate_source", "fetched_at", "source"),
    "listing_pages": _listing,
    "language_fit": _language,
    "content_screens": _content,
    "clearance": _of(lambda p: screen.with_clearance(screen.with_advert(p)).select("url", "clearance_status", "clearance_evidence")),
    "truncated": _of(lambda p: p.select("url", text.looks_truncated(F.col("description")).alias("truncated"))),
    "page_text": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.flat(text.page_text(F.col("html"))).alias("text")),
    "page_structure": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.structured_text(F.col("html")).alias("text"), text.description_kind(F.col("html"))["kind"].alias("kind")),
    "title_keys": _keys,
    "contract_rates": _rates,
    "tax_model": _tax,
    "rate_thresholds": _thresholds,
    "rejections": _rejections,
    "rejected_rows": lambda s, d: audit.rejected(fixtures.postings(s, d)).select("url", "reasons"),
    "run_totals": lambda s, d: audit.run_totals(_enriched(s, d)),
    "tallies": lambda s, d: audit.tallies(_enriched(s, d)),
    "refilter": lambda s, d: audit.refilter(_enriched(s, d).withColumn("passed_filters", F.col("ordinal") % 2 == 0)),
    "backfill": lambda s, d: audit.backfill(_stored(s, d), demote=True, once=True).select("url", "passed_filters", "rate_verdict", "language_tier", "clearance_status"),
    "originals": _of(lambda p: duplicates.originals(p, p)),
    "duplicate_clusters": _of(duplicates.clusters),
    "cluster_sizes": _of(lambda p: audit.cluster_sizes(duplicates.clusters(p))),
    "inheritances": lambda s, d: duplicates.inheritances(_details_linked(s, d), fixtures.statuses(s, d)),
    "duplicate_audit": lambda s, d: duplicates.audit(fixtures.postings(s, d).withColumn("duplicate_of", F.lit(None).cast("string")), fixtures.statuses(s, d))[1],
    "save_inherited": _save_inherited,
    "save_status": _save_status,
    "refresh_contract": _refresh,
    "is_new": _is_new,
    "new_postings": _arrivals,
    "twins": _of(lambda p: board.twins(p, p)),
    "unevaluated": lambda s, d: board.unevaluated(_passing(s, d), fixtures.scores(s, d)).select("url", "fetched_at"),
    "queue_limit": lambda s, d: board.unevaluated(_passing(s, d), fixtures.scores(s, d), limit=20).select("url", "fetched_at"),
    "scored": lambda s, d: board.scored(fixtures.postings(s, d), fixtures.scores(s, d)).select("url", "match_score", "recommendation"),
    "manual_pending": lambda s, d: board.manual(fixtures.postings(s, d), fixtures.scores(s, d), fixtures.statuses(s, d), pending=True).select("url", "my_status"),
    "status_counts": lambda s, d: board.status_counts(board.board(_passing(s, d), fixtures.scores(s, d), fixtures.statuses(s, d))),
    "per_source": _of(lambda p: audit.per_source(p, p.filter("ordinal % 2 = 0"))),
    "distinct_companies": _of(audit.distinct_companies),
    "unknown_companies": lambda s, d: audit.unknown_companies(fixtures.postings(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"))),
    "board_audit": _of(audit.board_audit),
    "redirects": _redirects,
    "posted_age": _posted,
    "lessons": _events,
    "first_turns": _first_turns,
    "posting_terms": _terms,
    "cv_scan": _scan,
    "gap_report": _gaps,
    "suggestions": _suggested,
    "page_html_text": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", pages.html_text_udf("html").alias("text")),
    "top_scores": lambda s, d: board.top_per(fixtures.postings(s, d).join(fixtures.scores(s, d), "url"), ["source"], [F.desc("match_score"), F.col("url")], 12).select("source", "url", "match_score"),
} | mutations.QUERIES | responses.QUERIES | documents.QUERIES | shapes.QUERIES | landings.QUERIES | term_shapes.QUERIES | runs.QUERIES
