"""Registered queries of the sources: stored responses of boards, detail pages, guest pages and pasted adverts, made from the posting views.

The responses are JSON and HTML that Spark builds and the sources take apart
again; the SQL says what must come out without any of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.plans import fixtures
from jobloom.plans.oracles import _PLACE, _TITLE, VIEWS
from jobloom.sources import boards, loaders, pages

#: Postings of one stored response, and of one task where they are grouped or joined.
PER_BOARD, PER_TASK = 100, 100_000
_SHOWN = ("company", "url", "title", "location", "posted_at", "description", "employment_type", "day_rate_min", "day_rate_max", "day_rate_source", "source")


def _when(n: int, k: int, value: Column) -> Column:
    return F.when(F.col("ordinal") % n == k, value)


def _parts(s: SparkSession, d: str) -> int:
    """Tasks that the postings are dealt to, so that more postings are more tasks and no larger ones."""
    n = sum(s.read.parquet(f"{d}/{t}.parquet").count() for t in ("orders", "documents"))
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PER_TASK))


def _dealt(s: SparkSession, d: str) -> DataFrame:
    """The postings beside their ``board`` of PER_BOARD, dealt to tasks by it."""
    board = F.floor(F.col("ordinal") / PER_BOARD).cast("string")
    return fixtures.postings(s, d).withColumn("board", board).repartition(_parts(s, d), "board")


def _raw(dealt: DataFrame, ats: str) -> DataFrame:
    """Responses (boards.RAW) of ``ats``, each with the jobs of PER_BOARD postings under a key."""
    job, key, slug = _JOBS[ats]()
    jobs = dealt.select("board", job.alias("j")).groupBy("board").agg(F.collect_list("j").alias("j"))
    body = F.to_json("j") if key is None else F.to_json(F.struct(F.col("j").alias(key)))
    return jobs.select(F.concat(F.lit("Board "), "board").alias("company"), F.lit(ats).alias("ats"), F.lit(slug).alias("slug"), body.alias("body"), F.lit(None).cast("string").alias("error"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*_SHOWN)


def _greenhouse():
    c = F.col
    job = F.struct("title", c("url").alias("absolute_url"), F.struct(c("location").alias("name")).alias("location"), _when(2, 0, F.lit("")).otherwise(c("posted_at")).alias("first_published"), c("fetched_at").alias("updated_at"), c("description").alias("content"))
    return job, "jobs", "slug"


def _ashby():
    c = F.col
    job = F.struct("title", _when(2, 0, c("location")).alias("location"), F.lit("Elsewhere").alias("locationName"), _when(3, 0, c("url")).otherwise(F.lit("")).alias("jobUrl"), c("url").alias("applyUrl"), c("posted_at").alias("publishedAt"), _when(4, 0, c("description")).alias("descriptionPlain"), F.lit("<p>x</p>").alias("descriptionHtml"))
    return job, "jobs", "slug"


def _workable():
    c = F.col
    place = lambda city, hidden: F.struct(F.lit(city).alias("city"), F.lit("").alias("region"), F.lit("UK").alias("country"), F.lit(hidden).alias("hidden"))
    many = F.array(place("Leeds", False), place("York", True), place("Leeds", False), place("Bath", False))
    job = F.struct("title", "url", c("fetched_at").alias("created_at"), "description", (c("ordinal") % 5 == 0).alias("telecommuting"), _when(4, 0, many).alias("locations"), _when(4, 1, place("Hull", False)).alias("location"), F.lit("Crewe").alias("city"), F.lit("Crewe").alias("state"), F.lit("UK").alias("country"))
    return job, "jobs", "slug"


def _lever():
    c = F.col
    cats = F.struct(c("location").alias("location"), _when(2, 0, F.array(F.lit("A"), F.lit("B"))).alias("allLocations"))
    job = F.struct(c("title").alias("text"), c("url").alias("hostedUrl"), (F.lit(1758000000000) + c("ordinal")).alias("createdAt"), cats.alias("categories"), _when(2, 1, F.lit("")).otherwise(c("description")).alias("descriptionPlain"), F.lit("html").alias("description"))
    return job, None, "slug"


def _smart():
    c = F.col
    where = F.struct(F.lit("London").alias("city"), F.lit("").alias("region"), F.lit("gb").alias("country"))
    job = F.struct(_when(7, 0, F.lit(None).cast("string")).otherwise(c("ordinal").cast("string")).alias("id"), c("title").alias("name"), _when(7, 1, c("url")).alias("postingUrl"), _when(7, 2, c("url")).alias("applyUrl"), _when(14, 0, c("url")).alias("ref"), c("posted_at").alias("releasedDate"), where.alias("location"))
    return job, "content", "acme"


def _workday():
    c = F.col
    path = F.concat(F.lit("/job/"), (c("ordinal") - c("ordinal") % 2).cast("string"))
    job = F.struct(F.lit("Test Engineer").alias("title"), _when(10, 9, F.lit("")).otherwise(path).alias("externalPath"), F.lit("2 Locations").alias("locationsText"), F.lit("Posted Today").alias("postedOn"))
    return job, "jobPostings", "acme/Careers"


def _adzuna():
    c = F.col
    job = F.struct("title", c("url").alias("redirect_url"), c("fetched_at").alias("created"), "description", F.initcap("employment_type").alias("contract_type"), (52000 + c("ordinal") % 100 * 260).cast("double").alias("salary_min"), _when(3, 0, F.lit(130000.0)).alias("salary_max"), (c("ordinal") % 2).cast("string").alias("salary_is_predicted"), _when(2, 0, F.struct(c("company").alias("display_name"))).alias("company"), F.struct(c("location").alias("display_name")).alias("location"))
    return job, "results", "slug"


def _remotive():
    c = F.col
    kinds = F.array(*(F.lit(x) for x in ("contract", "freelance", "full_time", "other")))
    job = F.struct("title", "url", c("company").alias("company_name"), c("fetched_at").alias("publication_date"), "description", F.get(kinds, (c("ordinal") % 4).cast("int")).alias("job_type"), _when(2, 0, F.lit("UK")).otherwise(F.lit("")).alias("candidate_required_location"))
    return job, "jobs", "slug"


#: By board kind: a posting's entry, the key of a response's list, the board's slug.
_JOBS = {"greenhouse": _greenhouse, "ashby": _ashby, "workable": _workable, "lever": _lever, "smartrecruiters": _smart, "workday": _workday, "adzuna": _adzuna, "remotive": _remotive}


def _all_boards(s, d) -> DataFrame:
    parts, rows = _parts(s, d), _dealt(s, d)
    # Staged, all boards ask for the same columns, so the postings are joined and dealt out once for them all.
    rows, found = text.staged(rows, **{c: F.col(c) for c in rows.columns if c != "board"}), None
    for ats in _JOBS:
        own = boards.parse(_raw(rows, ats), [ats], parts).select("source", "url")
        found = own if found is None else found.unionByName(own)
    each = found.repartition(parts * len(_JOBS), "source", "url").groupBy("source", "url").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("n"), F.count("url").alias("urls"))


def _failures(s, d) -> DataFrame:
    address = F.concat(F.lit("HTTPError: https://api.example.com/1?app_id="), F.col("ordinal").cast("string"), F.lit("&app_key=secret&what=qa "), F.col("url"))
    rows = fixtures.postings(s, d).select("company", F.lit("adzuna").alias("ats"), F.lit("x").alias("slug"), F.lit(None).cast("string").alias("body"), _when(3, 0, address).alias("error"))
    return boards.failures(rows)


def _detailed(s, d) -> DataFrame:
    parts = _parts(s, d)
    rows = boards.parse(_raw(_dealt(s, d), "smartrecruiters").unionByName(_raw(_dealt(s, d), "workday")), ["smartrecruiters", "workday"], parts)
    asked = boards.detail_requests(rows, parts)
    part = lambda x: F.struct(F.lit(x).alias("text"))
    smart = F.to_json(F.struct(F.struct(F.struct(part("Duties").alias("jobDescription"), part("").alias("qualifications"), part("More").alias("additionalInformation")).alias("sections")).alias("jobAd")))
    day = F.to_json(F.struct(F.struct(F.lit("Text").alias("jobDescription"), F.lit("London").alias("location"), F.array(F.lit("Leeds"), F.lit("LONDON"), F.lit(" ")).alias("additionalLocations")).alias("jobPostingInfo")))
    stored = asked.select("url", F.when(F.col("address").endswith("8"), F.lit("oops")).when(F.col("ats") == "workday", day).otherwise(smart).alias("body"))
    return boards.with_details(rows, stored, parts).select("url", "location", "description")


def _full(s, d) -> DataFrame:
    key = F.col("page_id")
    final = F.when(key % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), key.cast("string"))).when(key % 3 == 1, F.lit("https://jobs.lever.co/bee/01234567-89ab-cdef-0123-456789abcdef")).otherwise(F.col("url"))
    body = F.when(key % 6 == 0, '{"content": "own text"}').when(key % 6 == 1, '{"descriptionPlain": "", "description": "lever text"}')
    landed = s.read.parquet(f"{d}/pages.parquet").select(key.cast("string").alias("url"), final.alias("final_url"), F.col("html").alias("page"), body.alias("body"))
    out = boards.full_descriptions(landed)
    return out.select(F.col("url").alias("page_id"), text.flat(F.col("full_text")).alias("text"), "ats", "slug")


def _guest(s, d) -> DataFrame:
    c = F.col
    html = F.concat(F.lit('<main><h1 class="x topcard__title">'), "title", F.lit('</h1><a class="topcard__org-name-link"> '), "company", F.lit(' </a><span class="topcard__flavor--bullet">'), F.coalesce("location", F.lit("")), F.lit('</span><section><div class="show-more-less-html__markup"><ul><li>one</li><li>two</li></ul></div><h3 class="description__job-criteria-subheader">Seniority level</h3><span class="description__job-criteria-text">Any</span><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">'), _when(2, 0, F.lit("Full-time, Contract")).otherwise(F.lit("Full-time")), F.lit("</span></section></main>"))
    rows = fixtures.postings(s, d).select("url", pages.job_page_udf(html).alias("p"))
    return rows.select("url", "p.title", "p.company", "p.location", "p.description", text.criteria_employment(c("p.criteria")).alias("employment_type"))


def _verified(s, d) -> DataFrame:
    p = fixtures.postings(s, d)
    jobs = p.select(F.concat(F.lit("b"), (F.col("ordinal") % 40).cast("string")).alias("board"), F.element_at(F.array(F.lit("Acme Testing Ltd"), F.lit("Wise"), F.lit("Brightwell")), (F.col("ordinal") % 40 % 3 + 1).cast("int")).alias("company"), "title", "location",
                    _when(9, 0, F.lit("At Acme Testing we care")).otherwise(_when(9, 1, F.lit("wise and brightwell people")).otherwise(F.lit("otherwise nothing"))).alias("description"))
    return loaders.verify_boards(jobs)


def _texts(s, d) -> DataFrame:
    c, p = F.col, fixtures.postings(s, d)
    version = F.concat(F.lit("Bump lib from "), (c("ordinal") % 3).cast("string"), F.lit("."), (c("ordinal") % 2).cast("string"), F.lit(".0 to 1.1."), (c("ordinal") % 7).cast("string"))
    return p.select(
        "url", text.canonical_url(F.concat(F.lit(" https://uk.linkedin.com/jobs/search?currentJobId="), (1_000_000 + c("ordinal")).cast("string"), F.lit("&x=1 "))).alias("canonical"),
        F.array_join(text.slug_variants(c("company")), "|").alias("slugs"), text.version_bump(version).alias("bump"),
        text.collapse_lines(F.concat(F.lit(" a \n\n\n\n b "), "title", F.lit(" \n\n"))).alias("lines"),
        loaders.names_agree(c("company"), F.concat(F.lit("Welcome to "), "company", F.lit(" careers"))).alias("agree"), text.redact(F.concat("url", F.lit("?token=abc&x=1"))).alias("redacted"),
    )


def _post_texts(s, d) -> DataFrame:
    rows = text.with_post_text(fixtures.postings(s, d), "description")
    return rows.select("url", text.flat(F.col("post_text")).alias("text"))


def _months(s, d) -> DataFrame:
    from jobloom.functions import dates

    o = s.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    forms = F.array(*(F.date_format(day, f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy")), F.lit("soon"))
    return o.select("o_orderkey", dates.month_label(F.when(F.col("o_orderkey") % 5 == 0, "Present").otherwise(F.date_format(day, "yyyy-MM"))).alias("month"), dates.application_date(F.get(forms, (F.col("o_orderkey") % 6).cast("int"))).cast("string").alias("applied"))


def _cv_sources(s, d) -> DataFrame:
    """Each document is a CV text, fetched 0 to 59 hours ago or nobody knows when."""
    key, now = F.col("doc_id"), F.lit(fixtures.NOW).cast("timestamp")
    at = F.when(key % 13 > 0, (now - F.make_interval(hours=(key % 60).cast("int"))).cast("string"))
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", at.alias("fetched_at"))
    return loaders.cv_ages(rows, now).select("doc_id", "age_hours", "stale", "chars")


#: Rows of a table of boards, {n} being the customer's number; what must be asked for is in the SQL.
_BOARDS = [
    ("greenhouse", None, "co{n}", None), ("workday", None, "tenant{n}/Careers", None), ("workday", "lever", "/t-{n}/Site_1/wd5/", None), ("workday", None, "tenant{n}", None), ("workday", None, "t/Careers/wd99", None),
    (" ", "adzuna", None, '{"country": " UK ", "what": "qa {n}"}'), ("adzuna", None, None, '{"country": "gbr"}'), (None, "adzuna", None, None), ("smartrecruiters", None, "co{n}", None), ("lever", None, " ", None),
    ("monster", None, "co{n}", None), (None, None, "co{n}", None), ("ashby", None, "co{n}", "{oops"),
]


def _registry(s, d) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda k: F.replace(F.get(F.array(*(F.lit(r[k]).cast("string") for r in _BOARDS)), (key % len(_BOARDS)).cast("int")), F.lit("{n}"), key.cast("string"))
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("name"), *(pick(k).alias(c) for k, c in enumerate(("ats", "type", "slug", "params"))))
    return loaders.board_requests(rows).select("name", "ats", "slug", "search", F.try_element_at("params", F.lit("what")).alias("what"), "address", "error")


QUERIES = {f"board_{k}": (lambda k: lambda s, d: _shown(boards.parse(_raw(_dealt(s, d), k), [k], _parts(s, d))))(k) for k in _JOBS} | {
    "boards_together": _all_boards,
    "board_failures": _failures,
    "board_details": _detailed,
    "full_descriptions": _full,
    "guest_pages": _guest,
    "verified_boards": _verified,
    "text_functions": _texts,
    "post_texts": _post_texts,
    "month_labels": _months,
    "cv_sources": _cv_sources,
    "registries": _registry,
}


def _expected(ats: str, company: str = "'Board ' || (ordinal // 100)", title: str = "title", location: str = "location", url: str = "url", posted: str = "posted_at", description: str = "description", kind: str = "NULL::VARCHAR", low: str = "NULL::DOUBLE", high: str = "NULL::DOUBLE", tag: str = "NULL::VARCHAR", where: str = "true") -> str:
    return VIEWS + f" SELECT {company} AS company, {url} AS url, {title} AS title, {location} AS location, {posted} AS posted_at, {description} AS description, {kind} AS employment_type, {low} AS day_rate_min, {high} AS day_rate_max, {tag} AS day_rate_source, '{ats}' AS source FROM postings WHERE {where}"


_PAGE = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_WORKABLE = "CASE ordinal % 4 WHEN 0 THEN 'Leeds, UK; Bath, UK' WHEN 1 THEN 'Hull, UK' ELSE 'Crewe, UK' END"
_SMART_URL = "CASE WHEN ordinal % 7 IN (1, 2) THEN url WHEN ordinal % 7 <> 0 THEN 'https://jobs.smartrecruiters.com/acme/' || ordinal ELSE url END"
_DAY_URL = "'https://acme.wd3.myworkdayjobs.com/en-US/Careers/job/' || (ordinal - ordinal % 2)"
_IS_CONTRACT = "employment_type = 'contract'"

SQL = {
    "board_greenhouse": _expected("greenhouse", posted="CASE WHEN ordinal % 2 = 0 THEN fetched_at ELSE coalesce(posted_at, fetched_at) END"),
    "board_ashby": _expected("ashby", location="CASE WHEN ordinal % 2 = 0 THEN coalesce(location, 'Elsewhere') ELSE 'Elsewhere' END", description="CASE WHEN ordinal % 4 = 0 THEN description ELSE '<p>x</p>' END"),
    "board_workable": _expected("workable", location=f"CASE WHEN ordinal % 5 = 0 THEN 'Remote (' || {_WORKABLE} || ')' ELSE {_WORKABLE} END", posted="fetched_at"),
    "board_lever": _expected("lever", location="CASE WHEN ordinal % 2 = 0 THEN 'A, B' ELSE location END", posted="(1758000000000 + ordinal)::VARCHAR", description="CASE WHEN ordinal % 2 = 1 THEN 'html' ELSE description END"),
    "board_smartrecruiters": _expected("smartrecruiters", location="'London, GB'", url=_SMART_URL, description="''", where="ordinal % 7 <> 0 OR ordinal % 14 = 0"),
    "board_workday": VIEWS + f", u AS (SELECT min(ordinal // 100) AS b, {_DAY_URL} AS url FROM postings WHERE ordinal % 10 <> 9 GROUP BY 2) SELECT 'Board ' || b AS company, url, 'Test Engineer' AS title, '2 Locations' AS location, 'Posted Today' AS posted_at, '' AS description, NULL::VARCHAR AS employment_type, NULL::DOUBLE AS day_rate_min, NULL::DOUBLE AS day_rate_max, NULL::VARCHAR AS day_rate_source, 'workday' AS source FROM u",
    "board_adzuna": _expected("adzuna", company="CASE WHEN ordinal % 2 = 0 THEN company ELSE 'Unknown' END", posted="fetched_at", kind="CASE WHEN employment_type IN ('contract', 'permanent') THEN employment_type ELSE 'unknown' END", low=f"CASE WHEN {_IS_CONTRACT} THEN 200 + (ordinal % 100)::DOUBLE END", high=f"CASE WHEN {_IS_CONTRACT} AND ordinal % 3 = 0 THEN 500.0::DOUBLE END", tag=f"CASE WHEN {_IS_CONTRACT} THEN CASE WHEN ordinal % 2 = 1 THEN 'estimated_by_adzuna' ELSE 'derived_from_advertised_salary' END END"),
    "board_remotive": _expected("remotive", company="company", location="CASE WHEN ordinal % 2 = 0 THEN 'Remote (UK)' ELSE 'Remote (Anywhere)' END", posted="fetched_at", kind="CASE WHEN ordinal % 4 < 2 THEN 'contract' WHEN ordinal % 4 = 2 THEN 'permanent' ELSE 'unknown' END"),
    "boards_together": VIEWS + f""", n AS (SELECT count(*) AS n FROM postings) SELECT s AS source, n, n AS urls FROM n, (VALUES ('greenhouse'), ('ashby'), ('workable'), ('lever'), ('adzuna'), ('remotive')) k(s)
        UNION ALL SELECT 'smartrecruiters', count(*), count(DISTINCT {_SMART_URL}) FROM postings WHERE ordinal % 7 <> 0 OR ordinal % 14 = 0 UNION ALL SELECT 'workday', count(DISTINCT {_DAY_URL}), count(DISTINCT {_DAY_URL}) FROM postings WHERE ordinal % 10 <> 9""",
    "board_failures": VIEWS + " SELECT company, 'adzuna' AS ats, 'HTTPError: https://api.example.com/1?app_id=***&app_key=***&what=qa ' || url AS error FROM postings WHERE ordinal % 3 = 0",
    "board_details": VIEWS + f""", d AS (SELECT DISTINCT {_DAY_URL} AS url FROM postings WHERE ordinal % 10 <> 9),
        sm AS (SELECT *, {_SMART_URL} AS u, {_TITLE} AND ordinal % 7 > 2 AND ordinal % 10 <> 8 AS asked FROM postings WHERE ordinal % 7 <> 0 OR ordinal % 14 = 0)
        SELECT url, CASE WHEN url LIKE '%8' THEN '2 Locations' ELSE 'London, Leeds' END AS location, CASE WHEN url LIKE '%8' THEN '' ELSE 'Text' END AS description FROM d
        UNION ALL SELECT u, 'London, GB', CASE WHEN asked THEN 'Duties' || chr(10) || chr(10) || 'More' ELSE '' END FROM sm""",
    "full_descriptions": f"""SELECT page_id::VARCHAR AS page_id, CASE page_id % 6 WHEN 0 THEN 'own text' WHEN 1 THEN 'lever text' ELSE {_PAGE} END AS text, CASE page_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' END AS ats, CASE page_id % 6 WHEN 0 THEN 'acme' WHEN 1 THEN 'bee' END AS slug FROM pages""",
    "guest_pages": VIEWS + " SELECT url, title, company, nullif(location, '') AS location, '- one' || chr(10) || chr(10) || '- two' AS description, CASE WHEN ordinal % 2 = 0 THEN 'contract' END AS employment_type FROM postings",
    "verified_boards": VIEWS + f""", j AS (SELECT 'b' || (ordinal % 40) AS board, ordinal % 40 % 3 AS k, {_TITLE} AND {_PLACE} AS gate, {_PLACE} AS uk, regexp_matches(lower(coalesce(location, '')), '\\blondon\\b') AS london, ordinal % 9 AS r FROM postings),
        g AS (SELECT board, k, count(*) AS total, count(*) FILTER (uk) AS uk, count(*) FILTER (london) AS london, count(*) FILTER (gate) AS gate, count(*) FILTER (k = 0 AND r = 0) AS strong_hits, count(*) FILTER (k > 0 AND r = 1) AS weak_hits FROM j GROUP BY board, k)
        SELECT board, ['Acme Testing Ltd', 'Wise', 'Brightwell'][k + 1] AS company, total, uk, london, gate, strong_hits, weak_hits, strong_hits >= 1 OR (k = 2 AND weak_hits >= 2) AS identity_ok FROM g""",
    "text_functions": VIEWS + r""", v AS (SELECT *, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS f FROM postings), w AS (SELECT *, regexp_replace(f, ' (ltd|inc|group)$', '') AS b FROM v)
        SELECT url, 'https://www.linkedin.com/jobs/view/' || (1000000 + ordinal) AS canonical,
        replace(b, ' ', '') || CASE WHEN f <> b THEN '|' || replace(f, ' ', '') ELSE '' END AS slugs,
        CASE WHEN ordinal % 3 <> 1 THEN 'major' WHEN ordinal % 2 = 0 THEN 'minor' ELSE 'patch' END AS bump, 'a' || chr(10) || chr(10) || 'b ' || title AS lines, 'strong' AS agree, url || '?token=***&x=1' AS redacted FROM w""",
    "post_texts": VIEWS + r""" SELECT url, trim(regexp_replace(replace(regexp_replace(regexp_replace(CASE WHEN marker IS NULL THEN description ELSE coalesce(body, '') END, '(?i)<\s*li[^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM own""",
    "month_labels": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Present' ELSE strftime(o_orderdate, '%b %Y') END AS month, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS applied FROM orders",
    "cv_sources": "SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN (doc_id % 60)::DOUBLE END AS age_hours, doc_id % 13 = 0 OR doc_id % 60 > 24 AS stale, coalesce(length(text), 0)::INT AS chars FROM documents",
    "registries": """WITH c AS (SELECT c_name AS name, c_custkey AS n, c_custkey % 13 AS k FROM customer)
        SELECT name, ['greenhouse', 'workday', 'workday', 'workday', 'workday', 'adzuna', 'adzuna', 'adzuna', 'smartrecruiters', 'lever', 'monster', NULL, 'ashby'][k + 1] AS ats,
        CASE WHEN k IN (0, 8, 10, 11, 12) THEN 'co' || n WHEN k = 1 THEN 'tenant' || n || '/Careers' WHEN k = 2 THEN '/t-' || n || '/Site_1/wd5/' WHEN k = 3 THEN 'tenant' || n WHEN k = 4 THEN 't/Careers/wd99' END AS slug, NULL::VARCHAR AS search, CASE WHEN k = 5 THEN 'qa ' || n END AS what,
        CASE k WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/co' || n || '/jobs?content=true' WHEN 1 THEN 'https://tenant' || n || '.wd3.myworkdayjobs.com/wday/cxs/tenant' || n || '/Careers/jobs' WHEN 2 THEN 'https://t-' || n || '.wd5.myworkdayjobs.com/wday/cxs/t-' || n || '/Site_1/jobs'
          WHEN 5 THEN 'https://api.adzuna.com/v1/api/jobs/gb/search/1' WHEN 7 THEN 'https://api.adzuna.com/v1/api/jobs/ca/search/1' WHEN 8 THEN 'https://api.smartrecruiters.com/v1/companies/co' || n || '/postings?limit=100&offset=0' END AS address,
        CASE WHEN k IN (3, 4) THEN 'not tenant/site or tenant/site/region' WHEN k = 6 THEN 'not a country code of two letters' WHEN k = 9 THEN 'no slug' WHEN k = 10 THEN 'unknown board kind' WHEN k = 11 THEN 'no board kind' WHEN k = 12 THEN 'params are no JSON object' END AS error FROM c""",
}
