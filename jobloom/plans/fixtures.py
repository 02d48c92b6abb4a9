"""Deterministic posting views over the driver's tables, in SQL that Spark and DuckDB both read.

Only integer arithmetic on keys decides what a row looks like, so both engines
build the same rows; every class of the screens occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment that ages and windows are measured from.
NOW = "2026-09-21 12:00:00"


def _case(n: int, step: int, values: list[str]) -> str:
    """CASE over a key's remainder; values are SQL expressions."""
    return f"CASE (o_orderkey {'' if step == 1 else f'* {step} '}) % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _q(*texts: str) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" if t is not None else "CAST(NULL AS STRING)" for t in texts]


TITLES = _q("Test Engineer", "Test Engineer (Contract)", "QA Engineer X2", "Senior SDET", "Principal SDET", "QA Analyst - Remote - ASAP", "Hardware Test Engineer", "Software Developer", "Quality Assurance Engineer", "QA Engineer", "Sales Engineer", "Test Automation Engineer 6 month contract")
PLACES = _q("London", "London, UK", "UK", "Bristol", "Remote", "Leeds", "Remote - United Kingdom", "Bucharest, Romania", "Ankara, Turkey", "Greater London", None)
_BODY = "The role is a permanent one in a small team that builds payment services. You will own the automated checks of several Java services, pair with developers, and keep the pipelines quick and honest. Experience with JUnit and Maven is needed, Spring is welcome."
DESCRIPTIONS = _q(
    "We test Java services with JUnit and Maven.", "A Ruby on Rails shop that uses RSpec and Capybara.", "JavaScript and Node.js end to end tests.", "C# and .NET automation with Playwright.",
    "Python, pytest and Playwright suites.", "Manual and exploratory testing…", "Active SC clearance required. Java tests.", "You must be eligible for SC clearance; BPSS to start. Groovy.",
    "Contract at £450 - £550 per day, Outside IR35. Groovy and Spock.", "Day rate £300 per day inside IR35, umbrella company only. Kotlin.", "Contract £620 per day. IR35 status: inside. You must already hold DV. Java.",
    "Travel allowance £250 per day. Not outside IR35. £700/day. Java and Spring.", "What? Where? Search ❮ back to last search Apply for this job " + _BODY + " Popular Jobs Python Playwright Recruiters", "What? Where? Search Popular Jobs Recruiters Python",
    "Ltd company welcome. £540 per day. <p>Swift</p>", "<p>Security clearance: required.</p><ul><li>Scala &amp; PHP</li></ul>", "Rate: £400 per day.",
)
DATES = ["CAST(CAST(o_orderdate AS DATE) AS STRING)", "CAST(1758000000000 + (o_orderkey % 300) * 86400000 AS STRING)", "CAST(o_orderkey % 60 AS STRING) || ' days ago'", "'yesterday'", "CAST(o_orderkey % 9 + 1 AS STRING) || ' weeks ago'", "CAST(NULL AS STRING)", "'Competitive'", "'2026-09-16T04:04:36Z'", "CAST(1780000000 + o_orderkey % 1000000 AS STRING)"]

#: Every order is a posting, and so is every document without an order of its number; each document is read whole, by one posting.
POSTINGS = f"""
SELECT 'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS url,
       c_name || {_case(4, 1, _q("", " Ltd", ", Inc.", " Group"))} AS company,
       {_case(12, 7, TITLES)} AS title,
       {_case(11, 3, PLACES)} AS location,
       {_case(9, 1, DATES)} AS posted_at,
       {_case(17, 5, DESCRIPTIONS)} || ' ' || coalesce(text, '') AS description,
       {_case(5, 1, _q("contract", "permanent", "unknown", "contract", None))} AS employment_type,
       CAST(CASE WHEN o_orderkey % 6 = 0 THEN 200 + o_orderkey % 500 END AS DOUBLE) AS day_rate_min,
       CAST(CASE WHEN o_orderkey % 6 = 0 THEN 250 + o_orderkey % 500 END AS DOUBLE) AS day_rate_max,
       CASE WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'estimated_by_adzuna' ELSE 'derived_from_advertised_salary' END END AS day_rate_source,
       CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 00:00:00' AS fetched_at,
       {_case(4, 1, _q("greenhouse", "adzuna", "manual", "lever"))} AS source,
       o_orderkey AS ordinal
FROM (SELECT coalesce(o_orderkey, doc_id) AS o_orderkey, coalesce(o_custkey, doc_id % (SELECT count(*) FROM {{customer}})) AS o_custkey,
             coalesce(CAST(o_orderdate AS DATE), DATE '2026-01-01' + CAST(doc_id % 200 AS INT)) AS o_orderdate, text
      FROM {{orders}} FULL JOIN {{documents}} ON doc_id = o_orderkey) o
LEFT JOIN {{customer}} c ON c.c_custkey = o.o_custkey"""

SCORES = """
SELECT 'https://jobs.example.com/' || CAST(l_orderkey AS STRING) AS url,
       CAST(1 + (sum(CAST(l_quantity AS BIGINT)) * 7 + l_orderkey) % 100 AS INT) AS match_score,
       CASE WHEN l_orderkey % 3 = 0 THEN 'apply' WHEN l_orderkey % 3 = 1 THEN 'consider' ELSE 'skip' END AS recommendation
FROM {lineitem} WHERE l_orderkey % 4 <> 1 GROUP BY l_orderkey"""

STATUSES = """
SELECT 'https://jobs.example.com/' || CAST(o_orderkey AS STRING) AS url,
       CASE WHEN o_orderkey % 5 = 0 THEN 'applied' WHEN o_orderkey % 5 = 1 THEN 'saved' WHEN o_orderkey % 5 = 2 THEN 'skipped' WHEN o_orderkey % 5 = 3 THEN 'interview' ELSE 'rejected' END AS my_status,
       CAST(NULL AS STRING) AS notes, CAST(CAST(o_orderdate AS DATE) AS STRING) AS updated_at,
       CASE WHEN o_orderkey % 14 = 0 THEN 'https://jobs.example.com/1' END AS inherited_from
FROM {orders} WHERE o_orderkey % 7 = 0"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "documents", "lineitem") if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POSTINGS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORES)


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, STATUSES)


def duck(sql: str) -> str:
    """The same view for DuckDB."""
    return sql.format(orders="orders", customer="customer", documents="documents", lineitem="lineitem")
