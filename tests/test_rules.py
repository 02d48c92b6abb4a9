"""Vectors for the text, date and rate functions and the screens."""

import datetime

import pytest
from pyspark.sql import functions as F

from jobloom.functions import dates, rates, text
from jobloom.operators import screen


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


LANGUAGES = [
    ("Our checks are written in Java", "priority"), ("You will look after a Rails monolith", "priority"), ("Specifications in Spock", "priority"), ("A build with Maven", "priority"),
    ("Browser scripts in JavaScript", "secondary"), ("Services on Node", "secondary"), ("The suite runs on pytest", "mismatch"), ("All of it is Kotlin", "mismatch"),
    ("Mostly C#, some PHP", "mismatch"), ("Python by day, Ruby by night", "priority"), ("We value curious people", "none"), ("Javanese cooking, scalable kitchens", "none"),
]
CLEARANCE = [
    ("Tester (SC cleared)", "Two days a week in the office.", "blocked"), ("Tester", "A valid DV is what we ask for first.", "blocked"), ("Tester", "You must hold DV before day one", "blocked"),
    ("Tester", "NPPV3 clearance is mandatory on this site", "blocked"), ("Tester", "People who hold an existing SC can start at once", "blocked"), ("Tester", "Security clearance: essential", "blocked"),
    ("Tester", "You should be able to obtain SC clearance", "possible"), ("Tester", "We run a BPSS check on everybody", "possible"), ("Tester", "Active SC would be a plus", "possible"),
    ("Tester", "We do security vetting after you join", "possible"), ("Tester", "Pair with developers, report clearly.", "none"), ("Tester", "Essential: patience", "none"),
]
DAY_RATES = [
    ("We pay £410 per day", (410, 410)), ("£395/day, weekly invoices", (395, 395)), ("£610pd on invoice", (610, 610)), ("£520 p/d", (520, 520)), ("£333 a day", (333, 333)), ("our day rate is £505", (505, 505)), ("between £420 - £480 per day", (420, 480)),
    ("£350-£400/day", (350, 400)), ("£1,200 per day", (1200, 1200)), ("£299.50 per day", (299.5, 299.5)), ("£500 per day and a travel allowance of £60 per day", (500, 500)), ("£700 to £650 per day", (650, 700)),
    ("£80,000 a year", None), ("up to £72k", None), ("travel allowance £45 per day", None), ("subsistence: £30 per day", None), ("£20 per day", None), ("", None), (None, None),
]
IR35 = [
    ("The role is inside IR35", "inside"), ("InsideIR35, hybrid", "inside"), ("We regard it as outside IR35", "outside"), ("OutsideIR35", "outside"), ("IR35 determination: outside", "outside"),
    ("IR35 = inside", "inside"), ("It is within scope of IR35", "inside"), ("You would be caught by IR35", "inside"), ("It counts as deemed employment", "inside"), ("Umbrella basis", "inside"),
    ("PAYE only please", "inside"), ("Limited company welcome", "outside"), ("Outside of the scope of IR35", "outside"), ("It is not outside IR35", "inside"), ("This is never inside IR35", "outside"),
    ("Outside IR35, umbrella only where you wish", "outside"), ("Some teams inside IR35, some outside IR35", "unknown"), ("A contract for the summer", "unknown"), ("", "unknown"),
]


def test_languages_and_clearance(spark):
    rows = spark.createDataFrame([(i, "", d) for i, (d, _) in enumerate(LANGUAGES)], "i int, title string, description string")
    got = screen.with_language(screen.with_advert(rows)).orderBy("i").collect()
    assert [r.language_tier for r in got] == [t for _, t in LANGUAGES]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(CLEARANCE)], "i int, title string, description string")
    got = screen.with_clearance(screen.with_advert(rows)).orderBy("i").collect()
    assert [r.clearance_status for r in got] == [s for *_, s in CLEARANCE]
    assert all((r.clearance_evidence is None) == (r.clearance_status == "none") for r in got)


def test_day_rates_and_ir35(spark):
    got = column(spark, [t for t, _ in DAY_RATES], rates.parse_day_rates)
    assert [g and (g["min"], g["max"]) for g in got] == [w for _, w in DAY_RATES]
    assert [g["status"] for g in column(spark, [t for t, _ in IR35], rates.detect_ir35)] == [s for _, s in IR35]


def test_tax_pins():
    m = rates.RateModel(target_salary=100000.0)
    figures = [m.income_tax(1e5), m.employee_nic(1e5), m.net_salary(1e5), m.employer_nic(1e5), m.employer_pension(1e5), m.levy(1e5), m.corporation_tax(50000.0), m.corporation_tax(250000.0)]
    assert figures == pytest.approx([27432.0, 4010.6, 68557.4, 14250.0, 1320.9, 425.0, 9500.0, 62500.0])
    assert m.thresholds(220) == pytest.approx((532.71, 492.22), abs=0.01)
    assert m.thresholds(260)[0] == pytest.approx(450.75, abs=0.01)
    for x in (12000.0, 60000.0, 110000.0, 140000.0, 200000.0):
        assert m.salary_for_net(m.net_salary(x)) == pytest.approx(x)
        assert m.inside_salary(m.inside_assignment(x)) == pytest.approx(x)


def test_tax_columns_equal_numbers(spark):
    m = rates.RateModel()
    values = [0.0, 150.0, 300.0, 420.0, 610.0, 800.0, 1500.0, 2500.0]
    rows = spark.createDataFrame([(v, s) for v in values for s in ("inside", "outside")], "r double, s string")
    for r in rates.with_perm_equivalent(rows, F.col("r"), F.col("s"), "worth").collect():
        assert r.worth == pytest.approx(m.perm_equivalent(r.r, r.s), abs=1e-6)


def test_titles_and_places(spark):
    titles = {"Senior SDET": True, "Hardware Test Engineer": False, "Embedded SDET": True, "Software Developer": False, "QA Engineer": True, None: False}
    assert column(spark, list(titles), screen.title_is_relevant) == list(titles.values())
    places = {"London": True, "Remote - UK": True, "Bristol": False, "Ukraine": False, "": False, None: False, "United Kingdom": True}
    assert column(spark, list(places), screen.location_is_allowed) == list(places.values())


def test_dates(spark):
    now = F.lit("2026-09-21 12:00:00").cast("timestamp")
    want = {"2026-09-16T04:04:36Z": "2026-09-16 04:04:36", "1758000000000": "2025-09-16 05:20:00", "1758000000": "2025-09-16 05:20:00", "2 weeks ago": "2026-09-07 12:00:00", "yesterday": "2026-09-20 12:00:00", "today": "2026-09-21 12:00:00", "a week ago": "2026-09-14 12:00:00", "about 2 months ago": "2026-07-21 12:00:00", "5 hours ago": "2026-09-21 07:00:00", "": None, "Not stated": None, "ASAP": None, None: None, "2026-02-31": None}
    got = column(spark, list(want), lambda c: dates.parse_posted_at(c, now).cast("string"))
    assert got == list(want.values())
    assert column(spark, ["1 month ago"], lambda c: dates.parse_posted_at(c, F.lit("2026-03-31 00:00:00").cast("timestamp")).cast("string")) == ["2026-03-03 00:00:00"]
    ages = spark.createDataFrame([(0,), (1,), (6,), (13,), (20,), (100,), (800,), (None,)], "d int").select(dates.age_label(F.col("d")).alias("x")).collect()
    assert [r.x for r in ages] == ["today", "yesterday", "6 days ago", "1 week ago", "3 weeks ago", "3 months ago", "2y ago", "no date"]


def test_texts(spark):
    assert column(spark, ["<p>a</p><ul><li>b &amp; c</li></ul>&#163;5&#x41;", None, ""], text.structured_text) == ["a\n\nb & c\n\n£5A", "", ""]
    assert column(spark, ["Acme Ltd", "The Acme Group", "Acme, Inc.", None], text.company_key) == ["acme", "acme", "acme", ""]
    titles = ["QA Engineer X2", "QA Engineer (Contract)", "QA Engineer - Remote - ASAP", "Engineer QA 6 month contract"]
    assert column(spark, titles, text.title_tokens) == [["engineer", "qa"]] * 4
    assert column(spark, ["UK", "London, UK", "", None, "Ankara"], text.is_vague_location) == [True, False, True, True, False]
    assert column(spark, ["https://www.linkedin.com/jobs/view/qa-engineer-4012345678/?x=1", " https://x.y "], text.canonical_url) == ["https://www.linkedin.com/jobs/view/4012345678", "https://x.y"]
    assert column(spark, ["a\n\n\n\n b \n"], text.collapse_lines) == ["a\n\nb"]
    assert column(spark, ["short", None, "x" * 500, "x" * 500 + "..."], text.looks_truncated) == [True, True, False, True]


def test_month_arithmetic_is_pure(spark):
    assert column(spark, ["2021-03", "present", "soon"], dates.month_label) == ["Mar 2021", "Present", "soon"]
    assert column(spark, ["2026-09-01", "1 Sep 2026", "x"], dates.application_date) == [datetime.date(2026, 9, 1)] * 2 + [None]


def test_noise_words_of_names():
    from jobloom.functions.terms import noise_terms

    assert noise_terms("Go Compare") == {"compare", "gc"} and noise_terms("AT&T") == {"at"}
    assert noise_terms("", "Anson McCade") == {"anson", "mccade"} and noise_terms("One Two Three Four Five") == {"one", "two", "three", "four", "five"}
    assert noise_terms(None, None) == frozenset()
