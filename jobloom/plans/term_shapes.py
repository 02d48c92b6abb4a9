"""Queries of terms, gaps, scans and suggestions over adverts in several layouts, and their SQL.

Each posting takes one of six adverts; every value in the SQL was derived by hand
from the rules and shares nothing with the code that is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.lexicon import Lexicon
from jobloom.operators import briefs, coverage
from jobloom.plans import fixtures
from jobloom.plans.oracles import SQL as ORACLES
from jobloom.plans.oracles import STRIP, VIEWS

_SKILLS = {"java": "java", "javascript": "javascript", "js": "javascript", "spring boot": "spring boot", "spring": "spring", "aws": "aws", "amazon web services": "aws", "testing library": "testing library", "c++": "c++"}
LEXICON = Lexicon(_SKILLS, frozenset("a about and at do for have in is of or the to us we what will with you you'll".split()), frozenset(["nice"]))
CV = "Java suites, Spring Boot services. Checked a testing library and pipeline; AWS."
MASTER = "JavaScript"
#: Words that are no terms, for texts that are long enough to be judged.
_FILL = "\n" + "the of " * 200
#: Title, company and text: marked headings; a colon, capitals and an employer named like a skill; headings by their words alone; nothing; one skill; no heading.
ADVERTS = [
    ("Java Engineer", "Acme", "# Requirements\n- Java and JS\n- Spring Boot with the spring\n\n## What you'll do\nMaintain pipelines.\n\n### Nice to have\nAWS" + _FILL),
    ("Tester", "Spring Boot Systems", "We at SBS use systems daily.\n\nYou will need:\nSpring\nBenefits:\nGym\nDUTIES\n\nWrite boot checks for the SBS of daily use" + _FILL),
    (None, None, "Tech Stack\nC++ and testing libraries, Amazon Web Services (AWS).\nAbout us\naws aws\n\nEssential skills\nC++"),
    (None, "Bee", None),
    (None, None, "Requirements:\nJava" + _FILL),
    ("", "", "We use Java." + _FILL),
]
#: Advert, term, count, in requirements, in duties, in nice to have, skill, capitalised, in title, weight, section, priority, on the CV, in the fact base.
TERMS = """
(0, 'requirements', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false), (0, 'java', 1, 1, 0, 0, true, true, true, 4.0, 'requirements', true, true, false),
(0, 'javascript', 1, 1, 0, 0, true, true, false, 4.0, 'requirements', true, false, true), (0, 'spring boot', 1, 1, 0, 0, true, false, false, 4.0, 'requirements', true, true, false),
(0, 'spring', 1, 1, 0, 0, true, true, false, 4.0, 'requirements', true, true, false), (0, 'maintain', 1, 0, 1, 0, false, true, false, 2.5, 'duties', true, false, false),
(0, 'pipelines', 1, 0, 1, 0, false, false, false, 2.5, 'duties', false, true, false), (0, 'aws', 1, 0, 0, 1, true, true, false, 1.5, 'nice-to-have', false, true, false),
(0, 'engineer', 1, 0, 0, 0, false, true, true, 1.0, 'mentioned', true, false, false),
(1, 'use', 2, 0, 1, 0, false, false, false, 3.5, 'duties', false, false, false), (1, 'daily', 2, 0, 1, 0, false, false, false, 3.5, 'duties', false, false, false),
(1, 'need', 1, 0, 0, 0, false, false, false, 1.0, 'mentioned', false, false, false), (1, 'spring', 1, 1, 0, 0, true, true, false, 4.0, 'requirements', true, true, false),
(1, 'benefits', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false), (1, 'gym', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false),
(1, 'duties', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false), (1, 'write', 1, 0, 1, 0, false, true, false, 2.5, 'duties', true, false, false),
(1, 'checks', 1, 0, 1, 0, false, false, false, 2.5, 'duties', false, true, false), (1, 'tester', 1, 0, 0, 0, false, true, true, 1.0, 'mentioned', true, false, false),
(2, 'tech', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false), (2, 'stack', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false),
(2, 'c++', 2, 1, 0, 0, true, true, false, 5.0, 'requirements', true, false, false), (2, 'testing library', 1, 0, 0, 0, true, false, false, 1.0, 'mentioned', false, true, false),
(2, 'aws', 4, 0, 0, 0, true, true, false, 4.0, 'mentioned', true, true, false), (2, 'essential', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false),
(2, 'skills', 1, 0, 0, 0, false, false, false, 1.0, 'mentioned', false, false, false),
(4, 'requirements', 1, 0, 0, 0, false, true, false, 1.0, 'mentioned', false, false, false), (4, 'java', 1, 1, 0, 0, true, true, false, 4.0, 'requirements', true, true, false),
(5, 'use', 1, 0, 0, 0, false, false, false, 1.0, 'mentioned', false, false, false), (5, 'java', 1, 0, 0, 0, true, true, false, 1.0, 'mentioned', false, true, false)"""
#: Advert, heading, term.
GAPS = """
(0, 'background', 'requirements'), (0, 'evidenced', 'java'), (0, 'dropped', 'javascript'), (0, 'evidenced', 'spring boot'), (0, 'evidenced', 'spring'), (0, 'priority gap', 'maintain'), (0, 'background', 'pipelines'), (0, 'background', 'aws'), (0, 'priority gap', 'engineer'),
(1, 'background', 'use'), (1, 'background', 'daily'), (1, 'background', 'need'), (1, 'evidenced', 'spring'), (1, 'background', 'benefits'), (1, 'background', 'gym'), (1, 'background', 'duties'), (1, 'priority gap', 'write'), (1, 'background', 'checks'), (1, 'priority gap', 'tester'),
(2, 'background', 'tech'), (2, 'background', 'stack'), (2, 'hard gap', 'c++'), (2, 'background', 'testing library'), (2, 'evidenced', 'aws'), (2, 'background', 'essential'), (2, 'background', 'skills'),
(4, 'background', 'requirements'), (4, 'evidenced', 'java'), (5, 'background', 'use'), (5, 'background', 'java')"""
#: Advert, verdict, why it is unreliable, terms, present, priority terms, of these on the CV, hard gaps, and the lists, heaviest first.
SCANS = """
(0, 'fail', NULL, 9, 5, 6, 3, 1, 'javascript', 'javascript|maintain|engineer', 'java|spring|spring boot', 'javascript', 'maintain|engineer'), (1, 'borderline', NULL, 10, 2, 3, 1, 0, '', 'write|tester', 'spring', '', 'write|tester'),
(2, 'unknown', 'snippet', 7, 2, 2, 1, 1, 'c++', 'c++', 'aws', '', 'c++'), (3, 'unknown', 'snippet', 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL),
(4, 'pass', NULL, 2, 1, 1, 1, 0, '', '', 'java', '', ''), (5, 'unknown', 'no_headings', 2, 1, 0, 0, 0, '', '', '', '', '')"""
_LISTS = ("hard_gaps", "priority_gaps", "evidenced", "closable", "unclosable")


def _adverts(s, d) -> DataFrame:
    k = (F.col("ordinal") % len(ADVERTS)).cast("int")
    pick = lambda i: F.get(F.array(*(F.lit(a[i]).cast("string") for a in ADVERTS)), k)
    return fixtures.postings(s, d).select("url", pick(0).alias("title"), pick(1).alias("company"), pick(2).alias("post_text"))


def _found(s, d) -> DataFrame:
    return coverage.posting_terms(_adverts(s, d), LEXICON, marks={"on_cv": CV, "in_master": MASTER})


def _scan(s, d) -> DataFrame:
    rows = coverage.scan(_adverts(s, d), CV, MASTER, LEXICON)
    shares = [F.round(c, 6).alias(c) for c in ("priority_coverage", "all_term_coverage")]
    return rows.select("url", "verdict", "unreliable", "terms_found", "present", "priority_total", "priority_on_cv", "hard_gap_count", *shares, *(F.array_join(c, "|").alias(c) for c in _LISTS))


def _figures(s, d) -> DataFrame:
    return coverage.gap_figures(_found(s, d), CV).select("url", "total", "present", F.round("percent", 6).alias("percent"), F.round("priority_percent", 6).alias("priority_percent"))


def _suggested(s, d) -> DataFrame:
    facts = [("r1", "a1", "Wrote JavaScript checks for shops", [], []), ("r1", "a2", " Java suites, Spring Boot services ", ["js"], None), ("r2", "a3", "Nothing of use", None, ["3"]), ("r2", "a4", None, [], [])]
    known = s.createDataFrame(facts, "role_id string, achievement_id string, text string, tags array<string>, metrics array<string>")
    out = coverage.suggestions(coverage.with_coverage(_found(s, d), CV, MASTER), known, CV)
    return out.select("url", "role_id", "achievement_id", "text", "kind", "overlap", F.array_join("closes", "|").alias("closes"), "weight_closed", "rank")


def _contexts(s, d) -> DataFrame:
    return briefs.contexts(_adverts(s, d), _found(s, d), ["Acme", "", "Bee"], {"Languages": ["Java"], "Domains": ["Banking", "Retail"], "Tools": []})


def _briefs(s, d) -> DataFrame:
    rows = briefs.with_brief(fixtures.postings(s, d), F.concat(F.lit("Type: "), "employment_type"))
    return rows.select("url", "note", F.md5("brief").alias("brief"))


QUERIES = {
    "contexts": _contexts,
    "briefs": _briefs,
    "term_shapes": lambda s, d: _found(s, d).select("url", "term", "count", "in_requirements", "in_duties", "in_nice", "skill", "capitalised", "in_title", "weight", "section", "priority", "on_cv", "in_master"),
    "gap_shapes": lambda s, d: coverage.gap_report(_found(s, d), CV, MASTER).select("url", "heading", "term"),
    "gap_figures": _figures,
    "scan_shapes": _scan,
    "suggestion_shapes": _suggested,
}
_T = f"t(k, term, count, in_requirements, in_duties, in_nice, skill, capitalised, in_title, weight, section, priority, on_cv, in_master) AS (VALUES {TERMS})"
_S = f"s(k, verdict, unreliable, terms_found, present, priority_total, priority_on_cv, hard_gap_count, {', '.join(_LISTS)}) AS (VALUES {SCANS})"
_KEY = f"k = ordinal % {len(ADVERTS)}"
SQL = {
    "contexts": VIEWS + f""" SELECT url, concat_ws(chr(10), 'Employers so far: Acme, Bee', 'Never employed by: ' || CASE ordinal % 6 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Spring Boot Systems' WHEN 3 THEN 'Bee' WHEN 5 THEN '' ELSE '(not stated)' END, 'Domains: Banking, Retail', 'Skill groups: Languages, Tools',
        'Not in the fact base: ' || CASE ordinal % 6 WHEN 0 THEN 'java, spring, spring boot, maintain, engineer' WHEN 1 THEN 'spring, write, tester' WHEN 2 THEN 'c++, aws' WHEN 4 THEN 'java' END) AS context FROM postings""",
    "briefs": VIEWS + f""", cut AS ({ORACLES['truncated']}), n AS (SELECT *, CASE WHEN marker IS NOT NULL THEN CASE WHEN body IS NULL THEN 'unreadable' ELSE 'excerpt' END WHEN truncated AND description <> '' THEN 'snippet' END AS note, trim({STRIP.format('description')}, chr(9) || chr(10) || chr(13) || ' ') AS bare FROM own JOIN cut USING (url))
        SELECT url, note, md5(concat_ws(chr(10), 'Company: ' || coalesce(company, ''), 'Title: ' || coalesce(title, ''), 'Location: ' || coalesce(location, ''), 'Address: ' || url,
        CASE note WHEN 'snippet' THEN 'Note: the text is a snippet of the advert. What it does not say is unknown, not absent.' WHEN 'excerpt' THEN 'Note: the text was taken out of a page that also lists other adverts.' WHEN 'unreadable' THEN 'Note: the stored page lists other adverts and this one could not be found in it. Judge by company, title and place.' END,
        '', CASE WHEN marker IS NOT NULL THEN coalesce(body, '(no text)') ELSE coalesce(nullif(bare, ''), '(no text)') END, '', 'Type: ' || employment_type)) AS brief FROM n""",
    "term_shapes": VIEWS + f", {_T} SELECT url, t.* EXCLUDE (k) REPLACE (weight::DOUBLE AS weight) FROM postings JOIN t ON {_KEY}",
    "gap_shapes": VIEWS + f", g(k, heading, term) AS (VALUES {GAPS}) SELECT url, heading, term FROM postings JOIN g ON {_KEY}",
    "gap_figures": VIEWS + f", {_S} SELECT url, terms_found AS total, present, round(100.0 * present / terms_found, 6)::DOUBLE AS percent, CASE WHEN priority_total = 0 THEN 0.0 ELSE round(100.0 * priority_on_cv / priority_total, 6) END::DOUBLE AS priority_percent FROM postings JOIN s ON {_KEY} WHERE terms_found > 0",
    "scan_shapes": VIEWS + f", {_S} SELECT url, s.* EXCLUDE (k), CASE WHEN priority_total = 0 THEN 100.0 ELSE round(100.0 * priority_on_cv / priority_total, 6) END::DOUBLE AS priority_coverage, CASE WHEN terms_found = 0 THEN 0.0 ELSE round(100.0 * present / terms_found, 6) END::DOUBLE AS all_term_coverage FROM postings JOIN s ON {_KEY}",
    "suggestion_shapes": VIEWS + f" SELECT url, 'r1' AS role_id, x.* FROM postings, (VALUES ('a1', 'Wrote JavaScript checks for shops', 'add_achievement', 0.25::DOUBLE, 'javascript', 4.0::DOUBLE, 1), ('a2', 'Java suites, Spring Boot services', 'reword_achievement', 1.0, 'javascript', 4.0, 2)) x(achievement_id, text, kind, overlap, closes, weight_closed, rank) WHERE ordinal % {len(ADVERTS)} = 0",
}
