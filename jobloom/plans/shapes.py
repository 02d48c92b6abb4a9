"""Queries over texts in many shapes, and their SQL: each posting takes one of a table of inputs, the SQL the result written beside it.

The expected values are written out by hand and share nothing with the functions.
``{t}`` stands for the posting's title, ``{n}`` for its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import dates, payloads, text
from jobloom.operators import board, store
from jobloom.plans import fixtures, oracles
from jobloom.plans.oracles import VIEWS
from jobloom.sources import cv_cache, pastes

HTML = [
    ("<h1>About&nbsp;{t}</h1><ul><li>One &mdash; two</li><li>A&ndash;B &hellip;</li></ul>", "About {t}\n\nOne - two\n\nA-B ..."),
    ("<table><tr><td>{t}</td><th>x</th></tr></table><blockquote>&ldquo;q&rdquo; &rsquo;s &lsquo;t&apos;</blockquote>", "{t}\n\nx\n\n\"q\" 's 't'"),
    ("{t} &amp;lt; &LT; &GT; &Quot;&bull;&middot;&unknown; &#163;5 &#x41; &#X42; &#; &#1114112; &amp", "{t} &lt; < > \"--&unknown; £5 A B &#; &#1114112; &amp"),
    ("a<br/>b<BR>c<span>d</span>e<i>f</i>\r\n\r\n \t\u00a0g<script>s</script>{t}", "a\nb\nc d e f\n\ng s {t}"),
    ("<pre>{t}</pre><link>x<hr>y<head>z", "{t}\n\nx y z"),
    ("<P CLASS='a'>One</P>\n\n\n<section><header>{t}</header></section><footer>end</footer>", "One\n\n{t}\n\nend"),
    ("", ""),
]
VERSIONS = [
    ("Bump lib from 0.1.{n} to 0.2.0", "major"), ("bump lib from 0.1.0 to 0.1.{n}", "patch"), ("Bump the minor-and-patch group with {n} updates", "minor"),
    ("bump the all-major group with 3 updates", "major"), ("Bump the actions group across 2 directories", "unknown"), ("Update x requirement from >=2.8.8 to >=2.9.{n}", "minor"),
    ("bump y from ^20.19.43 to ^21.0.0", "major"), ("bump z from v1.2 to v1.2.{n}", "patch"), ("bump w from 1.2.3-beta.1 to 1.2.{n}", "patch"), ("bump w from abc to 1.{n}", "unknown"),
    ("{n} versions", "unknown"), ("bump q from 1.0,<2 to 1.1", "minor"), ("Bump the majors-minor group", "minor"), ("bump r from 1.x.5 to 1.2", "minor"), ("Bump s from 4 to 4.0.1", "patch"), ("BUMP THE Patch/x GROUP", "minor"),
]
SLUGS = [
    ("Acme{n} Bank", "", "acme{n}|acme{n}bank"), ("Checkout{n}.com", "", "checkout{n}"), ("Marks & Spencer {n}", "", "marksspencer{n}|marks-spencer-{n}|marksandspencer{n}|marks|marks-spencer"),
    ("The Very Group (TVG{n})", "The-Very Group", "theverygroup|very|tvg{n}"), ("X Y", "", "x-y"), ("Group Ltd", "", "groupltd|group-ltd|group"), ("Wise-{n} Labs", "", "wise-{n}|wise-{n}labs"),
    ("?!", "", ""), ("", "", ""), ("Sky", "skyuk{n}", "skyuk{n}|sky"), ("O'Neill, Sons", "", "oneillsons|oneill-sons|oneill"),
]
PASTES = [
    ("{t}\nAcme{n} · London, England, United Kingdom · 2 weeks ago\nEasy Apply\nSave\n\nAbout the job\nWe test.", "{t}", "Acme{n}", "London, England, United Kingdom", "2 weeks ago", "guessed guessed guessed guessed"),
    ("# Job posting\n**Company:** Bee{n}\n**Job title:** {t}\nBased in: Leeds\nPosted: 3 days ago\n\nText", "{t}", "Bee{n}", "Leeds", "3 days ago", "labelled labelled labelled labelled"),
    ("Senior Level | Financial Services | Agile Quality Engineering\n{t}\nLondon, United Kingdom", "Senior Level | Financial Services | Agile Quality Engineering", None, "London, United Kingdom", None, "guessed none guessed none"),
    ("Acme{n} | GBP75,000 + Benefits\n{t}\nRemote UK", "{t}", None, "Remote UK", None, "guessed none guessed none"),
    ("> quoted\n---\n1st degree connection\nApplied\n{t}\nTypical responsibilities:\nWe hire.", "{t}", None, None, None, "guessed none none none"),
    ("Company: X\nCompany: Cee{n}\nTitle: {t}\nLocation: £500 per day", "{t}", "Cee{n}", "£500 per day", None, "labelled labelled labelled none"),
    ("Develop, enhance, and maintain scalable automation frameworks for all of our many teams in several places\nNo visa sponsorship", None, None, None, None, "none none none none"),
    ("Wise{n} · Berlin, Germany\n{t}: apply now:\nBased here", None, None, None, None, "none none none none"),
    ("Employer: Dee{n}\r\n{t}\r\nEff · London · UK · just posted", "{t}", "Dee{n}", "London", "just posted", "guessed labelled guessed guessed"),
    ("", None, None, None, None, "none none none none"),
]
#: Java's notation of a date, and how much later than the date it names.
DATES = ["d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "EEE, dd MMM yyyy '04:05:06 GMT'", "M/d/yyyy", "yyyy/MM/dd", "'Posted on' d MMM yyyy", "d-MMM-yyyy", "MMM d yyyy '4:05 PM'", "'31 Feb 2026'", "'Sometime in' MMM", "d MMM yyyy '04:05:06 +0200'"]


#: A generated text, and the value of its key "k" (none: no object).
OBJECTS = [
    ('{"k": "v{n}", "x": [1]}', "v{n}"), ('```json\n{"k": "w{n}"}\n```', "w{n}"), ('```\n{"k": "x{n}"}```', "x{n}"), ('  {"k": 5}  ', "5"), ("[1, 2]", None), ('"text"', None), ("7", None), ("null", None),
    ("```json\n[1]\n```", None), ("{broken", None), ("", None), ('{"other": 1}', None), ('{"k": {"a": 1}}', '{"a":1}'), ('Sure! {"k": 1}', None),
]


def _template(column: str, cases: list[str | None]) -> Column:
    """The case of each row's number, with its title and number in place."""
    case = F.element_at(F.array(*(F.lit(x) for x in cases)), (F.col("ordinal") % len(cases) + 1).cast("int"))
    return F.replace(F.replace(case, F.lit("{t}"), F.col("title")), F.lit("{n}"), F.col("ordinal").cast("string")).alias(column)


def _lit(x: str | None) -> str:
    if x is None:
        return "NULL"
    return " || ".join("chr(10)" if part == "\n" else "'" + part.replace("'", "''") + "'" for part in _lines(x)) or "''"


def _lines(x: str) -> list[str]:
    out = [part for line in x.split("\n") for part in (line, "\n")][:-1]
    return out if any(out) else [""]


def _wanted(cases: list[str | None]) -> str:
    """SQL of the expected value."""
    return f"replace(replace([{', '.join(map(_lit, cases))}][ordinal % {len(cases)} + 1], '{{t}}', title), '{{n}}', ordinal::VARCHAR)"


def _html(s, d) -> DataFrame:
    return fixtures.postings(s, d).select("url", text.structured_text(_template("x", [x for x, _ in HTML])).alias("text"))


def _versions(s, d) -> DataFrame:
    return fixtures.postings(s, d).select("url", text.version_bump(_template("x", [x for x, _ in VERSIONS])).alias("bump"))


def _slugs(s, d) -> DataFrame:
    alias = _template("x", [x for _, x, _ in SLUGS])
    aliases = F.when(alias == "", F.array().cast("array<string>")).otherwise(F.array(alias))
    return fixtures.postings(s, d).select("url", F.array_join(text.slug_variants(_template("x", [x for x, _, _ in SLUGS]), aliases), "|").alias("slugs"))


def _pastes(s, d) -> DataFrame:
    rows = pastes.with_paste(fixtures.postings(s, d).select("url", _template("advert", [x[0] for x in PASTES])), "advert")
    p = F.col("paste_fields")
    how = F.concat_ws(" ", *(F.coalesce(p[f"{f}_how"], F.lit("none")) for f in pastes.FIELDS))
    return rows.select(F.col("url").alias("posting"), *(p[f].alias(f) for f in pastes.FIELDS), how.alias("how"))


def _dates(s, d) -> DataFrame:
    day = F.date_add(F.lit("2026-01-25").cast("date"), (F.col("ordinal") % 230).cast("int"))
    k = (F.col("ordinal") % len(DATES)).cast("int")
    raw = F.get(F.array(*(F.date_format(day, f) for f in DATES)), k)
    ts = dates.parse_posted_at(raw, F.lit(fixtures.NOW).cast("timestamp"))
    age = dates.age_days(ts, F.lit(fixtures.NOW).cast("timestamp"))
    return fixtures.postings(s, d).select("url", ts.cast("timestamp_ntz").alias("posted_ts"), dates.exact_label(raw, ts, age).alias("label"))


def _objects(s, d) -> DataFrame:
    got = payloads.loads_object(_template("x", [x for x, _ in OBJECTS]))
    return fixtures.postings(s, d).select("url", got.isNotNull().alias("is_object"), payloads.field(got, "$.k").alias("k"))


def _scans(s, d) -> DataFrame:
    """Payloads written over stored ones and read back: of three postings one has a broken payload, one an old one, one a new one."""
    c, p = F.col, fixtures.postings(s, d)
    payload = lambda verdict, n: F.to_json(F.struct("url", F.struct(F.lit(verdict).alias("verdict"), (n / 4).alias("priority_coverage"), F.array(F.struct(c("title").alias("term"))).alias("hard_gaps")).alias("ats"), F.array().cast("array<string>").alias("suggestions")))
    stored = p.select("url", F.lit("old").alias("cv_status"), F.when(c("ordinal") % 3 == 0, "{'ats': ").otherwise(payload("fail", c("ordinal") % 100)).alias("scan"))
    written = p.filter("ordinal % 3 = 1").select("url", payload("pass", c("ordinal") % 60 + 40).alias("scan"))
    rows = store.upsert(stored, written, ["scan"]).withColumn("result", payloads.stored_payload(c("scan")))
    of = lambda path, kind="string": payloads.field(c("result"), path, kind)
    return rows.select("url", "cv_status", c("result").isNotNull().alias("readable"), of("$.ats.verdict").alias("verdict"), of("$.ats.priority_coverage", "double").alias("coverage"), of("$.ats.hard_gaps[0].term").alias("gap"), of("$.ats.reason").alias("reason"))


def _cached(s, d) -> DataFrame:
    """Each document is a CV: copies of 0 to 59 hours, some of another document or of unknown age; two attempts that succeed, fail or give nothing; some without copy, some without document."""
    c, k, now = F.col, F.col("doc_id"), F.lit(fixtures.NOW).cast("timestamp")
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    owner = k.cast("string").alias("owner")
    requests = docs.select(owner, F.when(k % 11 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("doc_id"))
    at = F.when(k % 13 == 0, "long ago").otherwise((now - F.make_interval(hours=(k % 60).cast("int"))).cast("string"))
    copies = docs.filter("doc_id % 7 <> 0").select(owner, F.concat(F.when(k % 5 == 0, "other").otherwise("d"), k.cast("string")).alias("doc_id"), "text", F.lit("export").alias("source"), at.alias("fetched_at"))
    older = copies.withColumns({"text": F.lit("first version"), "fetched_at": F.lit("2020-01-01 00:00:00")})
    tries = docs.select(owner, k.alias("n"), "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    failed = F.when((c("position") == 1) & (c("n") % 3 > 0), "no key").when((c("position") == 2) & (c("n") % 3 == 2), "403")
    attempts = tries.select("owner", "position", F.when(c("position") == 1, "service_account").otherwise("export").alias("source"), F.when(failed.isNull(), F.when(c("n") % 6 == 0, " ").otherwise(F.concat(F.lit("new "), "text"))).alias("text"), failed.alias("error"))
    return cv_cache.texts(requests, copies.unionByName(older), attempts, now).withColumn("text", F.md5("text"))


def _lessons(s, d) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 50).cast("string")).alias("mode"), F.col("ts").cast("string").alias("at"), F.col("event_id").cast("string").alias("evidence"))
    return store.active_lessons(store.lessons(events)).select("mode", "hits", "active_since")


def _joined(s, d) -> DataFrame:
    """The board with all four tables that it joins: a third of the postings has a tailored CV, every second a scan."""
    c, p = F.col, fixtures.postings(s, d)
    tailored = p.filter("ordinal % 3 = 0").select("url", F.when(c("ordinal") % 2 == 0, "draft").otherwise("final").alias("cv_status"))
    scanned = p.filter("ordinal % 2 = 0").select("url", F.when(c("ordinal") % 4 == 0, "pass").otherwise("fail").alias("scan_verdict"), (c("ordinal") % 101).cast("double").alias("scan_coverage"))
    details = p.withColumn("passed_filters", c("ordinal") % 5 > 0)
    rows = board.board(details, fixtures.scores(s, d), fixtures.statuses(s, d), tailored, scanned)
    return rows.select("url", "match_score", "recommendation", "my_status", "cv_status", "scan_verdict", "scan_coverage")


def _pages(s, d) -> DataFrame:
    """The first page of the board by each of its ten keys, in both directions."""
    now = F.lit(fixtures.NOW).cast("timestamp")
    rows = board.board(fixtures.postings(s, d).withColumn("passed_filters", F.lit(True)), fixtures.scores(s, d), fixtures.statuses(s, d))
    rows = rows.withColumns({"posted_ts": dates.parse_posted_at(F.col("posted_at"), now), "language_rank": F.when(F.col("ordinal") % 5 > 0, F.col("ordinal") % 4).cast("int")})
    rows = rows.select("url", *board.SORT_KEYS.values())
    out = None
    for key in board.SORT_KEYS:
        for down in (True, False):
            page = board.first_page(rows, key, down).select(F.lit(f"{key} {'down' if down else 'up'}").alias("sort"), "position", "url")
            out = page if out is None else out.unionAll(page)
    return out


def _pages_sql() -> str:
    keys = {"score": "match_score", "company": "lower(company)", "title": "lower(title)", "location": "lower(location)", "source": "lower(source)", "posted": "posted_ts", "type": "lower(employment_type)", "rate": "day_rate_max", "language": "CASE WHEN ordinal % 5 > 0 THEN ordinal % 4 END", "status": "lower(my_status)"}
    each = [f"SELECT '{k} {way}' AS sort, row_number() OVER (ORDER BY {v} {sql} NULLS LAST, url)::INT AS position, url FROM b" for k, v in keys.items() for way, sql in (("down", "DESC"), ("up", "ASC"))]
    return VIEWS + f", a AS ({oracles.SQL['posted_age']}), b AS (SELECT * FROM postings LEFT JOIN scores USING (url) LEFT JOIN statuses USING (url) LEFT JOIN a USING (url)), e AS ({' UNION ALL '.join(each)}) SELECT * FROM e WHERE position <= 50"


QUERIES = {"board_pages": _pages, "active_lessons": _lessons, "board_joined": _joined, "cv_texts": _cached, "json_objects": _objects, "scan_payloads": _scans} | {"structured_shapes": _html, "version_shapes": _versions, "slug_shapes": _slugs, "pasted_adverts": _pastes, "written_dates": _dates}
SQL = {
    "board_pages": _pages_sql(),
    "active_lessons": "SELECT mode, count(*)::INT AS hits, (max(ts) FILTER (n = 2))::VARCHAR AS active_since FROM (SELECT event_type || '-' || (user_id % 50) AS mode, ts, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts, event_id::VARCHAR) AS n FROM events) GROUP BY mode HAVING count(*) >= 2",
    "board_joined": VIEWS + """ SELECT p.url, s.match_score, coalesce(s.recommendation, 'not_evaluated') AS recommendation, t.my_status, CASE WHEN ordinal % 3 = 0 THEN CASE WHEN ordinal % 2 = 0 THEN 'draft' ELSE 'final' END END AS cv_status,
        CASE WHEN ordinal % 2 = 0 THEN CASE WHEN ordinal % 4 = 0 THEN 'pass' ELSE 'fail' END END AS scan_verdict, CASE WHEN ordinal % 2 = 0 THEN (ordinal % 101)::DOUBLE END AS scan_coverage
        FROM postings p LEFT JOIN scores s USING (url) LEFT JOIN statuses t USING (url) WHERE ordinal % 5 > 0""",
    "cv_texts": f"""WITH x AS (SELECT doc_id AS n, doc_id::VARCHAR AS owner, doc_id % 11 <> 0 AS asked, doc_id % 7 <> 0 AS copied, doc_id % 13 = 0 AS undated, doc_id % 60 AS hours, text, TIMESTAMP '{fixtures.NOW}' - to_hours(doc_id % 60) AS stamp FROM documents),
        y AS (SELECT *, CASE WHEN NOT asked THEN CASE WHEN copied THEN 'alone' ELSE 'nothing' END WHEN copied AND n % 5 <> 0 AND NOT undated AND hours <= 24 THEN 'hit' WHEN n % 3 <> 2 AND n % 6 <> 0 THEN 'fetched' WHEN copied THEN 'stale' ELSE 'nothing' END AS how,
              CASE WHEN n % 6 = 0 THEN 'service_account: the document is empty#export: the document is empty' ELSE 'service_account: no key#export: 403' END AS why FROM x)
        SELECT owner, CASE WHEN how = 'fetched' THEN md5('new ' || text) WHEN how <> 'nothing' THEN md5(text) END AS text, CASE WHEN how = 'fetched' THEN CASE WHEN n % 3 = 0 THEN 'service_account' ELSE 'export' END WHEN how <> 'nothing' THEN 'cache' END AS source,
        CASE WHEN how IN ('alone', 'hit', 'stale') THEN 'export' END AS cached_source, CASE WHEN how = 'fetched' THEN 'd' || n WHEN how <> 'nothing' THEN CASE WHEN n % 5 = 0 THEN 'other' ELSE 'd' END || n END AS doc_id,
        CASE WHEN how = 'fetched' THEN '{fixtures.NOW}' WHEN how <> 'nothing' THEN CASE WHEN undated THEN 'long ago' ELSE strftime(stamp, '%Y-%m-%d %H:%M:%S') END END AS fetched_at,
        CASE how WHEN 'alone' THEN undated OR hours > 24 WHEN 'stale' THEN true WHEN 'nothing' THEN NULL ELSE false END AS stale, CASE WHEN how = 'fetched' THEN 0 WHEN how <> 'nothing' AND NOT undated THEN hours END::DOUBLE AS age_hours,
        CASE how WHEN 'alone' THEN 'no document configured' WHEN 'stale' THEN replace(why, '#', '; ') END AS reason, CASE WHEN how = 'nothing' THEN CASE WHEN asked THEN 'could not read the document ' || replace(why, '#', ' | ') ELSE 'no document configured' END END AS error FROM y""",
    "json_objects": VIEWS + f" SELECT url, ordinal % {len(OBJECTS)} IN ({', '.join(str(k) for k, (x, y) in enumerate(OBJECTS) if y is not None or 'other' in x)}) AS is_object, {_wanted([y for _, y in OBJECTS])} AS k FROM postings",
    "scan_payloads": VIEWS + """ SELECT url, 'old' AS cv_status, ordinal % 3 > 0 AS readable, CASE ordinal % 3 WHEN 1 THEN 'pass' WHEN 2 THEN 'fail' END AS verdict,
        CASE ordinal % 3 WHEN 1 THEN (ordinal % 60 + 40) / 4 WHEN 2 THEN (ordinal % 100) / 4 END::DOUBLE AS coverage, CASE WHEN ordinal % 3 > 0 THEN title END AS gap, NULL::VARCHAR AS reason FROM postings""",
    "structured_shapes": VIEWS + f" SELECT url, {_wanted([y for _, y in HTML])} AS text FROM postings",
    "version_shapes": VIEWS + f" SELECT url, {_wanted([y for _, y in VERSIONS])} AS bump FROM postings",
    "slug_shapes": VIEWS + f" SELECT url, {_wanted([y for _, _, y in SLUGS])} AS slugs FROM postings",
    "pasted_adverts": VIEWS + f" SELECT url AS posting, {', '.join(f'{_wanted([x[k] for x in PASTES])} AS {f}' for k, f in enumerate((*pastes.FIELDS, 'how'), 1))} FROM postings",
    "written_dates": VIEWS + f""", w AS (SELECT url, ordinal % {len(DATES)} AS k, DATE '2026-01-25' + (ordinal % 230)::INT AS day FROM postings),
        t AS (SELECT url, k, day, CASE k WHEN 4 THEN day + INTERVAL '4 hours 5 minutes 6 seconds' WHEN 9 THEN day + INTERVAL '16 hours 5 minutes' WHEN 10 THEN TIMESTAMP '2026-03-03 00:00:00' WHEN 11 THEN NULL WHEN 12 THEN day + INTERVAL '2 hours 5 minutes 6 seconds' ELSE day::TIMESTAMP END AS posted_ts FROM w),
        a AS (SELECT *, date_diff('day', posted_ts::DATE, DATE '{fixtures.NOW[:10]}') AS age FROM t)
        SELECT url, posted_ts, CASE WHEN k = 11 THEN 'Unreadable date: "Sometime in ' || strftime(day, '%b') || '"' ELSE strftime(posted_ts, '%a %-d %b %Y') || ' (' || age || CASE WHEN age = 1 THEN ' day ago)' ELSE ' days ago)' END END AS label FROM a""",
}
