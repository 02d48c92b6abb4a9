"""Registered queries of whole runs: batches taken into the stored tables, CSV runs written and read back, guest pages in several layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom import folders, schemas
from jobloom.functions import text
from jobloom.operators import store
from jobloom.plans import fixtures
from jobloom.plans.oracles import VIEWS
from jobloom.sources import pages
from jobloom.streaming import ingest

_TIMES = ("2026-03-01 00:00:00", "2026-03-02 00:00:00")


def _ingested(s, d) -> DataFrame:
    """A run over every second posting and one over all; every posting is of a company of its own, so it is new once and listed later."""
    p = fixtures.postings(s, d)
    own = p.withColumn("company", F.concat(F.lit("Co"), F.col("ordinal").cast("string")))
    rows = schemas.conform(own.select(*schemas.POSTING.names), schemas.POSTING).withColumn("ordinal", F.regexp_extract("url", r"(\d+)$", 1).cast("long"))
    state, rows = ingest.State(s, folders.folder(s, "ingested"), buckets=16), ingest.numbered(rows, folders.folder(s, "postings"))
    for k, now in enumerate(_TIMES):
        batch, at = rows.filter(F.col("ordinal") % 2 <= k), folders.folder(s, "run")
        only = state.touched(batch)
        state.commit(ingest.run_batch(state.tables(), batch, now, at, state.tables(only)), f"query#{k}", only)
        folders.drop(s, at)
    tables = state.tables()
    seen = tables["seen_jobs"].select("url", "first_seen_at")
    return tables["job_details"].select("url", "company", "fetched_at", "last_listed_at").join(seen, "url", "full")


def _scored_runs(s, d) -> DataFrame:
    """Scored postings in two runs, the second of which is repeated under its name."""
    at = folders.folder(s, "scored")
    rows = fixtures.postings(s, d).join(fixtures.scores(s, d), "url").select("ordinal", "url", "company", "title", "location", "match_score", "recommendation", F.array("source", F.lit('x "y", z')).alias("tags"))
    for run, part in (("one", 0), ("two", 1), ("two", 0)):
        store.scored_csv(rows.filter(F.col("ordinal") % 2 == part), at, ["url", "match_score", "absent", "title"], run)
    back = s.read.option("header", True).option("multiLine", True).option("escape", '"').csv(at)
    return back.select("run", *(F.col(c) for c in back.columns if c != "run"), F.lit(",".join(c for c in back.columns if c != "run")).alias("columns"))


#: Guest pages and what they say: title, company, location, posted, text, criteria, error; {t} is the posting's title, {n} its number.
PAGES = [
    ('<h1 class="x topcard__title">{t}</h1><h2 class="topcard__title">Other</h2><a class="topcard__org-name-link">Acme <b>{n}</b></a><span class="topcard__flavor topcard__flavor--bullet"> London,\n UK </span><span class="topcard__flavor--bullet">53 applicants</span><span class="posted-time-ago__text">3 days ago</span>'
     '<div class="show-more-less-html__markup--clamp">no</div><div class="show-more-less-html__markup x"><p>One</p><div>in</div><ul><li> a</li><li>b &amp; c</li></ul></div><div>out</div>',
     "{t}", "Acme {n}", "London, UK", "3 days ago", "One\n\nin\n\n- a\n\n- b & c", None, None),
    ("<h1 class='topcard__title'> </h1><p class='topcard__title'>{t}</p><div class='show-more-less-html__markup'>Text {n}<script>var a = 1;</script><button>More</button></div>"
     '<h3 class="description__job-criteria-subheader">Seniority level</h3><span class="description__job-criteria-text">Any</span><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">Full-time and Temporary</span>',
     "{t}", None, None, None, "Text {n}More", "Full-time and Temporary", None),
    ('<section><h1 class="topcard__title">{t}<br>x</h1><i> y</i></section><div class="show-more-less-html__markup">t<br/>u<hr>v</div><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">Contractor / Permanent</span>',
     "{t}x y", None, None, None, "t\nuv", "Contractor / Permanent", None),
    ('<h1 class="topcard__title">{t}</h1><p>no advert', None, None, None, None, None, None, "no advert in the page"), ('<div class="show-more-less-html__markup"><p> </p></div>', None, None, None, None, None, None, "empty advert"),
    ('<div class="show-more-less-html__markup">{t}', None, None, None, None, None, None, "no advert in the page"), (" ", None, None, None, None, None, None, "empty page"),
]
#: Pages and their text.
HTML = [
    ("<html><head><title>{t}</title></head><style>p {}</style><body><h1>A</h1><p>x &lt;  y</p><ul><li>\n one<li>two</ul></body></html>", "A\n\nx <  y\n\n- one\n- two"),
    ("a<br>b<br/>c<noscript>no</noscript><svg><text>no</text></svg> d<!-- no --> {n}", "a\nb\nc d {n}"), ("<header>h</header><footer>{t}</footer><blockquote>q</blockquote><template><p>no</p></template>z", "h{t}\nq\nz"),
    ("<table><tr><td>1</td><td>2</td></tr></table>&#65;&#x42;&unknown; <", "1\n\n2\n\nAB&unknown; <"), ("  plain \n\n\n\n {t}  ", "plain\n\n{t}"), ("", ""),
]


def _guests(s, d) -> DataFrame:
    from jobloom.plans.shapes import _template

    rows = fixtures.postings(s, d).select(F.col("url").alias("posting"), pages.job_page_udf(_template("x", [x[0] for x in PAGES])).alias("p"))
    return rows.select("posting", "p.*", text.criteria_employment(F.col("p.criteria")).alias("employment_type"))


def _html(s, d) -> DataFrame:
    from jobloom.plans.shapes import _template

    return fixtures.postings(s, d).select("url", pages.html_text_udf(_template("x", [x for x, _ in HTML])).alias("text"))


def _shapes_sql() -> dict[str, str]:
    from jobloom.plans.shapes import _wanted

    names = (*pages.ANCHORS.values(), "description", "criteria", "error")
    return {
        "guest_shapes": VIEWS + f" SELECT url AS posting, {', '.join(f'{_wanted([x[k] for x in PAGES])} AS {f}' for k, f in enumerate(names, 1))}, CASE ordinal % {len(PAGES)} WHEN 1 THEN 'contract' END AS employment_type FROM postings",
        "html_shapes": VIEWS + f" SELECT url, {_wanted([y for _, y in HTML])} AS text FROM postings",
    }


QUERIES = {"ingested": _ingested, "scored_runs": _scored_runs, "guest_shapes": _guests, "html_shapes": _html}
SQL = {
    "ingested": VIEWS + f""" SELECT url, 'Co' || ordinal AS company, ['{"', '".join(_TIMES)}'][ordinal % 2 + 1] AS fetched_at, CASE WHEN ordinal % 2 = 0 THEN '{_TIMES[1]}' END AS last_listed_at, ['{"', '".join(_TIMES)}'][ordinal % 2 + 1] AS first_seen_at FROM postings""",
    "scored_runs": VIEWS + """ SELECT CASE WHEN ordinal % 2 = 0 THEN 'one' ELSE 'two' END AS run, url, match_score::VARCHAR AS match_score, title, company, location, ordinal::VARCHAR AS ordinal, recommendation, '["' || source || '","x \\"y\\", z"]' AS tags,
        'url,match_score,title,company,location,ordinal,recommendation,tags' AS columns FROM postings JOIN scores USING (url)""",
} | _shapes_sql()
