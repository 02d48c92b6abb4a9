"""Registered queries of redirects and full texts: the answers of hosts are a table made from the posting views, followed as the network would be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.plans import fixtures
from jobloom.plans.oracles import _PLACE, _TITLE, SQL as ORACLES, VIEWS
from jobloom.sources import redirects

_LEVER = "00000000-0000-0000-0000-"


def _answers(postings: DataFrame) -> DataFrame:
    """Seven ways that an aggregator's adverts end: a board's own entry at once, or behind two more hops; an entry that is gone; the advert itself; a refusal; a loop; a page that says less."""
    c = F.col
    n = c("ordinal").cast("string")
    said = lambda word: F.expr(f"repeat(title || ' {word} ', 30)")
    green, gone = F.concat(F.lit("https://boards.greenhouse.io/acme"), (c("ordinal") % 50).cast("string"), F.lit("/jobs/"), n), F.concat(F.lit("https://job-boards.greenhouse.io/cee/jobs/"), n)
    track, lever = F.concat(F.lit("https://track.example.com/"), n), F.concat(F.lit(f"https://jobs.lever.co/bee/{_LEVER}"), F.lpad(n, 12, "0"))
    api = F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/acme"), (c("ordinal") % 50).cast("string"), F.lit("/jobs/"), n, F.lit("?content=true"))
    api_gone = F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/cee/jobs/"), n, F.lit("?content=true"))
    api_lever = F.concat(F.lit(f"https://api.lever.co/v0/postings/bee/{_LEVER}"), F.lpad(n, 12, "0"), F.lit("?mode=json"))
    again = F.concat("url", F.lit("/again"))
    page = F.concat(F.lit("<script>var x;</script><p>"), said("page"), F.lit("</p>"))

    def of(way, address, status, location=None, body=None):
        none = F.lit(None).cast("string")
        error = F.lit(None if status < 400 else f"status {status}").cast("string")
        return F.when(c("way") == way, F.struct(address.alias("address"), F.lit(status).alias("status"), (none if location is None else location).alias("location"), (none if body is None else body).alias("body"), error.alias("error")))

    each = [
        of(0, c("url"), 302, green), of(0, green, 200, body=F.lit("shell")), of(0, api, 200, body=F.to_json(F.struct(said("own").alias("content")))),
        of(1, c("url"), 301, track), of(1, track, 308, lever), of(1, lever, 200, body=F.lit("shell")), of(1, api_lever, 200, body=F.to_json(F.struct(F.lit("").alias("descriptionPlain"), said("lever").alias("description")))),
        of(2, c("url"), 303, gone), of(2, gone, 200, body=page), of(2, api_gone, 404), of(3, c("url"), 200, body=page), of(4, c("url"), 403),
        of(5, c("url"), 302, again), of(5, again, 307, c("url")), of(6, c("url"), 200, body=F.lit("<b>x</b>")),
    ]
    adverts = postings.filter("source = 'adzuna'").withColumn("way", F.floor(c("ordinal") / 4) % 7)
    return adverts.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("a")).select("a.*")


def _full(s, d) -> tuple[DataFrame, DataFrame]:
    p = fixtures.postings(s, d).filter("source = 'adzuna'")
    return redirects.with_full_texts(p, redirects.stored_hops(_answers(p)), most=4)


def _landed(s, d) -> DataFrame:
    p = fixtures.postings(s, d)
    asked = p.select("url", F.when(F.col("ordinal") % 10 > 0, F.col("url")).alias("address"))
    return redirects.landed(asked, redirects.stored_hops(_answers(p)), most=4).withColumn("page", F.md5("page"))


QUERIES = {
    "landed": _landed,
    "full_texts": lambda s, d: _full(s, d)[0].select("url", F.md5("description").alias("description")),
    "discovered_boards": lambda s, d: _full(s, d)[1],
}
_WAYS = VIEWS + f""", cut AS ({ORACLES['truncated']}), ways AS (SELECT p.*, ordinal // 4 % 7 AS way, {_TITLE} AND {_PLACE} AND truncated AS asked FROM postings p JOIN cut USING (url) WHERE source = 'adzuna'),
    fulls AS (SELECT *, CASE WHEN asked THEN CASE way WHEN 0 THEN repeat(title || ' own ', 30) WHEN 1 THEN repeat(title || ' lever ', 30) WHEN 2 THEN trim(repeat(title || ' page ', 30)) WHEN 3 THEN trim(repeat(title || ' page ', 30)) WHEN 6 THEN 'x' END END AS f FROM ways)"""
SQL = {
    "landed": VIEWS + f""", w AS (SELECT *, CASE WHEN source = 'adzuna' THEN ordinal // 4 % 7 ELSE 9 END AS way, '<script>var x;</script><p>' || repeat(title || ' page ', 30) || '</p>' AS html FROM postings)
        SELECT url, CASE WHEN ordinal % 10 = 0 THEN NULL WHEN way = 0 THEN 'https://boards.greenhouse.io/acme' || ordinal % 50 || '/jobs/' || ordinal WHEN way = 1 THEN 'https://jobs.lever.co/bee/{_LEVER}' || lpad(ordinal::VARCHAR, 12, '0') WHEN way = 2 THEN 'https://job-boards.greenhouse.io/cee/jobs/' || ordinal WHEN way = 5 THEN url || '/again' ELSE url END AS final_url,
        CASE WHEN ordinal % 10 > 0 THEN md5(CASE WHEN way < 2 THEN 'shell' WHEN way < 4 THEN html WHEN way = 6 THEN '<b>x</b>' END) END AS page,
        CASE WHEN ordinal % 10 = 0 THEN 'no address' WHEN way = 4 THEN 'status 403' WHEN way = 5 THEN 'more than 4 redirects' WHEN way = 9 THEN 'no stored answer' END AS error FROM w""",
    "full_texts": _WAYS + " SELECT url, md5(CASE WHEN length(f) > length(description) THEN f ELSE description END) AS description FROM fulls",
    "discovered_boards": _WAYS + " SELECT DISTINCT company AS name, CASE way WHEN 0 THEN 'greenhouse' ELSE 'lever' END AS ats, CASE way WHEN 0 THEN 'acme' || ordinal % 50 ELSE 'bee' END AS slug FROM ways WHERE asked AND way < 2",
}
