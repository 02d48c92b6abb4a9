"""Job boards: their JSON as postings, in Column expressions over raw responses, and a data source that fetches them.

A fetch yields rows (company, ats, slug, body, error): one response a row. The
parsers below need no network, so stored responses are read in the same way.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from jobloom import schemas
from jobloom.functions.text import redact

RAW = "company string, ats string, slug string, body string, error string"


def _first(*paths: str) -> Column:
    """The first path that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(p).cast("string"), F.lit("")) for p in paths))


def _jobs(raw: DataFrame, ats: str, schema: str, path: str) -> DataFrame:
    """One row a job: the fields of the array at ``path`` beside company and source."""
    body = F.from_json("body", f"struct<{schema}>" if path else f"array<struct<{schema}>>")
    rows = raw.filter((F.col("ats") == ats) & F.col("error").isNull()).withColumn("b", body)
    return rows.select("company", "ats", "slug", F.explode(F.col(f"b.{path}") if path else F.col("b")).alias("j"))


def _postings(rows: DataFrame, **columns: Column) -> DataFrame:
    have = {"company": F.col("company"), "source": F.col("ats")} | columns
    return schemas.conform(rows.select(*(c.alias(k) for k, c in have.items())), schemas.POSTING)


def greenhouse(raw: DataFrame) -> DataFrame:
    rows = _jobs(raw, "greenhouse", "jobs:array<struct<title:string,absolute_url:string,location:struct<name:string>,first_published:string,updated_at:string,content:string>>", "jobs")
    return _postings(rows, title=F.col("j.title"), location=F.col("j.location.name"), url=F.col("j.absolute_url"), posted_at=_first("j.first_published", "j.updated_at"), description=F.col("j.content"))


def ashby(raw: DataFrame) -> DataFrame:
    rows = _jobs(raw, "ashby", "jobs:array<struct<title:string,location:string,locationName:string,jobUrl:string,applyUrl:string,publishedAt:string,descriptionPlain:string,descriptionHtml:string>>", "jobs")
    return _postings(rows, title=F.col("j.title"), location=_first("j.location", "j.locationName"), url=_first("j.jobUrl", "j.applyUrl"), posted_at=F.col("j.publishedAt"), description=_first("j.descriptionPlain", "j.descriptionHtml"))


def workable(raw: DataFrame) -> DataFrame:
    """Places come as a list of places (hidden ones are left out), one place, or city and country; remote ones are wrapped."""
    place = "struct<city:string,region:string,country:string,hidden:boolean>"
    rows = _jobs(raw, "workable", f"jobs:array<struct<title:string,url:string,shortlink:string,published_on:string,created_at:string,description:string,telecommuting:boolean,city:string,state:string,country:string,location:{place},locations:array<{place}>>>", "jobs")
    joined = lambda *parts: F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))), ", ")
    shown = F.filter("j.locations", lambda p: ~F.coalesce(p["hidden"], F.lit(False)))
    many = F.array_join(F.array_distinct(F.transform(shown, lambda p: joined(p["city"], p["region"], p["country"]))), "; ")
    one = joined(F.col("j.location.city"), F.col("j.location.region"), F.col("j.location.country"))
    own = joined(F.col("j.city"), F.col("j.state"), F.col("j.country"))
    where = F.coalesce(F.nullif(many, F.lit("")), F.nullif(one, F.lit("")), F.nullif(own, F.lit("")))
    remote = F.coalesce(F.col("j.telecommuting"), F.lit(False))
    location = F.when(remote & where.isNotNull(), F.concat(F.lit("Remote ("), where, F.lit(")"))).when(remote, "Remote").otherwise(where)
    return _postings(rows, title=F.col("j.title"), location=location, url=_first("j.url", "j.shortlink"), posted_at=_first("j.published_on", "j.created_at"), description=F.col("j.description"))


def lever(raw: DataFrame) -> DataFrame:
    rows = _jobs(raw, "lever", "text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,description:string,categories:struct<location:string,allLocations:array<string>>", "")
    every = F.nullif(F.array_join("j.categories.allLocations", ", "), F.lit(""))
    return _postings(rows, title=F.col("j.text"), location=F.coalesce(every, "j.categories.location"), url=F.col("j.hostedUrl"), posted_at=F.col("j.createdAt").cast("string"), description=_first("j.descriptionPlain", "j.description"))


def smartrecruiters(raw: DataFrame) -> DataFrame:
    """Rows without any address are left out."""
    rows = _jobs(raw, "smartrecruiters", "content:array<struct<id:string,name:string,ref:string,postingUrl:string,applyUrl:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean>>>", "content")
    place = F.concat_ws(", ", F.nullif("j.location.city", F.lit("")), F.nullif("j.location.region", F.lit("")), F.upper(F.nullif("j.location.country", F.lit(""))))
    made = F.when(F.col("j.id").isNotNull(), F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), "j.id"))
    url = F.coalesce(_first("j.postingUrl", "j.applyUrl"), made, _first("j.ref"))
    return _postings(rows, title=F.col("j.name"), location=place, url=url, posted_at=F.col("j.releasedDate"), description=F.lit("")).filter("url is not null and url <> ''")


def by_url(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by url to ``parts`` tasks, as many as their number needs; by default as the session has it."""
    return rows if parts is None else rows.repartition(parts, "url")


def workday(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows without a path are left out, paths that a board lists twice count once; ``slug`` is tenant/site, or tenant/site/region."""
    rows = _jobs(raw, "workday", "jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "jobPostings")
    part = F.split("slug", "/")
    url = F.concat(F.lit("https://"), part[0], F.lit("."), F.coalesce(F.get(part, F.lit(2)), F.lit(REGION)), F.lit(".myworkdayjobs.com/en-US/"), part[1], F.col("j.externalPath"))
    rows = rows.filter(F.coalesce("j.externalPath", F.lit("")) != "")
    return by_url(_postings(rows, title=F.col("j.title"), location=F.col("j.locationsText"), url=url, posted_at=F.col("j.postedOn"), description=F.lit("")), parts).dropDuplicates(["url"])


def adzuna(raw: DataFrame) -> DataFrame:
    """Contracts with a yearly salary get day rates, marked as derived or estimated."""
    from jobloom.functions.rates import annual_to_day

    rows = _jobs(raw, "adzuna", "results:array<struct<title:string,redirect_url:string,created:string,description:string,contract_type:string,salary_min:double,salary_max:double,salary_is_predicted:string,company:struct<display_name:string>,location:struct<display_name:string>>>", "results")
    stated = F.lower(F.trim(F.coalesce("j.contract_type", F.lit(""))))
    kind = F.when(stated.isin("contract", "permanent"), stated).otherwise("unknown")
    day = F.when(kind == "contract", annual_to_day(F.col("j.salary_min"), F.col("j.salary_max"), F.coalesce(F.col("j.salary_is_predicted") == "1", F.lit(False))))
    return _postings(rows, company=F.coalesce("j.company.display_name", F.lit("Unknown")), title=F.col("j.title"), location=F.col("j.location.display_name"), url=F.col("j.redirect_url"), posted_at=F.col("j.created"), description=F.col("j.description"), employment_type=kind, day_rate_min=day["min"], day_rate_max=day["max"], day_rate_source=day["source"])


def remotive(raw: DataFrame) -> DataFrame:
    rows = _jobs(raw, "remotive", "jobs:array<struct<title:string,url:string,company_name:string,publication_date:string,description:string,job_type:string,candidate_required_location:string>>", "jobs")
    kind = F.when(F.col("j.job_type").isin("contract", "freelance"), "contract").when(F.col("j.job_type") == "full_time", "permanent").otherwise("unknown")
    return _postings(rows, company=F.col("j.company_name"), title=F.col("j.title"), location=F.concat(F.lit("Remote ("), F.coalesce(F.nullif("j.candidate_required_location", F.lit("")), F.lit("Anywhere")), F.lit(")")), url=F.col("j.url"), posted_at=F.col("j.publication_date"), description=F.col("j.description"), employment_type=kind)


#: Parsers by board kind.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": greenhouse, "ashby": ashby, "workable": workable, "lever": lever, "smartrecruiters": smartrecruiters, "workday": workday, "adzuna": adzuna, "remotive": remotive}


def parse(raw: DataFrame, kinds: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Postings of all responses, whatever their board (S7, S11); an unknown kind is an error. ``parts``: tasks for what meets by url."""
    unknown = [k for k in kinds or [] if k not in PARSERS]
    if unknown:
        raise ValueError(f"unknown board kinds: {', '.join(unknown)}")
    out = None
    for k in kinds or PARSERS:
        rows = workday(raw, parts) if k == "workday" else PARSERS[k](raw)
        out = rows if out is None else out.unionByName(rows)
    return out


def longer_text(postings: DataFrame, full: DataFrame) -> DataFrame:
    """Descriptions replaced by fetched full texts (url, full_text) where these are longer."""
    met = postings.join(full.select("url", "full_text"), "url", "left")
    return met.withColumn("description", F.when(F.length("full_text") > F.length(F.coalesce("description", F.lit(""))), F.col("full_text")).otherwise(F.col("description"))).drop("full_text")


# Details -------------------------------------------------------------------------------------


def detail_requests(postings: DataFrame, parts: int | None = None) -> DataFrame:
    """url, ats, address: the detail page of each posting whose list entry has no text and whose title (and, where the list has places, location) is wanted."""
    from jobloom.operators.screen import location_is_allowed, title_is_relevant

    smart = F.regexp_extract("url", r"smartrecruiters\.com/(?:v1/companies/)?([^/]+)/(?:postings/)?([^/?]+)", 1)
    number = F.regexp_extract("url", r"smartrecruiters\.com/(?:v1/companies/)?([^/]+)/(?:postings/)?([^/?]+)", 2)
    day = r"https://([\w-]+)(\.\w+\.myworkdayjobs\.com)/en-US/([^/]+)(/.*)$"
    bit = lambda k: F.regexp_extract("url", day, k)
    address = F.when((F.col("source") == "smartrecruiters") & (smart != "") & location_is_allowed(F.col("location")), F.concat(F.lit("https://api.smartrecruiters.com/v1/companies/"), smart, F.lit("/postings/"), number))
    address = address.when((F.col("source") == "workday") & F.col("url").rlike(day), F.concat(F.lit("https://"), bit(1), bit(2), F.lit("/wday/cxs/"), bit(1), F.lit("/"), bit(3), bit(4)))
    wanted = postings.filter((F.coalesce("description", F.lit("")) == "") & title_is_relevant(F.col("title")))
    return by_url(wanted.select("url", F.col("source").alias("ats"), address.alias("address")).filter("address is not null"), parts).dropDuplicates(["url"])


def with_details(postings: DataFrame, details: DataFrame, parts: int | None = None) -> DataFrame:
    """Postings with the text and places of their detail pages (url, body). A page that failed or has nothing changes nothing."""
    part = "struct<text:string>"
    smart = F.from_json("body", f"jobAd struct<sections:struct<jobDescription:{part},qualifications:{part},additionalInformation:{part}>>")["jobAd"]["sections"]
    day = F.from_json("body", "jobPostingInfo struct<jobDescription:string,qualifications:string,additionalInformation:string,location:string,additionalLocations:array<string>>")["jobPostingInfo"]
    whole = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x.isNotNull() & (x != "")), "\n\n")
    names = ("jobDescription", "qualifications", "additionalInformation")
    text = F.coalesce(F.nullif(whole(*(smart[k]["text"] for k in names)), F.lit("")), F.nullif(whole(*(day[k] for k in names)), F.lit("")))
    places = F.filter(F.transform(F.concat(F.array(day["location"]), F.coalesce(day["additionalLocations"], F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    first = F.filter(places, lambda x, i: (i == 0) | ~F.exists(F.slice(F.transform(places, F.lower), 1, F.greatest(i, F.lit(1))), lambda y: y == F.lower(x)))
    found = details.select("url", text.alias("__text"), F.nullif(F.array_join(first, ", "), F.lit("")).alias("__where"))
    met = by_url(postings, parts).join(found, "url", "left")
    return met.withColumns({"description": F.coalesce("__text", "description"), "location": F.coalesce("__where", "location")}).select(postings.columns)


def api_requests(landed: DataFrame) -> DataFrame:
    """``landed`` (url, final_url, page) with ats, slug and the address of the job's own entry, where a redirect ended at a board that gives one."""
    green, lever = r"(?:job-boards|boards)\.greenhouse\.io/([^/]+)/jobs/(\d+)", r"jobs\.lever\.co/([^/]+)/([0-9a-f-]{36})"
    of = lambda p, k: F.regexp_extract("final_url", p, k)
    is_green, is_lever = F.coalesce(F.col("final_url").rlike(green), F.lit(False)), F.coalesce(F.col("final_url").rlike(lever), F.lit(False))
    address = F.when(is_green, F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), of(green, 1), F.lit("/jobs/"), of(green, 2), F.lit("?content=true"))).when(is_lever, F.concat(F.lit("https://api.lever.co/v0/postings/"), of(lever, 1), F.lit("/"), of(lever, 2), F.lit("?mode=json")))
    return landed.withColumns({"ats": F.when(is_green, "greenhouse").when(is_lever, "lever"), "slug": F.when(is_green, of(green, 1)).when(is_lever, of(lever, 1)), "address": address})


def full_descriptions(landed: DataFrame) -> DataFrame:
    """url, full_text, ats, slug from (url, final_url, page, body): the text of a board's own entry; else of the page it landed on, of a listing page only the advert in it (S12). ats and slug only where the entry gave the text."""
    from jobloom.functions import text

    rows = api_requests(landed)
    entry = F.from_json("body", "content string, descriptionPlain string, description string")
    own = F.when(F.col("ats") == "greenhouse", F.nullif(entry["content"], F.lit(""))).when(F.col("ats") == "lever", F.coalesce(F.nullif(entry["descriptionPlain"], F.lit("")), F.nullif(entry["description"], F.lit(""))))
    rows = text.staged(rows, __own=own, __text=text.page_text(F.col("page")))
    rows = text.with_body(rows, "__text")
    page = F.nullif(F.when(F.col("__marker").isNull(), F.col("__text")).otherwise(F.col("__body")), F.lit(""))
    by_api = F.col("__own").isNotNull()
    return rows.select("url", F.coalesce("__own", page).alias("full_text"), F.when(by_api, F.col("ats")).alias("ats"), F.when(by_api, F.col("slug")).alias("slug"))


def with_bodies(requests: DataFrame, get: Callable[[str], str] | None = None) -> DataFrame:
    """url, body, error: each address asked for once, in the executors; a failure is a row."""
    ask = get or http_get

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, errors = [], []
            for address in batch.column("address").to_pylist():
                try:
                    bodies.append(ask(address))
                    errors.append(None)
                except (OSError, ValueError) as e:
                    bodies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], ["url", "body", "error"])

    return requests.select("url", "address").mapInArrow(work, "url string, body string, error string")


def failures(raw: DataFrame) -> DataFrame:
    """company, ats, error of responses that failed, without credentials."""
    return raw.filter("error is not null").select("company", "ats", redact(F.col("error")).alias("error"))


# Fetching ------------------------------------------------------------------------------------

# The boards' public addresses; {slug} is the board, {at} the offset.
ADDRESSES = {
    "greenhouse": ("https://boards-api.greenhouse.io/v1/boards/{slug}/jobs?content=true", 0),
    "ashby": ("https://api.ashbyhq.com/posting-api/job-board/{slug}", 0),
    "workable": ("https://apply.workable.com/api/v1/widget/accounts/{slug}?details=true", 0),
    "lever": ("https://api.lever.co/v0/postings/{slug}?mode=json", 0),
    "smartrecruiters": ("https://api.smartrecruiters.com/v1/companies/{slug}/postings?limit=100&offset={at}", 100),
    "remotive": ("https://remotive.com/api/remote-jobs?search={slug}", 0),
}
PAGED = {"smartrecruiters": "content"}
TIMEOUT, USER_AGENT = 20, "jobloom"
# A tenant's regions, the usual one first; country codes that the aggregator writes otherwise; rows of a page.
REGIONS = ("wd3", "wd1", "wd2", "wd5", "wd10", "wd12", "wd103")
REGION = REGIONS[0]
COUNTRIES = {"uk": "gb", "usa": "us", "united kingdom": "gb", "great britain": "gb"}
DAY_ROWS, AD_ROWS, AD_PAGES = 20, 50, 5


def http_get(url: str, body: dict | None = None) -> str:
    """The response to a GET, or to a POST of ``body`` as JSON."""
    head = {"User-Agent": USER_AGENT, "Accept": "application/json"} | ({"Content-Type": "application/json"} if body is not None else {})
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, head), timeout=TIMEOUT) as r:
        return r.read().decode("utf-8", "replace")


def day_pages(slug: str, search: str, get) -> Iterator[str]:
    """Pages of a Workday board until an empty or short one, or its total."""
    from jobloom.sources.loaders import workday_endpoint

    base, tenant, site = workday_endpoint(slug)
    at = 0
    while True:
        body = get(f"{base}/wday/cxs/{tenant}/{site}/jobs", {"appliedFacets": {}, "limit": DAY_ROWS, "offset": at, "searchText": search})
        found = json.loads(body)
        n, total = len(found.get("jobPostings") or []), found.get("total")
        if n:
            yield body
        at += DAY_ROWS
        if n < DAY_ROWS or (isinstance(total, int) and at >= total):
            return


def ad_pages(params: dict, get) -> Iterator[str]:
    """Pages of an aggregator's search, at most ``max_pages``, until a short one. The credentials are in the environment."""
    own = {k: v for k, v in params.items() if k not in ("max_pages", "country")}
    country = str(params.get("country", "ca")).strip().lower()
    country = COUNTRIES.get(country, country)
    if not re.fullmatch("[a-z]{2}", country):
        raise ValueError(f"not a country code of two letters: {country}")
    keys = {k: os.environ.get(f"ADZUNA_{k.upper()}") for k in ("app_id", "app_key")}
    if not all(keys.values()):
        raise ValueError("ADZUNA_APP_ID and ADZUNA_APP_KEY are not set")
    for page in range(1, int(params.get("max_pages", AD_PAGES)) + 1):
        query = urllib.parse.urlencode(keys | {"content-type": "application/json"} | own)
        body = get(f"https://api.adzuna.com/v1/api/jobs/{country}/search/{page}?{query}")
        n = len(json.loads(body).get("results") or [])
        if n:
            yield body
        if n < int(own.get("results_per_page", AD_ROWS)):
            return


def fetch_board(company: str, ats: str, slug: str, get: Callable = http_get, search: str = "", params: dict | None = None) -> Iterator[tuple]:
    """Raw rows of one board, page after page until a short one; a failure is a row, not an exception, and shows no credentials."""
    try:
        if ats in ("workday", "adzuna"):
            for body in day_pages(slug, search, get) if ats == "workday" else ad_pages(params or {}, get):
                yield company, ats, slug, body, None
            return
        address, step = ADDRESSES[ats]
        at = 0
        while True:
            body = get(address.format(slug=slug, at=at))
            yield company, ats, slug, body, None
            if not step or len(json.loads(body).get(PAGED[ats]) or []) < step:
                return
            at += step
    except KeyError:
        yield company, ats, slug, None, f"unknown board kind {ats}"
    except (OSError, ValueError, urllib.error.URLError) as e:
        yield company, ats, slug, None, re.sub(r"((?:app_id|app_key|api_key|key|token)=)[^&\s\"']+", r"\1***", f"{type(e).__name__}: {e}")


class BoardPartition(InputPartition):
    def __init__(self, board: dict | None, poll: int | None = None):
        super().__init__(0)
        self.board, self.poll = board, poll


def board_key(board: dict) -> str:
    return f"{board['ats']}-{board.get('slug') or board['name']}"


def asked(board: dict, days: str | None) -> Iterator[tuple]:
    """Raw rows of one board now; ``days`` is the age up to which an aggregator is asked for adverts."""
    params = dict(board.get("params") or {})
    if days is not None and board["ats"] == "adzuna":
        params.setdefault("max_days_old", days)
    return fetch_board(board["name"], board["ats"], board.get("slug"), http_get, board.get("search") or "", params)


def stored_response(board: dict, path: str) -> tuple:
    try:
        with open(path, encoding="utf-8") as f:
            return board["name"], board["ats"], board.get("slug"), f.read(), None
    except OSError as e:
        return board["name"], board["ats"], board.get("slug"), None, f"{type(e).__name__}"


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.boards = json.loads(options.get("boards", "[]"))
        self.files, self.days = options.get("files"), options.get("max_days_old")

    def partitions(self):
        return [BoardPartition(b) for b in self.boards] or [BoardPartition(None)]

    def read(self, partition):
        b = partition.board
        if b and self.files:  # stored responses: a folder of <ats>-<slug>.json
            yield stored_response(b, f"{self.files}/{board_key(b)}.json")
        elif b:
            yield from asked(b, self.days)


class BoardStream(DataSourceStreamReader):
    """Boards polled again and again: the offset of a stream holds, for each board, how many of its polls are behind it.

    A poll is asked for when its batch runs, one partition a board, and a failure
    is a row of it. A batch that runs again after a failure must give the same
    rows, so responses are kept below ``landing`` (a shared folder) from when they
    came until their batch is committed. Polls are due every ``every`` seconds;
    those that nobody asked for in time cannot be had, and the last one stands for
    them. With ``files``, a folder of stored polls <ats>-<slug>.<number>.json, each
    of these is read once, in order.
    """

    def __init__(self, options: dict):
        self.boards = {board_key(b): b for b in json.loads(options.get("boards", "[]"))}
        self.files, self.days, self.landing = options.get("files"), options.get("max_days_old"), options.get("landing")
        self.every = float(options.get("every", 3600))
        if not self.files and not self.landing:
            raise ValueError("a stream of boards needs the option landing: a shared folder in which responses stay until they are committed")

    def _due(self, key: str) -> int:
        if not self.files:
            return int(time.time() // self.every) + 1
        n = 0
        while os.path.exists(f"{self.files}/{key}.{n}.json"):
            n += 1
        return n

    def initialOffset(self) -> dict:
        return {key: 0 if self.files else self._due(key) - 1 for key in self.boards}

    def latestOffset(self) -> dict:
        return {key: self._due(key) for key in self.boards}

    def partitions(self, start: dict, end: dict) -> list:
        out = []
        for key, upto in end.items():
            # A board that the stream did not have before begins with its first stored poll, or now.
            since = start.get(key, 0 if self.files else upto - 1)
            polls = range(since, upto) if self.files else range(max(since, upto - 1), upto)
            out += [BoardPartition(self.boards[key], n) for n in polls if key in self.boards]
        return out

    def _landed(self, key: str, poll: int):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.landing)
        return store, f"{folder}/{key}.{poll}.json"

    def read(self, partition):
        b, poll = partition.board, partition.poll
        key = board_key(b)
        if self.files:
            yield stored_response(b, f"{self.files}/{key}.{poll}.json")
            return
        store, path = self._landed(key, poll)
        if not store.get_file_info(path).is_file:
            rows = list(asked(b, self.days))
            store.create_dir(os.path.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(json.dumps(rows).encode())
            store.move(part, path)
        with store.open_input_stream(path) as f:
            yield from map(tuple, json.loads(f.read()))

    def commit(self, end: dict) -> None:
        """Landed responses behind the offset go."""
        if self.files:
            return
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.landing)
        for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            key, _, rest = info.base_name.rpartition(".json")[0].rpartition(".")
            if rest.isdigit() and int(rest) < end.get(key, 0):
                store.delete_file(info.path)


class BoardSource(DataSource):
    """spark.read.format("jobboards").option("boards", json).load(): one partition a board, failures kept apart; spark.readStream polls them."""

    @classmethod
    def name(cls):
        return "jobboards"

    def schema(self):
        return RAW

    def reader(self, schema):
        return BoardReader(self.options)

    def streamReader(self, schema):
        return BoardStream(self.options)
