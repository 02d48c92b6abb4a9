"""Small inputs of the driver: registries, rule files, CV texts with their age, board addresses."""

from __future__ import annotations

import csv
import datetime
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours after which a cached CV text is stale.
TTL_HOURS = 24.0


def load_yaml(path: str):
    """A YAML file; the library is asked for only here."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Boards: name, ats, slug, search, params (a map)."""
    out = [(r["name"], r.get("ats") or r.get("type"), r.get("slug"), r.get("search"), {str(k): str(v) for k, v in (r.get("params") or {}).items()}) for r in rows]
    return spark.createDataFrame(out, "name string, ats string, slug string, search string, params map<string,string>")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        with open(path, newline="", encoding="utf-8") as f:
            return registry(spark, list(csv.DictReader(f)))
    return registry(spark, load_yaml(path))


def cv_text(spark: SparkSession, text: str, fetched_at: str, now: str, kind: str = "file", ttl_hours: float = TTL_HOURS) -> DataFrame:
    """One row: text, kind, fetched_at, age_hours, stale, chars."""
    age = (datetime.datetime.fromisoformat(now) - datetime.datetime.fromisoformat(fetched_at)).total_seconds() / 3600
    return spark.createDataFrame([(text, kind, fetched_at, round(age, 2), age > ttl_hours, len(text))], "text string, kind string, fetched_at string, age_hours double, stale boolean, chars int")


def cv_ages(rows: DataFrame, now: Column, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """The rows (text, fetched_at, ...) with age_hours, stale, chars (S15, D8): a time that cannot be read makes a text stale, a null text has no characters."""
    age = F.round((now.cast("timestamp").cast("double") - F.col("fetched_at").try_cast("timestamp").cast("double")) / 3600, 2)
    return rows.withColumns({"age_hours": age, "stale": F.coalesce(age > ttl_hours, F.lit(True)), "chars": F.coalesce(F.length("text"), F.lit(0))})


def workday_endpoint(slug: str) -> tuple[str, str, str]:
    """(base address, tenant, site) of 'tenant/site' or 'tenant/site/region'; anything else is an error."""
    from jobloom.sources.boards import REGION, REGIONS

    m = re.fullmatch(r"/?([\w-]+)/([\w-]+)(?:/(\w+))?/?", slug or "")
    if not m or (m[3] or REGION) not in REGIONS:
        raise ValueError(f"not tenant/site or tenant/site/region: {slug}")
    return f"https://{m[1]}.{m[3] or REGION}.myworkdayjobs.com", m[1], m[2]


def board_requests(rows: DataFrame) -> DataFrame:
    """name, ats, slug, search, params, address, error of a table of boards: the first request of each, or why it has none.

    Reads the columns name, ats, type, slug, search, params (JSON); those that the table
    has not are null. ``ats`` comes before ``type``; a broken ``params`` is an error.
    """
    from jobloom.sources.boards import ADDRESSES, COUNTRIES, REGION, REGIONS

    c = F.col
    have = rows.select(*(c(k).cast("string").alias(k) if k in rows.columns else F.lit(None).cast("string").alias(k) for k in ("name", "ats", "type", "slug", "search", "params")))
    said = lambda k: F.nullif(F.trim(k), F.lit(""))
    have = have.select("name", F.coalesce(said("ats"), said("type")).alias("ats"), said("slug").alias("slug"), said("search").alias("search"), F.from_json(F.coalesce(said("params"), F.lit("{}")), "map<string,string>").alias("params"))
    day = r"^/?([\w-]+)/([\w-]+)(?:/(\w+))?/?$"
    bit = lambda k: F.regexp_extract(F.coalesce("slug", F.lit("")), day, k)
    region = F.when(bit(3) == "", REGION).otherwise(bit(3))
    asked = F.lower(F.trim(F.coalesce(F.try_element_at("params", F.lit("country")), F.lit("ca"))))
    country = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair)), asked), asked)
    known = F.create_map(*(F.lit(x) for k, (v, _) in ADDRESSES.items() for x in (k, v)))
    plain = F.replace(F.replace(F.try_element_at(known, "ats"), F.lit("{slug}"), c("slug")), F.lit("{at}"), F.lit("0"))
    by_day = F.concat(F.lit("https://"), bit(1), F.lit("."), region, F.lit(".myworkdayjobs.com/wday/cxs/"), bit(1), F.lit("/"), bit(2), F.lit("/jobs"))
    by_ad = F.concat(F.lit("https://api.adzuna.com/v1/api/jobs/"), country, F.lit("/search/1"))
    error = F.when(c("params").isNull(), "params are no JSON object").when(c("ats").isNull(), "no board kind")
    error = error.when((c("ats") == "workday") & ~((bit(1) != "") & region.isin(*REGIONS)), "not tenant/site or tenant/site/region")
    error = error.when((c("ats") == "adzuna") & ~country.rlike("^[a-z]{2}$"), "not a country code of two letters")
    error = error.when(~c("ats").isin("workday", "adzuna", *ADDRESSES), "unknown board kind").when((c("ats") != "adzuna") & c("slug").isNull(), "no slug")
    address = F.when(c("ats") == "workday", by_day).when(c("ats") == "adzuna", by_ad).otherwise(plain)
    return have.select("*", F.when(error.isNull(), address).alias("address"), error.alias("error"))


def names_agree(company: Column, page: Column) -> Column:
    """strong, weak or none: whether a board's page names the company: all identifying words side by side, or each of them somewhere."""
    from jobloom.functions.text import company_key, plain_words

    key, own = company_key(company), F.concat(F.lit(" "), plain_words(page), F.lit(" "))
    every = F.forall(F.split(key, " "), lambda w: own.contains(F.concat(F.lit(" "), w, F.lit(" "))))
    return F.when(key == "", "none").when(own.contains(F.concat(F.lit(" "), key, F.lit(" "))), "strong").when(every, "weak").otherwise("none")


# Words that follow a company's name, and names that are everyday words.
SUFFIXES = frozenset("ltd limited plc llc inc group holdings uk the and co company".split())
EVERYDAY = frozenset("next wise just monday now one group data people first home open".split())


def name_evidence(company: Column, words: Column) -> Column:
    """strong, weak or none: a posting's ``words`` (see ``plain_words``) name the company by two neighbouring words of it or all of them run together; by one of its longer words; not at all."""
    from jobloom.functions.text import plain_words

    bare = F.regexp_replace(F.lower(F.coalesce(company, F.lit(""))), r"(?<=[a-z0-9])\.(?=[a-z0-9])", "")
    own = F.filter(F.split(plain_words(bare), " "), lambda w: (F.length(w) >= 3) & ~w.isin([*SUFFIXES]))
    line = F.concat(F.lit(" "), words, F.lit(" "))
    near = lambda x: line.contains(F.concat(F.lit(" "), x, F.lit(" ")))
    pairs = F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(own, i + 1)))
    strong = (F.size(own) >= 2) & (F.exists(pairs, near) | F.replace(words, F.lit(" "), F.lit("")).contains(F.array_join(own, "")))
    return F.when(strong, "strong").when(F.exists(F.filter(own, lambda w: F.length(w) >= 4), near), "weak").otherwise("none")


def verify_boards(jobs: DataFrame) -> DataFrame:
    """board, company, total, uk, london, gate, strong_hits, weak_hits, identity_ok of probed boards' jobs (board, company, title, location, description), most promising first.

    A board is the company's if one job names it strongly, or two weakly by a word that is not an everyday one.
    """
    from jobloom.functions.text import plain_words
    from jobloom.operators.screen import location_is_allowed, title_is_relevant

    c = F.col
    seen = name_evidence(c("company"), plain_words(F.concat_ws(" ", "title", "description")))
    uk = location_is_allowed(c("location"))
    rows = jobs.select("board", "company", seen.alias("e"), uk.alias("uk"), F.lower(F.coalesce("location", F.lit(""))).rlike(r"\blondon\b").alias("london"), (title_is_relevant(c("title")) & uk).alias("gate"))
    own = F.filter(F.split(plain_words(c("company")), " "), lambda w: (F.length(w) >= 4) & ~w.isin([*SUFFIXES]) & ~w.isin([*EVERYDAY]))
    per = rows.groupBy("board", "company").agg(F.count("*").alias("total"), *(F.count_if(k).alias(k) for k in ("uk", "london", "gate")), F.count_if(c("e") == "strong").alias("strong_hits"), F.count_if(c("e") == "weak").alias("weak_hits"))
    ok = (c("strong_hits") >= 1) | ((c("weak_hits") >= 2) & (F.size(own) > 0))
    return per.withColumn("identity_ok", ok).orderBy(F.desc("gate"), F.desc("uk"), F.desc("identity_ok"), "board")
