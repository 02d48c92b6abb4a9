"""Near-duplicate postings: links to the original, audit clusters, and the status of a cluster.

Rows are compared only within an exact key (company, title words). Within a key
all rows of one place behave alike, so both operators first reduce a key to its
distinct places; a key that a third of all rows share costs partial aggregates,
not pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import folders
from jobloom.functions import text


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with ckey (company and title words; null where either is empty), place and at (fetched_at, url)."""
    rows = text.staged(rows, __company=text.company_key(F.col("company")), __tokens=text.title_tokens(F.col("title")))
    company, tokens = F.col("__company"), F.col("__tokens")
    key = F.when((company != "") & (F.size(tokens) > 0), F.struct(company.alias("company"), tokens.alias("title")))
    at = F.struct(F.coalesce("fetched_at", F.lit("")).alias("t"), F.coalesce("url", F.lit("")).alias("url"))
    return rows.withColumns({"ckey": key, "place": text.place(F.col("location")), "at": at}).drop("__company", "__tokens")


def _places(store: DataFrame) -> DataFrame:
    """For each key and place: its earliest row."""
    return store.filter("ckey is not null").groupBy("ckey", "place").agg(F.min("at").alias("first"))


def originals(batch: DataFrame, store: DataFrame) -> DataFrame:
    """url, original: the earliest stored row in a compatible place, not newer than the row and not itself.

    The candidate may be a duplicate in turn. A row without fetched_at is newer
    than the whole store.
    """
    return _originals(keyed(batch), keyed(store))


def originals_within(rows: DataFrame, batch: Column, at: str) -> DataFrame:
    """``originals`` of the rows for which ``batch`` holds, among all rows.

    Rows are keyed once and written below the shared folder ``at``. What has a key
    of its own is like no other row, so places meet only within keys whose hash
    occurs twice.
    """
    k = keyed(rows).filter("ckey is not null").select("url", "fetched_at", "ckey", "place", "at", F.xxhash64("ckey").alias("h"), batch.alias("own"))
    k = folders.written(k, f"{at}/keyed")
    twice = folders.written(k.groupBy("h").count().filter("count > 1").select("h"), f"{at}/twice")
    met = folders.beside(k.join(folders.beside(twice), "h", "left_semi"), k.count())
    return _originals(met.filter("own"), met)


def _originals(batch: DataFrame, store: DataFrame) -> DataFrame:
    """``originals`` of keyed rows."""
    rows = batch.filter("ckey is not null").select("url", "fetched_at", "ckey", "place", "at")
    # Answered for each place of a key, not for each row: the two earliest rows in compatible places, of which one is not the row itself.
    own = rows.select("ckey", F.col("place").alias("own")).distinct()
    met = own.join(_places(store), "ckey").filter(text.places_compatible(F.col("place"), F.col("own")))
    two = met.groupBy("ckey", F.col("own").alias("place")).agg(F.slice(F.array_sort(F.collect_set("first")), 1, 2).alias("two"))
    unstored = F.coalesce(F.col("fetched_at"), F.lit("")) == ""
    ok = F.filter("two", lambda x: (x["url"] != F.col("url")) & (unstored | (x <= F.col("at"))))
    return rows.join(two, ["ckey", "place"]).select("url", F.get(ok, F.lit(0))["url"].alias("original"), F.get(ok, F.lit(0)).alias("m")).filter("original is not null").groupBy("url").agg(F.min("m").alias("m")).select("url", F.col("m.url").alias("original"))


def clusters(rows: DataFrame) -> DataFrame:
    """root, url of audit clusters with two rows or more, the root included.

    Rows, oldest first, join the first cluster whose root's place is compatible,
    else they start one. The fold runs over a key's distinct places in order of
    first appearance and keeps the roots only; a place then goes to the first
    root that fits it, and all rows of a place go with it.
    """
    k = keyed(rows).filter("ckey is not null")
    kind = "array<struct<place:struct<cities:array<string>,vague:boolean,norm:string>,url:string>>"
    per_key = _places(k).groupBy("ckey").agg(F.array_sort(F.collect_list(F.struct("first", "place"))).alias("places"))
    fits = lambda roots, place: F.exists(roots, lambda c: text.places_compatible(c["place"], place))
    root = lambda x: F.array(F.struct(x["place"].alias("place"), x["first"]["url"].alias("url")))
    folded = F.aggregate("places", F.array().cast(kind), lambda a, x: F.when(fits(a, x["place"]), a).otherwise(F.concat(a, root(x)).cast(kind)))
    per_key = text.staged(per_key, roots=folded)
    first = lambda place: F.get(F.filter("roots", lambda c: text.places_compatible(c["place"], place)), F.lit(0))["url"]
    each = F.transform("places", lambda x: F.struct(x["place"].alias("place"), first(x["place"]).alias("root")))
    roots = per_key.select("ckey", F.explode(each).alias("c")).select("ckey", "c.place", "c.root")
    placed = k.join(roots, ["ckey", "place"]).select("root", "url")
    return placed.join(placed.groupBy("root").count().filter("count > 1").select("root"), "root").select("root", "url")


def roots(details: DataFrame) -> DataFrame:
    """url, root: the row that a posting's duplicate_of points at, or itself."""
    return details.select("url", F.coalesce("duplicate_of", "url").alias("root"), "fetched_at")


def decision_sources(details: DataFrame, statuses: DataFrame) -> DataFrame:
    """root, source, my_status: of each cluster the earliest member that carries a status."""
    own = statuses.filter(F.coalesce("my_status", F.lit("")) != "").select("url", "my_status")
    at = F.struct(F.coalesce("fetched_at", F.lit("")), "url", "my_status")
    first = roots(details).join(own, "url").groupBy("root").agg(F.min(at).alias("m"))
    return first.select("root", F.col("m.url").alias("source"), F.col("m.my_status").alias("my_status"))


def inheritances(details: DataFrame, statuses: DataFrame, urls: DataFrame | None = None, size: int = 0) -> DataFrame:
    """url, my_status, inherited_from: rows without any status whose cluster carries a decision. ``size``: how many these may be, if that is known."""
    rows = roots(details)
    if urls is not None:
        rows = rows.join(urls.select("url").distinct(), "url", "left_semi")
    has_own = statuses.filter(F.coalesce("my_status", F.lit("")) != "").select("url")
    return rows.join(has_own, "url", "left_anti").join(folders.beside(decision_sources(details, statuses), size), "root").select("url", "my_status", F.col("source").alias("inherited_from"))


def audit(details: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What applying the clusters would change: links (url, duplicate_of) that differ, and inheritances after them."""
    found = clusters(details).filter("url <> root").select("url", F.col("root").alias("__root"))
    linked = details.drop("duplicate_of").join(found, "url", "left").withColumnRenamed("__root", "duplicate_of")
    changed = details.select("url", F.col("duplicate_of").alias("__old")).join(found, "url").filter(~F.col("__old").eqNullSafe(F.col("__root")))
    return changed.select("url", F.col("__root").alias("duplicate_of")), inheritances(linked, statuses)
