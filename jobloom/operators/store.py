"""Mutations of the stored tables as functions from old rows and changes to new rows; a snapshot is rewritten by the caller.

Each of them meets the old table once on its key. Where a change set repeats a
key, its last row by ``ordinal`` (if it has that column) is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom import schemas
from jobloom.sources import sinks


def _one(delta: DataFrame, key: str = "url") -> DataFrame:
    """One row a key: the last by ordinal."""
    if "ordinal" not in delta.columns:
        return delta.dropDuplicates([key])
    cols = [c for c in delta.columns if c not in (key, "ordinal")]
    return delta.groupBy(key).agg(F.max_by(F.struct(*cols), "ordinal").alias("s")).select(key, "s.*")


def replace(old: DataFrame, new: DataFrame, key: str = "url", unique: bool = False) -> DataFrame:
    """Whole rows replaced by key (M2, M7); columns that ``new`` lacks become null. ``unique``: no key occurs twice in ``new``."""
    new = new if unique else _one(new, key)
    missing = [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in new.columns]
    return old.join(new.select(key), key, "left_anti").unionByName(new.select("*", *missing).select(old.columns))


def insert_new(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not there yet are added (M1)."""
    return old.unionByName(_one(new, key).join(old.select(key), key, "left_anti").select(old.columns))


def update(old: DataFrame, delta: DataFrame, columns: list[str], key: str = "url", when: Column | None = None) -> DataFrame:
    """Named columns of rows with a match in ``delta`` are set (M3, M5, M6), where ``when`` (over old and new__ columns) holds."""
    d = _one(delta, key).select(key, F.lit(True).alias("__hit"), *(F.col(c).alias(f"new__{c}") for c in columns))
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(True) if when is None else when)
    met = old.join(d, key, "left")
    return met.select(*((F.when(hit, F.col(f"new__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in old.columns))


def upsert(old: DataFrame, delta: DataFrame, allowed: list[str], key: str = "url") -> DataFrame:
    """Partial upsert (M12): passed columns are set, others kept; an unknown column is an error."""
    passed = [c for c in delta.columns if c not in (key, "ordinal")]
    unknown = [c for c in passed if c not in allowed]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    fresh = _one(delta, key).join(old.select(key), key, "left_anti")
    missing = [F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in fresh.columns]
    return update(old, delta, passed, key).unionByName(fresh.select("*", *missing).select(old.columns))


_MONEY = ("day_rate_min", "day_rate_max")
_CONTRACT = ("employment_type", "ir35_status", "day_rate_min", "day_rate_max", "day_rate_source", "rate_verdict")


def refresh_contract(details: DataFrame, delta: DataFrame) -> DataFrame:
    """Re-read contract columns (M4) with a Boolean ``changed``: money differs by 0.01 or more, other columns by value; a known type is never set back to unknown."""
    d = _one(delta).select("url", F.lit(True).alias("__hit"), *(F.col(c).alias(f"new__{c}") for c in schemas.CONTRACT_FIELDS))
    kept_type = F.when((F.col("new__employment_type") == "unknown") & F.col("employment_type").isin("permanent", "contract"), F.col("employment_type")).otherwise(F.col("new__employment_type"))
    met = details.join(d, "url", "left").withColumn("new__employment_type", kept_type)

    def differs(c: str) -> Column:
        a, b = F.col(c), F.col(f"new__{c}")
        return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(F.abs(a - b) >= 0.01) if c in _MONEY else ~a.eqNullSafe(b)

    changed = F.lit(False)
    for c in _CONTRACT:
        changed |= differs(c)
    met = met.withColumn("changed", F.coalesce("__hit", F.lit(False)) & changed)
    return met.select(*((F.when(F.col("changed"), F.col(f"new__{c}")).otherwise(F.col(c)).alias(c) if c in schemas.CONTRACT_FIELDS else F.col(c)) for c in details.columns), "changed")


def mark_listed(details: DataFrame, sighted: DataFrame, now: str) -> DataFrame:
    return update(details, sighted.select("url").distinct().withColumn("last_listed_at", F.lit(now)), ["last_listed_at"])


def save_inherited(statuses: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Inherited statuses (M9): an own status stays, an inherited one is replaced, notes stay."""
    d = found.select("url", "my_status", "inherited_from").withColumn("updated_at", F.lit(now))
    free = F.coalesce(F.col("my_status"), F.lit("")).eqNullSafe("") | F.col("inherited_from").isNotNull()
    out = update(statuses, d, ["my_status", "inherited_from", "updated_at"], when=free)
    fresh = d.join(statuses.select("url"), "url", "left_anti").withColumn("notes", F.lit(None).cast("string"))
    return out.unionByName(fresh.select(statuses.columns))


def propagation(details: DataFrame, decided: DataFrame) -> DataFrame:
    """url, my_status, inherited_from for all other rows of a decided row's cluster (M10); a null status does not spread."""
    rows = details.select("url", F.coalesce("duplicate_of", "url").alias("root"))
    from_ = rows.join(decided.filter("my_status is not null").select("url", "my_status"), "url").select("root", "my_status", F.col("url").alias("inherited_from"))
    return rows.join(from_, "root").filter("url <> inherited_from").groupBy("url").agg(F.min(F.struct("inherited_from", "my_status")).alias("m")).select("url", "m.my_status", "m.inherited_from")


def save_status(statuses: DataFrame, details: DataFrame, decided: DataFrame, now: str, refresh_inherited: bool = True) -> DataFrame:
    """Own decisions (M8): set, no longer inherited, and spread to the cluster. Without ``refresh_inherited`` (M11) rows with any status keep it."""
    d = _one(decided).withColumns({"updated_at": F.lit(now), "inherited_from": F.lit(None).cast("string")})
    if "notes" not in d.columns:
        d = d.withColumn("notes", F.lit(None).cast("string"))
    old_notes = statuses.select("url", F.col("notes").alias("__n"))
    d = d.join(old_notes, "url", "left").withColumn("notes", F.coalesce("notes", "__n")).drop("__n")
    out = replace(statuses, d.select(statuses.columns))
    spread = propagation(details, decided)
    if not refresh_inherited:
        spread = spread.join(out.filter("my_status is not null").select("url"), "url", "left_anti")
    return save_inherited(out, spread, now)


def lessons(events: DataFrame, promote_at: int = 2) -> DataFrame:
    """mode, hits, first_seen, last_seen, active_since, last_evidence from (mode, at, evidence) events (M13); active from the second hit on.

    The filter on the row number limits each task's rows of a mode before they
    are shuffled, so a mode that holds most events is no task's work.
    """
    nth = F.row_number().over(Window.partitionBy("mode").orderBy("at", "evidence"))
    early = events.withColumn("__n", nth).filter(F.col("__n") <= promote_at).filter(F.col("__n") == promote_at).select("mode", F.col("at").alias("active_since"))
    sums = events.groupBy("mode").agg(F.count("*").cast("int").alias("hits"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("evidence", F.struct("at", "evidence")).alias("last_evidence"))
    return sums.join(early, "mode", "left").select("mode", "hits", "first_seen", "last_seen", "active_since", "last_evidence")


def active_lessons(table: DataFrame) -> DataFrame:
    return table.filter("active_since is not null").orderBy(F.desc("hits"), "mode")


def remove(tables: dict[str, DataFrame], urls: DataFrame) -> dict[str, DataFrame]:
    """Rows of given urls leave the four posting tables (M17); other tables are not touched."""
    four = ("seen_jobs", "job_details", "ai_evaluations", "user_status")
    return {k: (v.join(urls.select("url"), "url", "left_anti") if k in four else v) for k, v in tables.items()}


def append_companies(known: DataFrame, found: DataFrame) -> DataFrame:
    """New (ats, slug) boards in order of discovery (M18): the first of equal ones, none that is known."""
    first = found.groupBy("ats", "slug").agg(F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal"))
    return first.join(known.select("ats", "slug"), ["ats", "slug"], "left_anti").orderBy("ordinal").select("name", "ats", "slug")


def requeue_polluted(seen: DataFrame, details: DataFrame) -> DataFrame:
    """seen_jobs without rows whose description is a listing page (M19): they will be fetched again."""
    from jobloom.functions.text import with_marker

    polluted = with_marker(details.select("url", "description"), "description").filter("__marker is not null")
    return seen.join(polluted.select("url"), "url", "left_anti")


def clean_descriptions(details: DataFrame) -> DataFrame:
    """url, description of rows without HTML whose lines can be collapsed."""
    from jobloom.functions.text import collapse_lines

    plain = details.filter(~F.coalesce("description", F.lit("")).rlike("<[a-zA-Z/][^>]*>")).select("url", "description", collapse_lines(F.col("description")).alias("__c"))
    return plain.filter("__c <> description").select("url", F.col("__c").alias("description"))


CANDIDATE_COLUMNS = ["company", "title", "location", "url", "posted_at", "source", "employment_type", "ir35_status", "day_rate_min", "day_rate_max", "rate_verdict", "perm_equivalent"]


def candidate_rows(rows: DataFrame) -> DataFrame:
    """Candidates in fixed columns, money with two decimals."""
    money = ("day_rate_min", "day_rate_max", "perm_equivalent")
    return rows.select(*(F.round(c, 2).alias(c) if c in money else F.col(c) for c in CANDIDATE_COLUMNS))


def candidates_csv(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Add candidates to a CSV table as one run (M14): all of them or none, and once for a run's name."""
    sinks.add_run(candidate_rows(rows), path if ":" in path else f"file://{path}", run)


def scored_columns(columns: list[str], declared: list[str]) -> list[str]:
    """Declared columns in their order, then the others sorted."""
    return [c for c in declared if c in columns] + sorted(c for c in columns if c not in declared)


def scored_csv(rows: DataFrame, path: str, declared: list[str], run: str | None = None) -> None:
    """Add scored postings to a CSV table as one run, in the order of ``scored_columns`` (M15); arrays as texts."""
    flat = [F.to_json(c).alias(c) if dict(rows.dtypes)[c].startswith(("array", "struct", "map")) else F.col(c) for c in scored_columns(rows.columns, declared)]
    sinks.add_run(rows.select(*flat), path if ":" in path else f"file://{path}", run)
