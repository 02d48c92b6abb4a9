"""Drafted CVs corrected against the master they were drafted from: what was left out comes back, what was reworded or reordered stays.

A draft is one row with nested arrays, as is a master; they meet by owner, and
everything within a draft is folds over its arrays. A draft's own order is kept:
each item that comes back goes behind the last one that the master has before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import staged

BULLETS = "array<struct<ref:string,text:string>>"
ROLES = f"array<struct<ref:string,achievements:{BULLETS}>>"


def _rank(order: Column, ref: Column) -> Column:
    """Place in the master from 1; null of what it does not have."""
    return F.nullif(F.array_position(order, ref), F.lit(0).cast("long"))


def _restored(kept: Column, order: Column, missing: Column, made, kind: str) -> Column:
    """``kept`` (structs with ``ref``) with ``made(ref)`` of each missing ref, in the master's order, behind the last item that the master has before it."""

    def put(merged: Column, ref: Column) -> Column:
        before = F.transform(merged, lambda x, i: F.when(_rank(order, x["ref"]) < _rank(order, ref), i + 1))
        at = F.coalesce(F.array_max(before), F.lit(0))
        return F.concat(F.slice(merged, F.lit(1), at), F.array(made(ref)), F.slice(merged, at + 1, F.size(merged))).cast(kind)

    return F.aggregate(missing, kept.cast(kind), put)


def merge_experience(drafts: DataFrame, masters: DataFrame) -> DataFrame:
    """``drafts`` with every role and achievement of their master, and the column ``notes``: what came back.

    drafts: doc, owner, experience (array of ref and achievements, these an array of
    ref and text); masters: owner, roles (array of id, company and achievements, an
    array of ids), one row each. A role without ``achievements`` (null) has all of
    them and stays so; an empty list is filled; a role that the draft lacks comes
    back without achievements, which means all of them. Refs that the master does
    not have stay where they are. A draft without roles, or without a master, stays
    as it is, with no notes.
    """
    met = drafts.join(masters.select("owner", F.col("roles").alias("__roles")), "owner", "left")
    ids = F.transform("__roles", lambda r: r["id"])

    def role(sel: Column) -> Column:
        """The role with its achievements, and those that came back."""
        own = F.get(F.filter("__roles", lambda r: r["id"] == sel["ref"]), F.lit(0))
        order = F.filter(own["achievements"], lambda a: a.isNotNull())
        missing = F.array_except(order, F.transform(sel["achievements"], lambda a: a["ref"]))
        bullet = lambda ref: F.struct(ref.alias("ref"), F.lit(None).cast("string").alias("text"))
        filled = F.when(F.size(missing) > 0, _restored(sel["achievements"], order, missing, bullet, BULLETS)).otherwise(sel["achievements"])
        note = F.when(F.size(missing) > 0, F.concat(F.array_join(missing, ", "), F.lit(" (re-added to "), own["company"], F.lit(")")))
        return F.struct(sel["ref"].alias("ref"), filled.cast(BULLETS).alias("achievements"), note.alias("note"))

    some = (F.size("experience") > 0) & (F.size("__roles") > 0)
    met = met.withColumn("__own", F.when(some, F.transform("experience", role)))
    met = met.withColumn("__dropped", F.array_except(ids, F.transform("experience", lambda x: x["ref"])))
    bare = F.transform("__own", lambda x: F.struct(x["ref"].alias("ref"), x["achievements"].alias("achievements")))
    empty = lambda ref: F.struct(ref.alias("ref"), F.lit(None).cast(BULLETS).alias("achievements"))
    merged = F.when(some, _restored(bare, ids, F.col("__dropped"), empty, ROLES)).otherwise(F.col("experience").cast(ROLES))
    company = lambda ref: F.get(F.filter("__roles", lambda r: r["id"] == ref), F.lit(0))["company"]
    back = F.transform("__dropped", lambda ref: F.concat(company(ref), F.lit(" (role re-added, with every achievement)")))
    notes = F.when(some, F.concat(F.filter(F.transform("__own", lambda x: x["note"]), lambda x: x.isNotNull()), back)).otherwise(F.array().cast("array<string>"))
    return met.withColumns({"experience": merged, "notes": notes}).select(*drafts.columns, "notes")


def merge_groups(drafts: DataFrame, masters: DataFrame, groups: list[str], items: dict[str, list[str]]) -> DataFrame:
    """``drafts`` with the required skill groups and items, and the column ``notes``.

    drafts: doc, owner, skills (array of group and items); masters: owner, groups
    (the same). A required group that the draft lacks comes back with the master's
    items, and groups are then in the master's order, unknown ones last; required
    items of a group that the draft has are put behind its own. A draft without
    groups has all of the master's and stays as it is.
    """
    kind = "array<struct<group:string,items:array<string>>>"
    met = drafts.join(masters.select("owner", F.col("groups").alias("__groups")), "owner", "left")
    required = F.create_map(*(x for k, v in items.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if items else F.create_map().cast("map<string,array<string>>")
    lacking = lambda g: F.array_except(F.element_at(required, g["group"]), F.coalesce(g["items"], F.array().cast("array<string>")))
    # Nothing is enforced where the master has none of the required groups.
    wanted = F.filter("__groups", lambda g: g["group"].isin(groups))
    some = (F.size("skills") > 0) & (F.size(wanted) > 0)
    met = met.withColumn("__more", F.flatten(F.transform("skills", lambda g: F.coalesce(lacking(g), F.array().cast("array<string>")))))
    own = F.transform("skills", lambda g: F.struct(g["group"].alias("group"), F.when(F.size(lacking(g)) > 0, F.concat(F.coalesce(g["items"], F.array().cast("array<string>")), lacking(g))).otherwise(g["items"]).alias("items")))
    met = staged(met, __gone=F.filter(wanted, lambda w: ~F.exists("skills", lambda g: g["group"] == w["group"])))
    gone = F.col("__gone")
    names = F.transform("__groups", lambda g: g["group"])
    every = F.concat(own.cast(kind), gone.cast(kind))
    ordered = F.transform(F.array_sort(F.transform(every, lambda g, i: F.struct(F.coalesce(_rank(names, g["group"]), F.lit(2**31)).alias("k"), i.alias("i"), g.alias("g")))), lambda x: x["g"])
    merged = F.when(some & (F.size(gone) > 0), ordered).when(some, own).otherwise(F.col("skills")).cast(kind)
    first = F.when(F.size("__more") > 0, F.array(F.concat(F.array_join("__more", ", "), F.lit(" (re-added to their group)")))).otherwise(F.array().cast("array<string>"))
    notes = F.when(some, F.concat(first, F.transform(gone, lambda g: g["group"]))).otherwise(F.array().cast("array<string>"))
    return met.withColumns({"skills": merged, "notes": notes}).select(*drafts.columns, "notes")
