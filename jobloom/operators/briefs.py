"""Postings as texts for a reader: what is to be judged, and what a CV for a posting may claim (C22). The wording is our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import bare, is_cut, staged, with_body

#: Terms that a context names at most.
MOST_TERMS = 40
# What is said of a text that is not the whole advert.
NOTES = {
    "snippet": "Note: the text is a snippet of the advert. What it does not say is unknown, not absent.",
    "excerpt": "Note: the text was taken out of a page that also lists other adverts.",
    "unreadable": "Note: the stored page lists other adverts and this one could not be found in it. Judge by company, title and place.",
}


def with_brief(rows: DataFrame, signals: Column | None = None) -> DataFrame:
    """The columns note (snippet, excerpt, unreadable or null) and brief: company, title, place, address, note, text and ``signals`` of a posting.

    Of a listing page only the advert in it counts, and nothing where there is none;
    an empty text is said to be missing.
    """
    rows = staged(with_body(rows, "description"), __bare=bare(F.col("description")))
    raw, listed = F.coalesce("description", F.lit("")), F.col("__marker").isNotNull()
    note = F.when(listed & F.col("__body").isNotNull(), "excerpt").when(listed, "unreadable").when((raw != "") & is_cut(F.col("__bare")), "snippet")
    rows, note = staged(rows, note=note), F.col("note")
    body = F.when(listed, F.coalesce("__body", F.lit("(no text)"))).otherwise(F.coalesce(F.nullif("__bare", F.lit("")), F.lit("(no text)")))
    said = note
    for k, v in NOTES.items():
        said = F.when(note == k, v).otherwise(said)
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    brief = F.concat_ws("\n", line("Company: ", "company"), line("Title: ", "title"), line("Location: ", "location"), line("Address: ", "url"), said, F.lit(""), body, *([] if signals is None else [F.lit(""), signals]))
    return rows.withColumn("brief", brief).drop("__marker", "__body", "__bare")


def contexts(postings: DataFrame, told: DataFrame, employers: list[str], groups: dict[str, list[str]], most: int = MOST_TERMS) -> DataFrame:
    """url, context: where a candidate has worked, the domains of the fact base, and the priority terms of each posting that it does not have.

    ``told``: terms with in_master (see ``coverage.posting_terms``); heaviest first, ties by term, at most ``most``.
    ``groups``: the fact base's skills by group; those of a group named after domains are the domains.
    """
    is_domain = {g: "domain" in g.lower() for g in groups}
    domains = [x for g, xs in groups.items() if is_domain[g] for x in xs]
    others = [g for g in groups if not is_domain[g]]
    key = F.struct((-F.col("weight")).alias("w"), "term")
    gaps = told.filter(F.col("priority") & ~F.col("in_master")).groupBy("url").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(key)), 1, most), lambda x: x["term"]), ", ").alias("gaps"))
    lines = [F.lit("Employers so far: " + ", ".join(filter(None, employers))), F.concat(F.lit("Never employed by: "), F.coalesce("company", F.lit("(not stated)")))]
    if domains:
        lines.append(F.lit("Domains: " + ", ".join(domains)))
    lines += [F.lit("Skill groups: " + ", ".join(others)), F.concat(F.lit("Not in the fact base: "), "gaps")]
    return postings.select("url", "company").join(gaps, "url", "left").select("url", F.concat_ws("\n", *lines).alias("context"))
