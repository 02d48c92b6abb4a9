"""Screens of postings: title, place, language, clearance and rate, as columns and as one enriched frame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import config, folders
from jobloom.functions import rates, text
from jobloom.functions.matching import find_all, has, names_that_match


def _any(words: list[str]) -> str:
    return "(" + "|".join(re.escape(w) for w in words) + ")"


def title_is_relevant(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return has(t, _any(config.PRIORITY_TITLES)) | (has(t, _any(config.ALLOWED_TITLES)) & ~has(t, _any(config.EXCLUDED_TITLES)))


def location_is_allowed(location: Column) -> Column:
    t, out = F.coalesce(location, F.lit("")), F.lit(False)
    for p in config.LOCATIONS:
        out |= has(t, p)
    return out


def _some(t: Column, patterns: dict[str, str]) -> Column:
    return has(t, "(?:" + "|".join(patterns.values()) + ")")


def stack_mismatch(description: Column) -> Column:
    """A dealbreaker language and no language of one's own in the raw description."""
    t = text.strip_html(description)
    return _some(t, config.STACK_DEALBREAKERS) & ~_some(t, config.STACK_PRIORITY | config.STACK_SECONDARY)


def with_advert(df: DataFrame) -> DataFrame:
    """The columns __own (the advert's own text without tags) and __flat (in one line)."""
    df = text.with_body(df, "description")
    own = F.when(F.col("__marker").isNull(), F.coalesce("description", F.lit(""))).otherwise(F.coalesce("__body", F.lit("")))
    own = F.trim(F.concat_ws(" ", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")), own))
    df = text.staged(df, __own=text.strip_html(own))
    return text.staged(df, __flat=text.flat(F.col("__own"))).drop("__marker", "__body")


def with_language(df: DataFrame) -> DataFrame:
    """language_tier, language_rank, language_hits from __own."""
    t = F.col("__own")
    df = text.staged(df, __l1=names_that_match(t, config.STACK_PRIORITY), __l2=names_that_match(t, config.STACK_SECONDARY), __l3=names_that_match(t, config.STACK_DEALBREAKERS))
    tier = F.when(F.size("__l1") > 0, "priority").when(F.size("__l2") > 0, "secondary").when(F.size("__l3") > 0, "mismatch").otherwise("none")
    df = df.withColumn("language_tier", tier).withColumn("language_rank", F.coalesce(*(F.when(F.col("language_tier") == k, v) for k, v in config.LANGUAGE_TIERS.items())))
    return df.withColumn("language_hits", F.nullif(F.array_join(F.concat("__l1", "__l2", "__l3"), ", "), F.lit(""))).drop("__l1", "__l2", "__l3")


def with_clearance(df: DataFrame) -> DataFrame:
    """clearance_status and clearance_evidence from __flat: blocked where clearance must be held already, possible where it is only mentioned or can be obtained."""
    flat = F.col("__flat")
    downgrade = "(?:" + "|".join(config.CLEARANCE_DOWNGRADE.values()) + ")"

    def clause(m: Column) -> Column:
        lead = F.element_at(F.split(F.substring(flat, F.greatest(m["start"] - 110, F.lit(0)) + 1, F.least(m["start"], F.lit(110))), "[.;\n]", -1), -1)
        tail = F.split(F.substring(flat, m["start"] + F.length(m["match"]) + 1, F.lit(70)), "[.;\n]", 2)[0]
        return F.concat(lead, F.lit(" "), tail)

    def of(name: str, pattern: str) -> Column:
        return F.transform(find_all(flat, pattern), lambda m: F.struct(F.lit(name).alias("n"), F.trim(m["match"]).alias("m"), has(clause(m), downgrade).alias("soft")))

    empty = F.array().cast("array<struct<n:string,m:string,soft:boolean>>")
    df = text.staged(df, __mentioned=_some(flat, config.CLEARANCE_MENTION))
    found = F.concat(*(of(n, p) for n, p in config.CLEARANCE_BLOCKED.items()))
    df = text.staged(df, __found=F.when(F.col("__mentioned"), found).otherwise(empty), __down=F.when(F.col("__mentioned"), F.array_join(F.slice(names_that_match(flat, config.CLEARANCE_DOWNGRADE), 1, 3), ", ")))
    hard, soft = F.get(F.filter("__found", lambda x: ~x["soft"]), F.lit(0)), F.get(F.filter("__found", lambda x: x["soft"]), F.lit(0))
    down = F.col("__down")
    quoted = lambda x, n: F.concat(F.lit("“"), F.substring(x["m"], 1, n), F.lit("”"))
    evidence = F.coalesce(
        F.concat(hard["n"], F.lit(": "), quoted(hard, 70)),
        F.concat(soft["n"], F.lit(" ("), down, F.lit("): "), quoted(soft, 60)),
        F.concat(F.lit("clearance mentioned, nothing required of you"), F.when(down != "", F.concat(F.lit(" ("), down, F.lit(")"))).otherwise("")),
    )
    status = F.when(~F.col("__mentioned"), "none").when(hard.isNotNull(), "blocked").otherwise("possible")
    return df.withColumns({"clearance_status": status, "clearance_evidence": F.when(F.col("__mentioned"), evidence)}).drop("__mentioned", "__found", "__down")


def clearance_reject_reason(status: Column, evidence: Column) -> Column:
    if not config.REJECT_BLOCKED:
        return F.lit(None).cast("string")
    return F.when(status == "blocked", F.concat(F.lit("requires clearance you do not hold — "), F.coalesce(evidence, F.lit("clearance required"))))


def _with_stated(df: DataFrame) -> DataFrame:
    """__ir and __day: status and day rate that __own states."""
    df = text.staged(df, __line=rates.one_line(F.col("__own")))
    df = text.staged(df, __phrases=rates.ir35_phrases(F.col("__line")), __figures=rates.rate_figures(F.col("__line")))
    return text.staged(df, __ir=rates.ir35_verdict(F.col("__phrases")), __day=rates.best_rate(F.col("__figures"))).drop("__line", "__phrases", "__figures")


def with_contract(df: DataFrame, model: rates.RateModel) -> DataFrame:
    """The ten contract columns from __own; a stated rate comes before a given one, which must be plausible."""
    return _with_rates(_with_stated(df), model)


def _with_rates(df: DataFrame, model: rates.RateModel) -> DataFrame:
    return _contract_columns(_judged(_with_rate(df), model))


def _with_rate(df: DataFrame) -> DataFrame:
    """__rate: the stated or given day rate."""
    for c, kind in (("employment_type", "string"), ("day_rate_min", "double"), ("day_rate_max", "double"), ("day_rate_source", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    top = F.coalesce("day_rate_max", "day_rate_min")
    given = F.when(rates.plausible(top), F.struct(F.when(rates.plausible(F.col("day_rate_min")), F.col("day_rate_min")).alias("min"), top.alias("max"), F.col("day_rate_source").alias("source")))
    stated = F.when(F.col("__day").isNotNull(), F.struct(F.col("__day.min").alias("min"), F.col("__day.max").alias("max"), F.lit("stated").alias("source")))
    return text.staged(df, __rate=F.coalesce(stated, given))


def _judged(df: DataFrame, model: rates.RateModel) -> DataFrame:
    """__verdict and __worth of __rate and the status in __ir."""
    df = text.staged(df, __verdict=rates.classify_rate(F.col("__rate.min"), F.col("__rate.max"), F.col("__ir.status"), model))
    best = F.coalesce(F.nullif(F.col("__rate.max"), F.lit(0.0)), F.nullif(F.col("__rate.min"), F.lit(0.0)))
    return rates.with_perm_equivalent(df, best, F.col("__verdict.assumed"), "__worth", model)


def _contract_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "employment_type": F.coalesce(F.nullif("employment_type", F.lit("")), F.lit("unknown")),
        "ir35_status": F.col("__ir.status"), "ir35_evidence": F.col("__ir.evidence"),
        "day_rate_min": F.col("__rate.min"), "day_rate_max": F.col("__rate.max"), "day_rate_source": F.col("__rate.source"),
        "rate_verdict": F.col("__verdict.verdict"), "rate_required": F.col("__verdict.required"), "perm_equivalent": F.col("__worth"), "rate_reason": F.col("__verdict.reason"),
    }).drop("__ir", "__day", "__rate", "__verdict", "__worth")


#: Characters of title and description up to which a text counts as one that repeats.
SHORT = 1000


def _with_text(df: DataFrame) -> DataFrame:
    """What title and description alone tell: __ir, __day, the language and the clearance columns."""
    return with_clearance(with_language(_with_stated(with_advert(df)))).drop("__own", "__flat")


def _contract_text(df: DataFrame) -> DataFrame:
    """Of ``_with_text`` what the contract columns need: __ir and __day."""
    return _with_stated(with_advert(df)).drop("__own", "__flat")


def _once(df: DataFrame, read: Callable[[DataFrame], DataFrame], model: rates.RateModel, at: str | None = None) -> DataFrame:
    """``read`` and the rates. Short texts are read once for each different title and description; longer texts, which seldom repeat, where they stand.

    With a folder ``at`` rates of short texts, too, are judged once for each different one.
    """
    c = F.col
    short = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("description", F.lit(""))) <= SHORT
    found = read(df.filter(short).select("title", "description").distinct()).withColumnsRenamed({"title": "__t", "description": "__d"})
    # Written, it has a size before the join is planned: where it is small, the postings are not shuffled.
    found = folders.beside(folders.written(found, f"{at}/texts")) if at else found
    near = df.filter(short).join(found, c("title").eqNullSafe(c("__t")) & c("description").eqNullSafe(c("__d"))).drop("__t", "__d")
    if not at:
        return _with_rates(near.unionByName(read(df.filter(~short))), model)
    near, same = _with_rate(near), {"__rate.min": "__low", "__rate.max": "__high", "__ir.status": "__status"}
    each = near.select(*(c(k).alias(v) for k, v in same.items())).distinct()
    each = each.withColumns({"__rate": F.struct(c("__low").alias("min"), c("__high").alias("max")), "__ir": F.struct(c("__status").alias("status"))})
    each = folders.beside(folders.written(_judged(each, model).select(*same.values(), "__verdict", "__worth"), f"{at}/rates"))
    alike = F.lit(True)
    for k, v in same.items():
        alike &= c(k).eqNullSafe(c(v))
    return _contract_columns(near.join(each, alike).drop(*same.values())).unionByName(_with_rates(read(df.filter(~short)), model))


def enrich(postings: DataFrame, model: rates.RateModel | None = None, once: bool = False, at: str | None = None) -> DataFrame:
    """Postings with the ten contract and five screening columns. ``once``: short texts are read once each, for which the postings are gone through three times. With a shared folder ``at``, what they tell is written below it, and rates are judged once each as well (five times)."""
    model = model or rates.RateModel()
    return _once(postings, _with_text, model, at) if once else _with_rates(_with_text(postings), model)


def contracts(postings: DataFrame, model: rates.RateModel | None = None, at: str | None = None) -> DataFrame:
    """Postings with the ten contract columns alone; texts are read as by ``enrich(once=True)``."""
    return _once(postings, _contract_text, model or rates.RateModel(), at)


def rate_reject(model: rates.RateModel | None = None) -> Column:
    c = F.col
    return rates.reject_reason(c("employment_type"), c("rate_verdict"), c("day_rate_source"), c("day_rate_min"), c("day_rate_max"), c("rate_required"), model)


def content_checks() -> dict[str, Column]:
    """Of an enriched frame: each content screen as a Boolean."""
    return {"title": title_is_relevant(F.col("title")), "location": location_is_allowed(F.col("location")), "language": ~stack_mismatch(F.col("description")), "clearance": clearance_reject_reason(F.col("clearance_status"), F.col("clearance_evidence")).isNull()}


def passes_content_filters() -> Column:
    out = F.lit(True)
    for x in content_checks().values():
        out &= x
    return out


def passes_filters(model: rates.RateModel | None = None) -> Column:
    return passes_content_filters() & rate_reject(model).isNull()


def rejection_reason(model: rates.RateModel | None = None) -> Column:
    """The first cause, in the order title, location, language, clearance, rate; null for a posting that passes."""
    ok = content_checks()
    return F.coalesce(
        F.when(~ok["title"], "title not in the QA/testing allowlist"),
        F.when(~ok["location"], "location not in the London/UK allowlist"),
        F.when(~ok["language"], F.concat(F.lit("language mismatch — names "), F.coalesce("language_hits", F.lit("None")), F.lit(" only"))),
        clearance_reject_reason(F.col("clearance_status"), F.col("clearance_evidence")),
        rate_reject(model),
    )


def failing_reasons(model: rates.RateModel | None = None) -> Column:
    """All failing screens of an enriched row; informational."""
    bad = {k: ~v for k, v in content_checks().items()} | {"rate": rate_reject(model).isNotNull()}
    return F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in bad.items())))


def would_show_but_for_clearance(model: rates.RateModel | None = None) -> Column:
    ok = content_checks()
    return ok["title"] & ok["location"] & ok["language"] & ~ok["clearance"] & rate_reject(model).isNull()
