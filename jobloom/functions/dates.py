"""Posting dates in their shapes, ages and windows. ``now`` is always passed in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = {"7": 7, "30": 30, "90": 90, "180": 180}
_AGO = r"(?i)^\s*(?:about\s+|around\s+|circa\s+|over\s+)?(\d+)\s*(minute|hour|day|week|month|year)s?\s*(?:ago|old)?\s*$"


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_CLOCK = r"(?:[\s,]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?)?\s*(?:(?:Z|UTC|GMT)?([+-]\d{2}:?\d{2})|(Z|UTC|GMT))?$"
_WORD = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Written dates: a pattern, and which groups hold year, month and day.
_WRITTEN = (
    (rf"(?i)^(?:[a-z]+[.,:]?\s+)*(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_WORD}[\s,-]+(\d{{4}})", (3, 2, 1)),
    (rf"(?i)^(?:[a-z]+[.,:]?\s+)*?{_WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?[\s,]+(\d{{4}})", (3, 1, 2)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
)


def _written(t: Column) -> Column:
    """Timestamp of dates such as '16 Sep 2026', 'Sep 16, 2026', 'Wed, 16 Sep 2026 04:04:36 GMT', '9/16/2026'; days beyond a month's last run on."""
    found = []
    for head, places in _WRITTEN:
        p = head + _CLOCK
        g = lambda k, p=p: F.regexp_extract(t, p, k)
        n = lambda k, g=g: g(k).try_cast("int")
        year, month, day = places
        number = ((F.instr(F.lit(_MONTHS), F.substring(F.lower(g(month)), 1, 3)) + 2) / 3).cast("int") if "jan|feb" in head else n(month)
        valid = t.rlike(p) & number.between(1, 12) & n(day).between(1, 31)
        date = F.date_add(F.make_date(F.when(valid, n(year)), F.when(valid, number), F.lit(1)), n(day) - 1)
        hour = F.when(F.lower(g(7)) == "pm", n(4) % 12 + 12).when(F.lower(g(7)) == "am", n(4) % 12).otherwise(n(4))
        clock = F.format_string("%02d:%02d:%02d", F.coalesce(hour, F.lit(0)), F.coalesce(n(5), F.lit(0)), F.coalesce(n(6), F.lit(0)))
        zone = F.when(g(8) != "", F.regexp_replace(g(8), r"^(...):?(..)$", "$1:$2")).when(g(9) != "", "Z").otherwise("")
        found.append(F.concat(date.cast("string"), F.lit("T"), clock, zone).try_cast("timestamp"))
    return F.coalesce(*found)


def parse_posted_at(c: Column, now: Column) -> Column:
    """Timestamp of epoch seconds or milliseconds, ISO forms, written dates, 'yesterday', 'N weeks ago'; null for anything else.

    Months and years are calendar ones whose overflow runs on (31 March less a month is 3 March).
    """
    t = F.trim(c.cast("string"))
    digits = F.when(t.rlike(r"^\d{10,13}$"), F.try_to_number(t, F.lit("9999999999999")).cast("long"))
    epoch = F.timestamp_millis(F.when(digits > 100_000_000_000, digits).otherwise(digits * 1000))
    back = lambda n: F.date_sub(now.cast("date"), n)
    midday = lambda d: (d.cast("timestamp").cast("long") + (now.cast("long") - now.cast("date").cast("timestamp").cast("long"))).cast("timestamp")
    word = F.when(t.rlike(r"(?i)^(just\s+now|today|new)$"), 0).when(t.rlike("(?i)^yesterday$") | t.rlike(r"(?i)^(a|an|one)\s+day\s+ago$"), 1).when(t.rlike(r"(?i)^(a|an|one)\s+week\s+ago$"), 7).when(t.rlike(r"(?i)^(a|an|one)\s+month\s+ago$"), 30)
    n = F.when(t.rlike(_AGO), F.regexp_extract(t, _AGO, 1)).try_cast("int")
    unit = F.lower(F.regexp_extract(t, _AGO, 2))
    seconds = F.when(unit == "minute", n * 60).when(unit == "hour", n * 3600)
    months = F.when(unit == "month", n).when(unit == "year", n * 12)
    first = F.add_months(F.trunc(now, "month"), -months)
    relative = F.coalesce(
        (now.cast("long") - seconds).cast("timestamp"),
        midday(back(F.when(unit == "day", n).when(unit == "week", n * 7))),
        midday(F.date_add(first, F.dayofmonth(now) - 1)),
    )
    iso = F.when(t.rlike(r"^\d{4}-\d{2}(?:-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?$"), t.try_cast("timestamp"))
    return F.coalesce(epoch, midday(back(word)), relative, iso, _written(t))


def age_days(posted: Column, now: Column) -> Column:
    """Whole days between local midnights; null where there is no date."""
    return F.datediff(now.cast("date"), posted.cast("date"))


def age_label(days: Column) -> Column:
    weeks, months, years = (F.round(days / n).cast("int").cast("string") for n in (7, 30, 365))
    return (
        F.when(days.isNull(), "no date").when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).when(days < 14, "1 week ago")
        .when(days < 45, F.concat(weeks, F.lit(" weeks ago"))).when(days < 365, F.concat(months, F.lit(" months ago"))).otherwise(F.concat(years, F.lit("y ago")))
    )


def exact_label(raw: Column, posted: Column, days: Column) -> Column:
    dated = F.concat(F.date_format(posted, "EEE d MMM yyyy"), F.lit(" ("), days.cast("string"), F.when(days == 1, " day ago)").otherwise(" days ago)"))
    return F.coalesce(dated, F.when(F.length(raw) > 0, F.concat(F.lit('Unreadable date: "'), F.substring(raw, 1, 40), F.lit('"'))), F.lit("No posting date given"))


def age_class(days: Column) -> Column:
    return F.when(days.isNull(), "undated").when(days <= 7, "fresh").when(days <= 30, "recent").when(days <= 45, "ageing").otherwise("old")


def within_window(days: Column, window: str) -> Column:
    """True for undated rows and for any window that is not known."""
    n = WINDOWS.get(window)
    return F.lit(True) if n is None else days.isNull() | (days <= n)


def listed_recently(listed: Column, now: Column, window: str) -> Column:
    """Whether the last sighting lies inside the window; keeps an old posting on the board."""
    n = WINDOWS.get(window)
    return F.lit(n is None) if n is None else F.coalesce(age_days(listed.try_cast("timestamp"), now) <= n, F.lit(False))


def month_label(c: Column) -> Column:
    """'2021-03' as 'Mar 2021'; 'present' as 'Present'; others unchanged."""
    return F.when(F.lower(c) == "present", "Present").when(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.date_format(F.concat(c, F.lit("-01")).try_cast("date"), "MMM yyyy")).otherwise(c)


def application_date(c: Column) -> Column:
    """A date in one of five notations, or null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy")))
