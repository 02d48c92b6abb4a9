"""Fields of pasted adverts, with the line that each came from and whether a label or a guess gave it.

Lines are an array, in which four passes look for the first that fits: labelled
values, the line "Company · Place · age" under a title, the title among the first
lines, and a line that is nothing but a place. All of it is Column expressions,
staged so that each pass is worked out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import text
from jobloom.operators.screen import location_is_allowed

# How labels, page furniture, ages, titles, levels and money are written in adverts.
LABELS = {"company": "company|employer|organisation|organization", "title": "title|role|job title", "location": "location|based in", "posted_at": "posted"}
AGE = r"\b(?:\d+\s*(?:minute|hour|day|week|month)s?\s*ago|just posted|reposted)\b"
NOT_A_FIELD = r"^\s*(?:apply|easy apply|save|saved|report this job|about the job|job description|description|responsibilities|requirements|benefits|show more|see more|set alert|people you can reach out to|meet the hiring team)\b"
FURNITURE = r"^\s*(?:#{1,6}\s*|>|\*\*formatting|formatting note|_+\s*$|-{3,}\s*$|\*\*\*+)"
LONE_WORDS = ["linkedin", "jobs", "applied", "saved", "easy apply"]
DEGREE = r"^\d+(?:st|nd|rd|th)\b"
LABEL_BEFORE = r"^\s*\**\s*[A-Za-z][A-Za-z /&'-]{2,24}\s*:\s+\S"
TITLE_WORDS = r"\b(?:engineer|engineering|developer|development|tester|testing|analyst|analysis|consultant|architect|sdet|qa|quality|test|lead|manager|specialist|scientist|administrator|technician|director|programmer|automation)\b"
NOT_A_COMPANY = r"^\s*(?:senior|junior|mid|mid-?level|entry|lead|principal|staff|head of|graduate|permanent|contract|temporary|full[- ]time|part[- ]time|hybrid|remote|onsite|on-site|flexible|competitive|salary|rate|location|industry|sector|department|job|role|position|vacancy|opportunity|about|overview|summary)\b"
MONEY = r"[£$€]|\b\d+\s*k\b|\bper\s+(?:annum|year|day)\b"
#: Lines in which labels, company lines and places are looked for; lines among which the title is; longest fields.
LABEL_LINES, TOP_LINES, TITLE_LINES, LONGEST, LONGEST_TITLE = 40, 25, 4, 60, 100

FIELDS = ("title", "company", "location", "posted_at")
_SPLIT = r"(?U)\s*[·|]\s*"


def _like(c: Column, pattern: str) -> Column:
    return c.rlike("(?iU)" + pattern)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ *_]+|[ *_]+$", "")


def _furniture(line: Column) -> Column:
    """Not a field of any kind: buttons, headings of page parts, marks, very long lines."""
    return _like(line, NOT_A_FIELD) | _like(line, FURNITURE) | (F.length(line) > 120) | F.lower(line).isin(LONE_WORDS) | _like(line, DEGREE)


def _place(value: Column) -> Column:
    """A place within the search, for values that nobody labelled."""
    return (F.length(value) <= LONGEST) & ~_like(value, MONEY) & location_is_allowed(value)


def _words(line: Column) -> Column:
    return F.size(F.split(_bare(line), r"(?U)\s+"))


def _labelled(lines: Column, names: str) -> Column:
    """The first line with one of the labels and a value of two characters or more: struct(value, line)."""
    pattern = rf"(?iU)^\s*\**\s*(?:{names})\s*\**\s*:\s*(.+?)\s*$"
    value = lambda x: _plain(F.regexp_extract(x, pattern, 1))
    line = F.get(F.filter(lines, lambda x: x.rlike(pattern) & (F.length(value(x)) >= 2)), F.lit(0))
    return F.struct(value(line).alias("value"), line.alias("line"))


def with_paste(df: DataFrame, paste: str) -> DataFrame:
    """``df`` with the column ``paste_fields``: a struct of title, company, location, posted_at, and of each also ``_from`` (its line) and ``_how`` (labelled or guessed); null where nothing was found."""
    stage = text.staged
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(f"`{paste}`").cast("string"), F.lit("")), text.LINE_ENDS), _bare), lambda x: (x != "") & ~x.rlike("^-+$"))
    df = stage(df, __lines=lines)
    # 1. Labels.
    df = stage(df, **{f"__{field}": _labelled(F.slice("__lines", 1, LABEL_LINES), names) for field, names in LABELS.items()})
    lacks = lambda *fields: F.exists(F.array(*(F.col(f"__{f}.line").isNull() for f in fields)), lambda x: x)
    # 2. "Company · Place · age".
    parts = lambda x: F.filter(F.transform(F.slice(F.split(x, _SPLIT), F.lit(2), F.size(F.split(x, _SPLIT))), _bare), lambda y: y != "")
    split = F.transform(
        F.filter(F.slice("__lines", 1, TOP_LINES), lambda x: ~_like(x, FURNITURE) & x.rlike(r"(?U)^\s*[^·|]+?\s*[·|]\s*.+$")),
        lambda x: F.struct(x.alias("line"), _plain(_bare(F.get(F.split(x, "[·|]"), F.lit(0)))).alias("company"), parts(x).alias("parts")),
    )
    aged = F.transform(split, lambda s: F.struct(s["line"].alias("line"), s["company"].alias("company"), F.filter(s["parts"], lambda y, i: (i < F.size(s["parts"]) - 1) | ~_like(y, AGE)).alias("places"), F.when(_like(F.element_at(s["parts"], -1), AGE), F.element_at(s["parts"], -1)).alias("age")))
    df = stage(df, __split=F.when(lacks("company", "location"), aged))
    good = lambda s: (F.size(s["places"]) > 0) & (s["company"] != "") & ~_like(s["company"], NOT_A_COMPANY) & ~_furniture(s["company"]) & (F.length(s["company"]) <= LONGEST) & F.forall(s["places"], _place)
    df = stage(df, __row=F.get(F.filter("__split", good), F.lit(0)))
    line = F.col("__row.line")
    guess = lambda value: F.struct(value.alias("value"), F.when(value.isNotNull(), line).alias("line"))
    got = {"company": guess(F.col("__row.company")), "location": guess(F.get("__row.places", F.lit(0))), "posted_at": guess(F.col("__row.age"))}
    df = stage(df, **{f"__{f}2": F.when(F.col(f"__{f}.line").isNull(), v) for f, v in got.items()})
    # 3. The title: one of the first lines that say something.
    claimed = F.array(*(F.coalesce(f"__{f}.line", f"__{f}2.line") for f in ("company", "location", "posted_at")))
    first = F.slice(F.filter("__lines", lambda x: ~_furniture(x)), 1, TITLE_LINES)
    fits = lambda x: ~F.exists(claimed, lambda y: F.coalesce(y == x, F.lit(False))) & ~_like(x, LABEL_BEFORE) & ~_like(x, AGE) & ~x.endswith(":") & (_words(x) <= 12) & (F.length(x) <= LONGEST_TITLE) & _like(x, TITLE_WORDS)
    title = F.get(F.filter(first, fits), F.lit(0))
    # 4. A line that is a place.
    alone = F.get(F.filter(F.slice("__lines", 1, TOP_LINES), lambda x: ~_furniture(x) & (_words(x) <= 5) & _place(x)), F.lit(0))
    both = lambda x: F.struct(x.alias("value"), x.alias("line"))
    df = stage(df, __title2=F.when(F.col("__title.line").isNull(), both(title)), __location3=F.when(F.coalesce("__location.line", "__location2.line").isNull(), both(alone)))
    out = []
    for f in FIELDS:
        guesses = [f"__{f}2", *["__location3"] * (f == "location")]
        value, line = (F.coalesce(F.when(F.col(f"__{f}.line").isNotNull(), F.col(f"__{f}.{k}")), *(F.col(f"{g}.{k}") for g in guesses)) for k in ("value", "line"))
        how = F.when(F.col(f"__{f}.line").isNotNull(), "labelled").when(line.isNotNull(), "guessed")
        out += [value.alias(f), line.alias(f"{f}_from"), how.alias(f"{f}_how")]
    return df.withColumn("paste_fields", F.struct(*out)).drop("__lines", "__split", "__row", "__location3", *(f"__{f}" for f in FIELDS), *(f"__{f}2" for f in FIELDS))
