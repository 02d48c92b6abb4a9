"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom import config
from jobloom.functions.matching import FLAGS, has

# Named character references of adverts and what stands for them, and the tags that begin a line.
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "mdash": " - ", "ndash": "-", "hellip": "...", "bull": "-", "middot": "-"}
BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|blockquote"
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x85\u2028\u2029]"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_html(c: Column) -> Column:
    return F.regexp_replace(_text(c), "<[^>]+>", " ")


def flat(c: Column) -> Column:
    """All white space as single blanks, none at the ends."""
    return F.trim(one_blank(_text(c)))


def one_blank(c: Column) -> Column:
    """Each run of white space as one blank; single blanks, which most runs are, are not replaced."""
    return F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " ")


def _marker(flat: Column) -> Column:
    """The first marker in a text of one line, or null; all are looked for together before any alone."""
    some = has(flat, "(?:" + "|".join(config.LISTING_MARKERS.values()) + ")")
    return F.when(some, F.coalesce(*(F.when(has(flat, p), F.lit(n)) for n, p in config.LISTING_MARKERS.items())))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are worked out once, however often and wherever they are used later.

    They come out of a generator, through which Spark moves neither filters nor
    expressions; plain columns would be written out again at each use.
    """
    name = "__stage"
    out = df.select("*", F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias(name))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(F.col(f"{name}.{k}").alias(k) for k in columns))


def with_marker(df: DataFrame, description: str) -> DataFrame:
    """The column __marker: of a listing page its marker, else null."""
    df = staged(df, __one=one_blank(_text(F.col(f"`{description}`"))))
    return staged(df, __marker=_marker(F.col("__one"))).drop("__one")


def with_body(df: DataFrame, description: str) -> DataFrame:
    """The columns __marker and __body: of a listing page its marker, and the advert inside it.

    The advert runs from behind the first start marker to the footer or the next
    start, whichever is first; null if it is too short. Only listing pages are
    searched for it.
    """
    start, half = FLAGS + config.BODY_START, config.BODY_CHARS // 2
    df = with_marker(df, description)
    page = F.when(F.col("__marker").isNotNull(), F.regexp_replace(_text(F.col(f"`{description}`")), r"(?U)^\s+|\s+$", ""))
    df = staged(df, __page=page)
    df = staged(df, __at=F.regexp_instr("__page", F.lit(start)), __mark=F.regexp_substr("__page", F.lit(start)))
    df = staged(df, __rest=F.when(F.col("__at") > 0, F.expr("substring(__page, __at + length(__mark), length(__page))")))
    df = staged(df, __foot=F.regexp_instr("__rest", F.lit(FLAGS + config.BODY_END)), __again=F.regexp_instr(F.expr(f"substring(__rest, {half + 1}, length(__rest))"), F.lit(start)))
    stop = F.least(F.when(F.col("__foot") > 0, F.col("__foot") - 1), F.when(F.col("__again") > 0, F.col("__again") - 1 + half), F.length("__rest"))
    body = F.regexp_replace(F.substring(F.col("__rest"), F.lit(1), stop), r"(?U)^\s+|\s+$", "")
    df = staged(df, __body=F.regexp_replace(body, r"(?U)\n\s*\n(?:\s*\n)+", "\n\n"))
    df = df.withColumn("__body", F.when(F.length("__body") >= config.BODY_CHARS, F.col("__body")))
    return df.drop("__page", "__at", "__mark", "__rest", "__foot", "__again")


def collapse_lines(c: Column) -> Column:
    """Each line trimmed, runs of blank lines as one, none at the ends."""
    lines = F.array_join(F.transform(F.split(_text(c), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def page_text(html: Column) -> Column:
    """Text of an HTML page without scripts and styles."""
    bare = F.regexp_replace(_text(html), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return collapse_lines(F.regexp_replace(bare, "<[^>]+>", " "))


def decoded(t: Column) -> Column:
    """Named and numeric character references as characters, each once; unknown ones stay."""
    ref = r"(?i)&(?:#[0-9]+|#x[0-9a-f]+|[a-z]+);"
    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def value(m: Column) -> Column:
        body = F.lower(F.substring(m, F.lit(2), F.length(m) - 2))
        number = F.when(body.startswith("#x"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2))).try_cast("long")
        real = ((number >= 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        return F.coalesce(F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), F.element_at(known, body), m)

    found = F.transform(F.regexp_extract_all(t, F.lit(ref), F.lit(0)), value)
    # Zipped, so the references are found once a text, not once for each gap between them.
    whole = F.array_join(F.zip_with(F.split(t, ref, -1), found, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    return F.when(t.rlike(ref), whole).otherwise(t)


def structured_text(html: Column) -> Column:
    """Text with line ends where blocks begin or end, references decoded, blank lines one at a time."""
    t = F.regexp_replace(F.regexp_replace(_text(html), rf"(?i)</?(?:{BLOCKS})[^>]*>", "\n"), "<[^>]+>", " ")
    lines = F.transform(F.split(decoded(t), LINE_ENDS, -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\u00A0]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def with_post_text(df: DataFrame, description: str) -> DataFrame:
    """The column post_text: the structured text of a description, or of the advert in a listing page."""
    df = with_body(df, description)
    source = F.when(F.col("__marker").isNull(), F.col(f"`{description}`")).otherwise(F.coalesce("__body", F.lit("")))
    df = staged(df, __source=source)
    return staged(df, post_text=structured_text(F.col("__source"))).drop("__marker", "__body", "__source")


def description_kind(c: Column) -> Column:
    """struct(kind, text): how a description is to be shown."""
    t = _text(c)
    html = t.rlike(r"(?i)</?(?:p|div|br|ul|ol|li|h[1-6]|strong|em|span|a|b|i)\b[^>]*>")
    return F.struct(F.when(F.trim(t) == "", "empty").when(html, "html").otherwise("text").alias("kind"), F.when(html, structured_text(c)).otherwise(collapse_lines(c)).alias("text"))


def bare(description: Column) -> Column:
    """Text without tags and without white space at its ends."""
    return F.regexp_replace(strip_html(description), r"(?U)^\s+|\s+$", "")


def is_cut(bare: Column, least: int = config.TRUNCATED_CHARS) -> Column:
    return (bare == "") | bare.rlike(r"(…|\.\.)$") | (F.length(bare) < least)


def looks_truncated(description: Column, least: int = config.TRUNCATED_CHARS) -> Column:
    return is_cut(bare(description), least)


def plain_words(c: Column) -> Column:
    """Lower case; everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def company_title_key(company: Column, title: Column, location: Column) -> Column:
    return F.concat_ws("::", plain_words(company), plain_words(title), plain_words(location))


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def company_key(company: Column) -> Column:
    return F.array_join(F.filter(_words(plain_words(company)), lambda w: ~w.isin(config.COMPANY_NOISE)), " ")


def title_tokens(title: Column) -> Column:
    """Sorted distinct words of a title that say which role it is."""
    words = _words(plain_words(F.regexp_replace(_text(title), FLAGS + config.TITLE_QUANTITY, " ")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(config.TITLE_NOISE))))


def cities_in(location: Column) -> Column:
    low = F.lower(_text(location))
    return F.array_compact(F.array(*(F.when(low.contains(c), F.lit(c)) for c in config.CITIES)))


def is_vague_location(location: Column) -> Column:
    low = plain_words(location)
    vague = F.lit(False)
    for v in config.VAGUE_PLACES:
        vague |= low.contains(v)
    return (low == "") | ((F.size(cities_in(location)) == 0) & vague)


def place(location: Column) -> Column:
    """struct(cities, vague, norm): all that comparing places needs."""
    return F.struct(cities_in(location).alias("cities"), is_vague_location(location).alias("vague"), plain_words(location).alias("norm"))


def places_compatible(a: Column, b: Column) -> Column:
    both = (F.size(a["cities"]) > 0) & (F.size(b["cities"]) > 0)
    return F.when(both, F.arrays_overlap(a["cities"], b["cities"])).otherwise(a["vague"] | b["vague"] | (a["norm"] == b["norm"]))


def canonical_url(url: Column) -> Column:
    """The one form of a LinkedIn posting's address; others trimmed."""
    t = F.trim(_text(url))
    job = F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in (r"(?i)linkedin\.com/jobs/view/(?:[^/?#]*-)?(\d{6,})", r"(?i)linkedin\.com/.*[?&]currentJobId=(\d{6,})")))
    return F.when(job.isNotNull(), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), job)).otherwise(t)


def criteria_employment(c: Column) -> Column:
    """contract if a list such as 'Full-time, Contract' names it, else null."""
    parts = F.transform(F.split(_text(c), "[,/&]| and "), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.when(F.exists(parts, lambda x: x.isin(["contract", "temporary"])), "contract")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Words of a company's name that its slug may lack, and endings of its domain.
SLUG_SUFFIXES = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "group", "holdings", "uk", "plc", "the", "and", "technologies", "technology", "tech", "labs", "bank", "banking", "services", "solutions"]
SLUG_DOMAINS = "com|io|co|ai|net|org"


def slug_variants(company: Column, aliases: Column | None = None, most: int = 5) -> Column:
    """Up to ``most`` guesses at a board's slug, the likeliest first: aliases, then of the name and what it has in brackets the joined, hyphenated and full forms, the first word, the first two."""

    def forms(part: Column) -> Column:
        base = F.replace(F.regexp_replace(F.lower(part), rf"\.(?:{SLUG_DOMAINS})\b", ""), F.lit("&"), F.lit(" and "))
        words = F.filter(F.split(F.regexp_replace(base, r"(?U)[^\w\s-]", ""), r"(?U)\s+"), lambda w: w != "")
        bare = F.filter(words, lambda w: ~w.isin(SLUG_SUFFIXES))
        own = F.when(F.size(bare) > 0, bare).otherwise(words)
        more = F.when(F.size(own) > 1, F.array(F.get(own, F.lit(0)), F.array_join(F.slice(own, 1, 2), "-"))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.array_join(own, ""), F.array_join(own, "-"), F.array_join(words, "")), more)

    parts = F.filter(F.transform(F.split(_text(company), "[()]"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.flatten(F.transform(parts, forms))
    if aliases is not None:
        found = F.concat(F.transform(aliases, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")), found)
    bare = F.transform(found, lambda x: F.regexp_replace(F.trim(x), "^-+|-+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: F.length(x) >= 3)), 1, most)


def redact(c: Column) -> Column:
    """Credentials in addresses and messages hidden."""
    return F.regexp_replace(_text(c), r"(?i)((?:app_id|app_key|api_key|key|token)=)[^&\s\"']+", "$1***")


def host_category(url: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(_text(url), F.lit("HOST")), F.lit("")))
    kinds = {"greenhouse": "greenhouse.io", "lever": "lever.co", "ashby": "ashbyhq.com", "workable": "workable.com", "workday": "myworkdayjobs.com", "smartrecruiters": "smartrecruiters.com", "linkedin": "linkedin.com", "adzuna": "adzuna."}
    return F.coalesce(*(F.when(host.contains(v), F.lit(k)) for k, v in kinds.items()), F.when(host == "", F.lit("none")), F.lit("other"))


def version_bump(title: Column) -> Column:
    """major, minor, patch or unknown, from a title such as 'bump x from 1.2.3 to ^1.3' or 'bump the minor-and-patch group'; what changes 0.x is major."""
    group = F.lower(F.regexp_extract(title, r"(?i)bump the ([\w./-]+) group", 1))
    has_ = lambda w: group.contains(w)
    of_group = F.when(has_("major") & ~has_("minor"), "major").when(has_("minor") | has_("patch"), "minor").otherwise("unknown")

    def version(k: int) -> Column:
        """Three numbers, absent ones 0; null of what does not start with a number behind its operators."""
        raw = F.regexp_replace(F.regexp_extract(title, r"from (\S+) to (\S+)", k), "^[=<>~^v ]+", "")
        bare = F.get(F.split(F.get(F.split(raw, ","), F.lit(0)), "[-+]"), F.lit(0))
        n = lambda g: F.regexp_extract(bare, r"^(\d+)[^.]*(?:\.(\d+)[^.]*(?:\.(\d+))?)?", g).try_cast("decimal(38,0)")
        return F.when(n(1).isNotNull(), F.array(n(1), *(F.coalesce(n(g), F.lit(0).cast("decimal(38,0)")) for g in (2, 3))))

    old, new = version(1), version(2)
    differs = lambda i: F.get(old, F.lit(i)) != F.get(new, F.lit(i))
    of_span = F.when(old.isNull() | new.isNull(), "unknown").when(differs(0) | (F.get(old, F.lit(0)) == 0) & differs(1), "major").when(differs(1), "minor").otherwise("patch")
    return F.when(title.isNull(), "unknown").when(group != "", of_group).otherwise(of_span)
