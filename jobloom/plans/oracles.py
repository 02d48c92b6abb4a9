"""DuckDB SQL of the queries: the posting views and the screens, written apart from the Spark expressions."""

from __future__ import annotations

import re

from jobloom import config
from jobloom.plans import fixtures


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rx(text: str, pattern: str) -> str:
    """A case-insensitive match; lookaheads are written as the end or another character."""
    return f"regexp_matches({text}, {_lit('(?i)' + pattern.replace('(?![a-z0-9])', '([^a-z0-9]|$)'))})"


def _words(ws: list[str]) -> str:
    return "(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in ws) + ")"


def _names(text: str, patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_rx(text, p)} THEN {_lit(n)} END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


def _some(text: str, patterns: dict[str, str]) -> str:
    return "(" + " OR ".join(_rx(text, p) for p in patterns.values()) + ")"


def plain(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_lit, xs)) + "]"


STRIP = r"regexp_replace({}, '<[^>]+>', ' ', 'g')"
_FLAT = r"regexp_replace(description, '\s+', ' ', 'g')"
_MARKER = "CASE " + " ".join(f"WHEN {_rx(_FLAT, p)} THEN {_lit(n)}" for n, p in config.LISTING_MARKERS.items()) + " END"
_TITLE = f"({_rx('title', _words(config.PRIORITY_TITLES))} OR ({_rx('title', _words(config.ALLOWED_TITLES))} AND NOT {_rx('title', _words(config.EXCLUDED_TITLES))}))"
_PLACE = "(" + " OR ".join(_rx("coalesce(location, '')", p) for p in config.LOCATIONS) + ")"
_CITIES = "list_filter(" + _list(config.CITIES) + ", lambda c: contains(lower(coalesce(location, '')), c))"
_VAGUE = f"({plain('location')} = '' OR (len({_CITIES}) = 0 AND len(list_filter({_list(config.VAGUE_PLACES)}, lambda v: contains({plain('location')}, v))) > 0))"
_COMPANY_KEY = f"array_to_string(list_filter(string_split({plain('company')}, ' '), lambda w: w <> '' AND NOT list_contains({_list(config.COMPANY_NOISE)}, w)), ' ')"
_QUANTITY = f"regexp_replace(coalesce(title, ''), {_lit('(?i)' + config.TITLE_QUANTITY)}, ' ', 'g')"
_TOKENS = f"list_sort(list_distinct(list_filter(string_split({plain(_QUANTITY)}, ' '), lambda w: w <> '' AND NOT list_contains({_list(config.TITLE_NOISE)}, w))))"
_START, _FOOT = "(?:" + config.BODY_START + ")", "(?:" + config.BODY_END + ")"
_AFTER = f"regexp_extract(trim(description), {_lit('(?is)' + _START + '(.*)$')}, 1)"

#: Views that the queries' SQL starts with.
VIEWS = f"""
WITH postings AS ({fixtures.duck(fixtures.POSTINGS)}),
scores AS ({fixtures.duck(fixtures.SCORES)}),
statuses AS ({fixtures.duck(fixtures.STATUSES)}),
marked AS (SELECT *, {_MARKER} AS marker, {_AFTER} AS after, {_rx('description', config.BODY_START)} AS has_start FROM postings),
bodied AS (SELECT *, CASE WHEN has_start THEN trim(substring(after, 1, least(
      CASE WHEN {_rx('after', _FOOT)} THEN length(regexp_extract(after, {_lit('(?is)^(.*?)' + _FOOT)}, 1)) ELSE 1000000 END,
      CASE WHEN {_rx('substring(after, 101)', _START)} THEN 100 + length(regexp_extract(substring(after, 101), {_lit('(?is)^(.*?)' + _START)}, 1)) ELSE 1000000 END)::INT)) END AS body0 FROM marked),
own AS (SELECT *, CASE WHEN length(body0) >= 200 THEN body0 END AS body,
      trim(CASE WHEN marker IS NULL THEN coalesce(title, '') || ' ' || coalesce(description, '')
           WHEN length(body0) >= 200 THEN title || ' ' || body0 ELSE title END) AS advert FROM bodied),
hits AS (SELECT *, {STRIP.format('advert')} AS t FROM own),
lang AS (SELECT *, {_names('t', config.STACK_PRIORITY)} AS l1, {_names('t', config.STACK_SECONDARY)} AS l2, {_names('t', config.STACK_DEALBREAKERS)} AS l3,
      {_TITLE} AS title_ok, {_PLACE} AS place_ok,
      {_some(STRIP.format('description'), config.STACK_DEALBREAKERS)} AND NOT {_some(STRIP.format('description'), config.STACK_PRIORITY | config.STACK_SECONDARY)} AS mismatch FROM hits),
screened AS (SELECT *, CASE WHEN len(l1) > 0 THEN 'priority' WHEN len(l2) > 0 THEN 'secondary' WHEN len(l3) > 0 THEN 'mismatch' ELSE 'none' END AS language_tier,
      nullif(array_to_string(list_concat(list_concat(l1, l2), l3), ', '), '') AS language_hits,
      title_ok AND place_ok AND NOT mismatch AS passed FROM lang),
keyed AS (SELECT *, {_COMPANY_KEY} AS ck, {_TOKENS} AS tk, {_CITIES} AS cities, {_VAGUE} AS vague, {plain('location')} AS norm FROM postings),
rows_ AS (SELECT * FROM keyed WHERE ck <> '' AND len(tk) > 0)"""
_COMPATIBLE = "CASE WHEN len(a.cities) > 0 AND len(b.cities) > 0 THEN len(list_intersect(a.cities, b.cities)) > 0 ELSE a.vague OR b.vague OR a.norm = b.norm END"
_ORIGINALS = f"originals AS (SELECT url, original FROM (SELECT a.url, b.url AS original, row_number() OVER (PARTITION BY a.url ORDER BY b.fetched_at, b.url) AS n FROM rows_ a JOIN rows_ b ON a.ck = b.ck AND a.tk = b.tk AND a.url <> b.url AND (b.fetched_at, b.url) <= (a.fetched_at, a.url) WHERE {_COMPATIBLE}) WHERE n = 1)"

#: Conditions over the view ``screened``.
SQL = {
    "board": VIEWS + " SELECT s.url, company, title, location, language_tier, match_score, coalesce(recommendation, 'not_evaluated') AS recommendation, my_status FROM screened s LEFT JOIN scores USING (url) LEFT JOIN statuses USING (url) WHERE passed",
    "postings": VIEWS + " SELECT url, company, title, location, posted_at, length(description) AS n, employment_type, day_rate_min, day_rate_max, day_rate_source, fetched_at, source FROM postings",
    "listing_pages": VIEWS + " SELECT url, marker, length(body) AS body_chars, marker IS NOT NULL AND body IS NOT NULL AS recoverable FROM own",
    "language_fit": VIEWS + " SELECT url, language_tier, CASE language_tier WHEN 'priority' THEN 3 WHEN 'secondary' THEN 2 WHEN 'none' THEN 1 ELSE 0 END AS language_rank, language_hits FROM screened",
    "content_screens": VIEWS + " SELECT url, title_ok, place_ok, mismatch FROM screened",
    "truncated": VIEWS + rf" SELECT url, t = '' OR regexp_matches(t, '(…|\.\.)$') OR length(t) < {config.TRUNCATED_CHARS} AS truncated FROM (SELECT url, trim({STRIP.format('description')}) AS t FROM postings)",
    "page_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "title_keys": VIEWS + f" SELECT url, concat_ws('::', {plain('company')}, {plain('title')}, {plain('location')}) AS company_title_key, ck AS company_key, array_to_string(tk, ' ') AS tokens, array_to_string(cities, ' ') AS cities, vague FROM keyed",
    "originals": VIEWS + ", " + _ORIGINALS + " SELECT * FROM originals",
    "twins": VIEWS + " SELECT a.url, min(b.url) AS twin FROM postings a JOIN postings b ON lower(coalesce(a.company, '')) = lower(coalesce(b.company, '')) AND lower(coalesce(a.title, '')) = lower(coalesce(b.title, '')) AND lower(coalesce(a.location, '')) = lower(coalesce(b.location, '')) AND a.url <> b.url GROUP BY a.url",
    "unevaluated": VIEWS + " SELECT url, fetched_at FROM screened WHERE passed AND url NOT IN (SELECT url FROM scores)",
    "scored": VIEWS + " SELECT url, match_score, recommendation FROM postings JOIN scores USING (url)",
    "manual_pending": VIEWS + " SELECT p.url, my_status FROM postings p LEFT JOIN scores USING (url) LEFT JOIN statuses USING (url) WHERE source = 'manual' AND match_score IS NULL",
    "status_counts": VIEWS + " SELECT coalesce(my_status, 'none') AS my_status, count(*) AS n FROM screened LEFT JOIN statuses USING (url) WHERE passed GROUP BY 1",
    "board_filtered": VIEWS + " SELECT s.url, my_status FROM screened s LEFT JOIN scores USING (url) LEFT JOIN statuses USING (url) WHERE passed AND recommendation = 'apply' AND my_status IS NULL AND employment_type IS DISTINCT FROM 'contract' AND language_tier IN ('priority', 'secondary')",
    "is_new": VIEWS + f", k AS (SELECT url, ordinal, concat_ws('::', {plain('company')}, {plain('title')}, {plain('location')}) AS key FROM postings) SELECT url, url NOT IN (SELECT url FROM k WHERE ordinal % 3 = 0) AND key NOT IN (SELECT key FROM k WHERE ordinal % 3 = 0) AS is_new FROM k",
    "per_source": VIEWS + " SELECT source, count(*) AS fetched, count(*) FILTER (ordinal % 2 = 0) AS new FROM postings GROUP BY source",
    "distinct_companies": VIEWS + " SELECT DISTINCT company FROM postings WHERE company <> ''",
    "board_audit": VIEWS + ", r AS (SELECT *, row_number() OVER (PARTITION BY company, title_ok AND place_ok ORDER BY ordinal, url) AS n FROM screened) SELECT company, count(*) AS n, count(*) FILTER (contains(lower(coalesce(location, '')), 'london')) AS london, count(*) FILTER (place_ok) AS uk, count(*) FILTER (title_ok AND place_ok) AS candidates, coalesce(string_agg(CASE WHEN title_ok AND place_ok AND n <= 8 THEN title END, '; ' ORDER BY n), '') AS titles FROM r GROUP BY company",
    "redirects": """WITH k AS (SELECT CASE WHEN page_id % 5 = 4 THEN 'none' WHEN page_id % 7 = 6 THEN CASE WHEN url LIKE '%greenhouse.io%' THEN 'greenhouse' WHEN url LIKE '%lever.co%' THEN 'lever' ELSE 'other' END
          ELSE ['greenhouse', 'lever', 'ashby', 'workable', 'workday', 'smartrecruiters', 'linkedin', 'adzuna', 'other'][page_id % 11 % 9 + 1] END AS category FROM pages)
        SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM k), 2)::DOUBLE AS percent FROM k GROUP BY 1""",
    "posted_age": VIEWS + f""", p AS (SELECT url, posted_at AS r, TIMESTAMP '{fixtures.NOW}' AS now FROM postings),
        t AS (SELECT url, now, CASE WHEN regexp_matches(r, '^\\d{{10,13}}$') THEN make_timestamp(CASE WHEN r::BIGINT > 100000000000 THEN r::BIGINT * 1000 ELSE r::BIGINT * 1000000 END)
              WHEN r = 'yesterday' THEN now - INTERVAL 1 DAY WHEN r LIKE '% days ago' THEN now - to_days(split_part(r, ' ', 1)::INT) WHEN r LIKE '% weeks ago' THEN now - to_days(7 * split_part(r, ' ', 1)::INT)
              ELSE try_cast(replace(r, 'Z', '') AS TIMESTAMP) END AS ts FROM p)
        SELECT url, ts AS posted_ts, date_diff('day', ts::DATE, now::DATE)::INT AS age FROM t""",
    "lessons": "SELECT mode, count(*)::INT AS hits, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen, (max(ts) FILTER (n = 2))::VARCHAR AS active_since, arg_max(event_id, n) AS last_evidence FROM (SELECT event_type AS mode, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) GROUP BY mode",
    "save_inherited": VIEWS + ", f AS (SELECT url, 'applied' AS my_status FROM postings WHERE ordinal % 2 = 0) SELECT url, CASE WHEN s.url IS NULL OR s.inherited_from IS NOT NULL AND f.url IS NOT NULL THEN f.my_status ELSE s.my_status END AS my_status FROM statuses s FULL JOIN f USING (url)",
    "unknown_companies": VIEWS + " SELECT DISTINCT company FROM postings WHERE lower(company) NOT IN (SELECT lower(c_name) FROM customer)",
    "first_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) WHERE n = 1",
    "top_scores": VIEWS + " SELECT source, url, match_score FROM (SELECT source, url, match_score, row_number() OVER (PARTITION BY source ORDER BY match_score DESC, url) AS n FROM postings JOIN scores USING (url)) WHERE n <= 12",
    "page_structure": r"""WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|blockquote)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
        c AS (SELECT page_id, html, list_transform(regexp_extract_all(t, '(?i)&(?:#[0-9]+|#x[0-9a-f]+|[a-z]+);'), lambda m: [m, lower(m[2:len(m) - 1])]) AS refs, string_split_regex(t, '(?i)&(?:#[0-9]+|#x[0-9a-f]+|[a-z]+);') AS gaps FROM a),
        d AS (SELECT page_id, html, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(refs) THEN '' ELSE coalesce(CASE WHEN refs[i][2] LIKE '#x%' THEN chr(('0x' || refs[i][2][3:])::INT) WHEN refs[i][2] LIKE '#%' THEN chr(refs[i][2][2:]::INT) END,
              MAP {'nbsp': ' ', 'amp': '&', 'lt': '<', 'gt': '>', 'quot': '"', 'apos': '''', 'rsquo': '''', 'lsquo': '''', 'rdquo': '"', 'ldquo': '"', 'mdash': ' - ', 'ndash': '-', 'hellip': '...', 'bull': '-', 'middot': '-'}[refs[i][2]], refs[i][1]) END), '') AS t FROM c),
        e AS (SELECT page_id, html, array_to_string(list_transform(string_split_regex(t, '\r\n|[\n\r]'), lambda l: trim(regexp_replace(l, '[\t ]+', ' ', 'g'))), chr(10)) AS t FROM d)
        SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text, CASE WHEN trim(html) = '' THEN 'empty' WHEN regexp_matches(html, '(?i)</?(?:p|div|br|ul|ol|li|h[1-6]|strong|em|span|a|b|i)\b[^>]*>') THEN 'html' ELSE 'text' END AS kind FROM e""",
}
