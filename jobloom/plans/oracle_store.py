"""DuckDB SQL of duplicates, statuses and mutations of the stored tables."""

from __future__ import annotations

from jobloom.plans import fixtures
from jobloom.plans.oracles import _ORIGINALS, VIEWS, _rx
from jobloom import config

RECURSIVE = VIEWS.replace("WITH postings", "WITH RECURSIVE postings", 1)
_NOW = f"'{fixtures.NOW}'"

#: Clusters as the definition has them: a key's places one after another, each to the first root that fits.
_CLUSTERS = """
places AS (SELECT *, row_number() OVER (PARTITION BY ck, tk ORDER BY since, first_url) AS n FROM (SELECT ck, tk, cities, vague, norm, min((fetched_at, url))[1] AS since, min((fetched_at, url))[2] AS first_url FROM rows_ GROUP BY ALL)),
fold(ck, tk, n, roots, of_) AS (
  SELECT ck, tk, n, [{'u': first_url, 'c': cities, 'v': vague, 'o': norm}], first_url FROM places WHERE n = 1
  UNION ALL SELECT ck, tk, n, CASE WHEN hit IS NULL THEN list_append(roots, {'u': first_url, 'c': cities, 'v': vague, 'o': norm}) ELSE roots END, coalesce(hit, first_url) FROM (
    SELECT p.*, f.roots, list_filter(f.roots, lambda r: CASE WHEN len(r.c) > 0 AND len(p.cities) > 0 THEN len(list_intersect(r.c, p.cities)) > 0 ELSE r.v OR p.vague OR r.o = p.norm END)[1].u AS hit
    FROM fold f JOIN places p ON p.ck = f.ck AND p.tk = f.tk AND p.n = f.n + 1)),
placed AS (SELECT f.of_ AS root, r.url FROM rows_ r JOIN places p ON r.ck = p.ck AND r.tk = p.tk AND r.cities = p.cities AND r.vague = p.vague AND r.norm = p.norm JOIN fold f ON f.ck = p.ck AND f.tk = p.tk AND f.n = p.n),
clusters AS (SELECT root, url FROM placed WHERE root IN (SELECT root FROM placed GROUP BY root HAVING count(*) > 1))"""


def _inherited(linked: str) -> str:
    """url, my_status, inherited_from over a view (url, fetched_at, root)."""
    return f"""
decided AS (SELECT root, url, my_status, row_number() OVER (PARTITION BY root ORDER BY fetched_at, url) AS n FROM {linked} JOIN statuses USING (url) WHERE coalesce(my_status, '') <> ''),
inherited AS (SELECT l.url, d.my_status, d.url AS inherited_from FROM {linked} l JOIN decided d ON d.root = l.root AND d.n = 1 WHERE l.url NOT IN (SELECT url FROM statuses WHERE coalesce(my_status, '') <> ''))"""


_LINKED = ", " + _ORIGINALS + ", linked AS (SELECT p.url, fetched_at, coalesce(original, p.url) AS root FROM postings p LEFT JOIN originals USING (url))"


def _saved(guard: str) -> str:
    """A decision on every eleventh posting, spread to its cluster; ``guard``: which of the siblings' statuses are replaced."""
    return RECURSIVE + _LINKED + f""",
mine AS (SELECT url, 'skipped' AS my_status FROM postings WHERE ordinal % 11 = 0),
after AS (SELECT url, my_status, NULL::VARCHAR AS inherited_from FROM mine UNION ALL SELECT url, my_status, inherited_from FROM statuses WHERE url NOT IN (SELECT url FROM mine)),
spread AS (SELECT r.url, min(o.url) AS source FROM linked r JOIN linked o ON o.root = r.root AND o.url <> r.url JOIN mine ON mine.url = o.url GROUP BY r.url)
SELECT url, CASE WHEN a.url IS NULL OR (s.source IS NOT NULL AND {guard}) THEN 'skipped' ELSE my_status END AS my_status,
       CASE WHEN a.url IS NULL OR (s.source IS NOT NULL AND {guard}) THEN source ELSE inherited_from END AS inherited_from FROM after a FULL JOIN spread s USING (url)"""


_POLLUTED = _rx("description", "|".join(config.LISTING_MARKERS.values()))

SQL = {
    "duplicate_clusters": RECURSIVE + ", " + _CLUSTERS + " SELECT root, url FROM clusters",
    "cluster_sizes": RECURSIVE + ", " + _CLUSTERS + " SELECT root, count(*) AS size FROM clusters GROUP BY root",
    "inheritances": RECURSIVE + _LINKED + "," + _inherited("linked") + " SELECT * FROM inherited",
    "duplicate_audit": RECURSIVE + ", " + _CLUSTERS + ", linked AS (SELECT p.url, fetched_at, coalesce(root, p.url) AS root FROM postings p LEFT JOIN clusters USING (url))," + _inherited("linked") + " SELECT * FROM inherited",
    "duplicate_links": RECURSIVE + ", " + _CLUSTERS + " SELECT url, root AS duplicate_of FROM clusters WHERE url <> root",
    "save_status": _saved("(coalesce(my_status, '') = '' OR inherited_from IS NOT NULL)"),
    "save_status_guarded": _saved("coalesce(my_status, '') = ''"),
    "mark_seen": VIEWS + ", old AS (SELECT url, company FROM postings WHERE ordinal % 3 = 0) SELECT url, company, url IN (SELECT url FROM old) AS known FROM postings",
    "save_details": VIEWS + " SELECT url, title, CASE WHEN ordinal % 4 <> 0 THEN fetched_at END AS fetched_at, CASE WHEN ordinal % 4 = 0 THEN 'changed' ELSE company END AS company FROM postings",
    "save_derived": VIEWS + " SELECT url, CASE WHEN ordinal % 4 = 0 THEN 'changed' ELSE company END AS company, CASE WHEN ordinal % 4 = 0 THEN NULL ELSE location END AS location, title FROM postings",
    "mark_listed": VIEWS + f" SELECT url, CASE WHEN ordinal % 5 = 0 THEN {_NOW} END AS last_listed_at FROM postings",
    "save_evaluation": VIEWS + " SELECT url, CASE WHEN n THEN 50 ELSE match_score END AS match_score, CASE WHEN n THEN NULL ELSE recommendation END AS recommendation FROM (SELECT coalesce(s.url, p.url) AS url, match_score, recommendation, p.url IS NOT NULL AS n FROM scores s FULL JOIN (SELECT url FROM postings WHERE ordinal % 6 = 0) p ON p.url = s.url)",
    "upsert": VIEWS + " SELECT coalesce(s.url, p.url) AS url, CASE WHEN p.url IS NOT NULL THEN 'saved' ELSE my_status END AS my_status, updated_at FROM statuses s FULL JOIN (SELECT url FROM postings WHERE ordinal % 5 = 0) p ON p.url = s.url",
    "candidate_rows": VIEWS + " SELECT company, title, location, url, posted_at, source, employment_type, round(day_rate_min / 3, 2) AS day_rate_min, round(day_rate_max / 3, 2) AS day_rate_max FROM postings",
    "manual_rows": VIEWS + f""", b AS (SELECT url AS stored, company, title, location, ordinal, CASE WHEN ordinal % 4 = 0 THEN url ELSE 'https://www.linkedin.com/jobs/view/' || (1000000 + ordinal) END AS url FROM postings WHERE ordinal % 2 = 0)
        SELECT b.url, ordinal % 4 <> 0 AS added, (SELECT min(p.url) FROM postings p WHERE p.url <> b.url AND lower(coalesce(p.company, '')) = lower(coalesce(b.company, '')) AND lower(coalesce(p.title, '')) = lower(coalesce(b.title, '')) AND lower(coalesce(p.location, '')) = lower(coalesce(b.location, ''))) AS twin FROM b""",
    "remove": VIEWS + " SELECT 'ai_evaluations' AS tab, url FROM scores WHERE url NOT IN (SELECT url FROM postings WHERE ordinal % 3 = 0) UNION ALL SELECT 'user_status', url FROM statuses WHERE url NOT IN (SELECT url FROM postings WHERE ordinal % 3 = 0) UNION ALL SELECT 'cv_scans', url FROM scores",
    "append_companies": "SELECT c_name AS name, 'lever' AS ats, 'slug-' || (c_custkey % 97) AS slug FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 97 ORDER BY c_custkey) AS n FROM customer) WHERE n = 1 AND c_custkey % 97 % 4 <> 0",
    "requeue": VIEWS + f" SELECT url FROM postings WHERE NOT {_POLLUTED}",
    "clean_descriptions": VIEWS + r""", a AS (SELECT url, description || ' ' || chr(10) || chr(10) || chr(10) || ' end ' AS d FROM postings WHERE NOT regexp_matches(description, '<[a-zA-Z/][^>]*>'))
        SELECT url, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(d, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS description FROM a""",
    "rescore_count": VIEWS + " SELECT count(*) AS n FROM postings JOIN scores USING (url)",
    "latest_runs": "SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "first_and_more": VIEWS + ", o AS (SELECT url, fetched_at, row_number() OVER (ORDER BY fetched_at DESC, url) AS n, count(*) OVER () AS c FROM postings) SELECT url, fetched_at, greatest(c - 5, 0) AS more FROM o WHERE n <= 5",
    "queue_limit": VIEWS + " SELECT url, fetched_at FROM screened WHERE passed AND url NOT IN (SELECT url FROM scores) ORDER BY fetched_at, url LIMIT 20",
    "better_texts": RECURSIVE + ", " + _CLUSTERS + """, t AS (SELECT root, c.url, length(description) AS chars FROM clusters c JOIN postings p USING (url)),
        b AS (SELECT root, url AS better, chars AS better_chars FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY chars DESC, url) AS n FROM t) WHERE n = 1)
        SELECT url, better, better_chars FROM t JOIN b USING (root) WHERE better <> url AND better_chars - chars >= 600""",
    "not_older": VIEWS + f""", p AS (SELECT url, posted_at AS r, TIMESTAMP {_NOW} AS now FROM postings),
        t AS (SELECT url, now, CASE WHEN regexp_matches(r, '^\\d{{10,13}}$') THEN make_timestamp(CASE WHEN r::BIGINT > 100000000000 THEN r::BIGINT * 1000 ELSE r::BIGINT * 1000000 END)
              WHEN r = 'yesterday' THEN now - INTERVAL 1 DAY WHEN r LIKE '% days ago' THEN now - to_days(split_part(r, ' ', 1)::INT) WHEN r LIKE '% weeks ago' THEN now - to_days(7 * split_part(r, ' ', 1)::INT)
              ELSE try_cast(replace(r, 'Z', '') AS TIMESTAMP) END AS ts FROM p)
        SELECT url FROM t WHERE coalesce(date_diff('day', ts::DATE, now::DATE) <= 28, true)""",
}
