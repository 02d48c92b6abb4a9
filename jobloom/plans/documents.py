"""Registered queries of CV documents, made from the driver's star tables: roles are suppliers, achievements are line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import lists
from jobloom.operators import coverage, drafts
from jobloom.plans import fixtures

_CV = "Wrote tests for Acme and at Brightwell, for suppliers of payments."
#: Employers, skill items and findings that rows get by their key.
COMPANIES = ("The Acme Group", "Brightwell Ltd", "Northgate Services", "of it", "Payments Technology")
ITEMS = ("Java", "Docker", "contract testing", "REST assured", "Rust", " ", "Jenkins pipelines")
FACTS = ("Java", "JUnit", "contract tests", "REST-assured", "Jenkins", "pipeline of checks")
FINDINGS = ("None.", "n/a", "two numbers are made up", "", "No metric was found in the master", "nothing: all is well", "none of the refs is valid")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet")


def _name(*parts) -> F.Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _pick(values: tuple[str, ...], key: str) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _master(s, d) -> DataFrame:
    c = F.col
    return _lines(s, d).groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select(_name("r", c("l_suppkey")).alias("role_id"), _name("a", c("l_orderkey"), "-", c("l_linenumber")).alias("achievement_id"), _name("part ", c("p")).alias("text"), c("l_linenumber").alias("ordinal"))


def _tailored(s, d) -> DataFrame:
    c, k = F.col, F.col("l_orderkey")
    rows = _lines(s, d).select("l_suppkey", "l_orderkey", "l_linenumber").distinct()
    ref = F.when(k % 10 == 0, _name("r", c("l_suppkey") + 1_000_000)).otherwise(_name("r", c("l_suppkey")))
    achievement = F.when(k % 10 == 1, "zz").otherwise(_name("a", k, "-", c("l_linenumber")))
    bullets = rows.select(ref.alias("ref"), achievement.alias("achievement_ref"), F.when(k % 3 == 0, " own words").when(k % 3 == 1, "  ").alias("text"), k.alias("position"))
    whole = s.read.parquet(f"{d}/supplier.parquet").filter("s_suppkey % 5 = 0").select(_name("r", c("s_suppkey")).alias("ref"), F.lit(None).cast("string").alias("achievement_ref"), F.lit(None).cast("string").alias("text"), (-c("s_suppkey")).alias("position"))
    return bullets.unionByName(whole)


def _restored(s, d) -> DataFrame:
    c = F.col
    drafted = s.read.parquet(f"{d}/orders.parquet").select(_name("d", c("o_custkey")).alias("doc"), _name("i", c("o_orderkey") % 9).alias("item"), c("o_orderkey").alias("o")).groupBy("doc", "item").agg(F.min("o").alias("ordinal"))
    required = s.range(9).select(_name("i", c("id")).alias("item"), c("id").cast("int").alias("ordinal"), (c("id") % 2 == 0).alias("required"))
    return coverage.restore_required(drafted, required)


def _merged(s, d) -> DataFrame:
    """Drafts of the orders: a role for each line, in the order of its part (of rows of one line number that of the smallest part, then supplier); of its bullets none are listed, an empty list, two in reverse, or three of which one is unknown."""
    c, line = F.col, F.col("l_linenumber").cast("string")
    bullet = lambda x: F.struct(F.concat(F.lit("a"), line, F.lit(f".{x}")).alias("ref"), F.lit(None).cast("string").alias("text"))
    kept = F.when(c("l_suppkey") % 4 == 1, F.array().cast(drafts.BULLETS)).when(c("l_suppkey") % 4 == 2, F.array(bullet(3), bullet(1))).when(c("l_suppkey") % 4 == 3, F.array(F.struct(F.lit("zz").alias("ref"), F.lit("own").alias("text")), bullet(2), bullet(4)))
    first = F.min(F.struct("l_partkey", "l_suppkey")).alias("x")
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.*").withColumn("role", F.struct(c("l_partkey"), c("l_linenumber"), F.concat(F.lit("r"), line).alias("ref"), kept.alias("achievements")))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("role")).alias("r"))
    rows = per.select(_name("d", c("l_orderkey")).alias("doc"), F.when(c("l_orderkey") % 29 == 0, "nobody").otherwise("owner").alias("owner"), F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), x["achievements"].alias("achievements"))).alias("experience"))
    ids = s.range(1, 6).select(c("id"), F.struct(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("Company "), "id").alias("company"), F.when(c("id") == 4, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.lit("a"), c("id"), F.lit("."), k))).alias("achievements")).alias("role"))
    masters = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "role"))), lambda x: x["role"]).alias("roles")).withColumn("owner", F.lit("owner"))
    out = drafts.merge_experience(rows, masters)
    shown = F.transform("experience", lambda r: F.concat(r["ref"], F.lit("["), F.coalesce(F.array_join(F.transform(r["achievements"], lambda a: a["ref"]), ","), F.lit("*")), F.lit("]")))
    return out.select("doc", F.array_join(shown, " ").alias("experience"), F.array_join("notes", "; ").alias("notes"))


def _problems(s, d) -> DataFrame:
    o, c = s.read.parquet(f"{d}/orders.parquet"), F.col
    doc = _name("d", c("o_orderkey"))
    drafts = o.select(doc.alias("doc"), F.when(c("o_orderkey") % 7 == 0, " ").otherwise("text").alias("summary"))
    roles = _lines(s, d).select("l_orderkey", "l_linenumber").distinct().filter("l_orderkey % 11 <> 0")
    experience = roles.select(_name("d", c("l_orderkey")).alias("doc"), c("l_linenumber").alias("position"), F.when(c("l_orderkey") % 13 != 0, "r").alias("ref"), (c("l_linenumber") % 2 == 0).alias("listed"), F.lit(0).alias("achievement_position"), F.when(c("l_orderkey") % 5 != 0, "a").alias("achievement_ref"))
    skills = o.select(doc.alias("doc"), F.lit(0).alias("position"), F.when(c("o_orderkey") % 17 != 0, "g").alias("grp"))
    return coverage.structural_problems(drafts, experience, skills)


def _roles(s, d) -> DataFrame:
    rows = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", _pick(COMPANIES, "s_suppkey").alias("company"), (F.col("s_suppkey") % 3).cast("int").alias("achievements"))
    return coverage.missing_roles(rows, _CV).select("s_suppkey", "company")


def _modes(s, d) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet").withColumn("next", F.col("o_orderkey") + 3)
    rows = o.select(F.col("o_orderkey").alias("doc"), _pick(FINDINGS, "o_orderkey").alias("unsupported_refs"), _pick(FINDINGS, "next").alias("invented_metrics"), F.lit(None).cast("string").alias("fabricated_claims"))
    return coverage.failure_modes(rows)


def _escalated(s, d) -> DataFrame:
    kinds = ("reject", "unknown", "revise", "accept", "odd")
    o = s.read.parquet(f"{d}/orders.parquet").withColumn("k", F.floor(F.col("o_orderkey") / 5).cast("long"))
    return coverage.escalation(o.select(F.col("o_orderkey").alias("doc"), _pick(kinds, "o_orderkey").alias("first"), F.when(F.col("k") % 6 != 5, _pick(kinds, "k")).alias("retry")))


def _projected(s, d) -> DataFrame:
    c = F.col
    rows = _lines(s, d).select(c("l_orderkey").cast("string").alias("url"), _name("t", c("l_linenumber")).alias("term"), (c("l_partkey") % 4 != 0).alias("priority"), (c("l_suppkey") % 2 == 0).alias("on_cv"))
    rows = rows.groupBy("url", "term").agg(F.max("priority").alias("priority"), F.max("on_cv").alias("on_cv"))
    proposed = s.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 2 = 0").select(c("o_orderkey").cast("string").alias("url"), F.array(F.lit("t1"), F.lit("t2"), F.lit("t1")).alias("closes"))
    return coverage.projection(rows, proposed).select("url", F.round("projected_coverage", 6).alias("projected_coverage"))


def _ways(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    arr = lambda n: F.transform(F.sequence(k % n, k % n + 3), lambda x: _name("t", x))
    w = lists.three_ways(arr(5), arr(3), arr(4))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", joined(w["on_cv"]).alias("on_cv"), joined(w["master_only"]).alias("master_only"), joined(w["neither"]).alias("neither"), lists.same_set(arr(5), F.reverse(arr(4))).alias("same"))


def _signals(s, d) -> DataFrame:
    c = F.col
    rows = fixtures.postings(s, d).select("url", "employment_type", F.lit("priority").alias("language_tier"), F.when(c("ordinal") % 2 == 0, "java").alias("language_hits"), F.lit("none").alias("clearance_status"), F.lit(None).cast("string").alias("clearance_evidence"), F.lit("pass").alias("rate_verdict"), F.lit("enough").alias("rate_reason"))
    return rows.select("url", coverage.signal_block().alias("signals"))


QUERIES = {
    "cv_bullets": lambda s, d: coverage.resolve(_tailored(s, d), _master(s, d))[0],
    "cv_dangling": lambda s, d: coverage.resolve(_tailored(s, d), _master(s, d))[1],
    "draft_labels": lambda s, d: coverage.draft_labels(_tailored(s, d), _master(s, d)),
    "restored_items": _restored,
    "merged_drafts": _merged,
    "draft_problems": _problems,
    "missing_roles": _roles,
    "unsupported_items": lambda s, d: coverage.unsupported(s.read.parquet(f"{d}/part.parquet").select("p_partkey", _pick(ITEMS, "p_partkey").alias("item")), list(FACTS)),
    "failure_modes": _modes,
    "escalations": _escalated,
    "projections": _projected,
    "term_ways": _ways,
    "signal_blocks": _signals,
}


def _array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_DOCS = """WITH m AS (SELECT 'r' || l_suppkey AS role_id, 'a' || l_orderkey || '-' || l_linenumber AS achievement_id, 'part ' || min(l_partkey) AS mtext, l_linenumber AS ordinal FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
t AS (SELECT DISTINCT CASE WHEN l_orderkey % 10 = 0 THEN 'r' || (l_suppkey + 1000000) ELSE 'r' || l_suppkey END AS ref, CASE WHEN l_orderkey % 10 = 1 THEN 'zz' ELSE 'a' || l_orderkey || '-' || l_linenumber END AS aref, l_suppkey, l_linenumber, l_orderkey AS position, CASE WHEN l_orderkey % 3 = 0 THEN ' own words' END AS own FROM lineitem),
w AS (SELECT 'r' || s_suppkey AS ref, -s_suppkey AS position FROM supplier WHERE s_suppkey % 5 = 0),
good AS (SELECT role_id, achievement_id, coalesce(trim(own), mtext) AS x, coalesce(own, mtext) AS text, position, ordinal, CASE WHEN own IS NULL THEN 'verbatim' ELSE 'reworded' END AS origin FROM t JOIN m ON ref = role_id AND aref = achievement_id
  UNION ALL SELECT role_id, achievement_id, mtext, mtext, position, ordinal, 'verbatim' FROM w JOIN m ON ref = role_id),
lost AS (SELECT ref, aref FROM t WHERE (ref, aref) NOT IN (SELECT role_id, achievement_id FROM m) UNION ALL SELECT ref, NULL FROM w WHERE ref NOT IN (SELECT role_id FROM m))"""

SQL = {
    "cv_bullets": _DOCS + " SELECT role_id, achievement_id, x AS text, position, ordinal, origin FROM good",
    "cv_dangling": _DOCS + " SELECT ref, aref AS achievement_ref FROM lost",
    "draft_labels": _DOCS + " SELECT role_id AS ref, achievement_id AS achievement_ref, origin FROM good UNION ALL SELECT ref, aref, 'not-in-master' FROM lost",
    "merged_drafts": """WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey % 4 AS k FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey NULLS FIRST, l_suppkey NULLS FIRST),
        m AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p, n) AS pos, o % 29 = 0 AS lone, n > 5 OR n = 4 AS other FROM l),
        kept AS (SELECT o, pos, 0 AS back, n, 'r' || n || '[' || CASE WHEN k = 0 THEN '*' WHEN lone OR other THEN ['', 'a#.3,a#.1', 'zz,a#.2,a#.4'][k] ELSE ['a#.1,a#.2,a#.3,a#.4', 'a#.3,a#.1,a#.2,a#.4', 'a#.1,zz,a#.2,a#.3,a#.4'][k] END || ']' AS shown,
                 CASE WHEN NOT lone AND NOT other AND k > 0 THEN ['a#.1, a#.2, a#.3, a#.4', 'a#.2, a#.4', 'a#.1, a#.3'][k] || ' (re-added to Company #)' END AS note FROM m),
        gone AS (SELECT o, coalesce((SELECT max(pos) FROM m x WHERE x.o = d.o AND x.n < g), 0) AS pos, 1 AS back, g AS n, 'r' || g || '[*]' AS shown, 'Company ' || g || ' (role re-added, with every achievement)' AS note
                 FROM (SELECT DISTINCT o FROM m WHERE NOT lone) d, range(1, 6) r(g) WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.o = d.o AND x.n = g)),
        every AS (SELECT o, pos, back, n, replace(shown, '#', n::VARCHAR) AS shown, replace(note, '#', n::VARCHAR) AS note FROM kept UNION ALL SELECT * FROM gone)
        SELECT 'd' || o AS doc, string_agg(shown, ' ' ORDER BY pos, back, n) AS experience, coalesce(string_agg(note, '; ' ORDER BY back, CASE WHEN back = 0 THEN pos END, n) FILTER (note IS NOT NULL), '') AS notes FROM every GROUP BY o""",
    "restored_items": """WITH d AS (SELECT 'd' || o_custkey AS doc, o_orderkey % 9 AS i, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), docs AS (SELECT DISTINCT doc FROM d),
        gone AS (SELECT doc, r.i FROM docs, (SELECT range AS i FROM range(0, 9, 2)) r WHERE (doc, r.i) NOT IN (SELECT doc, i FROM d)),
        e AS (SELECT doc, i, k::DOUBLE AS k, false AS restored, 0 AS m FROM d UNION ALL SELECT g.doc, g.i, coalesce((SELECT max(k) FROM d WHERE d.doc = g.doc AND d.i < g.i), -1)::DOUBLE, true, g.i FROM gone g)
        SELECT doc, 'i' || i AS item, (row_number() OVER (PARTITION BY doc ORDER BY k, restored, m, 'i' || i))::INT AS position, restored FROM e""",
    "draft_problems": """WITH x AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_orderkey % 11 <> 0)
        SELECT 'd' || o_orderkey AS doc, 'no summary' AS problem FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'd' || o_orderkey, 'no experience' FROM orders WHERE o_orderkey NOT IN (SELECT o FROM x)
        UNION ALL SELECT 'd' || o, 'experience[' || n || '] has no ref' FROM x WHERE o % 13 = 0 UNION ALL SELECT 'd' || o, 'experience[' || n || '].achievements[0] has no ref' FROM x WHERE o % 13 <> 0 AND n % 2 = 0 AND o % 5 = 0
        UNION ALL SELECT 'd' || o_orderkey, 'skills[0] has no group' FROM orders WHERE o_orderkey % 17 = 0""",
    "missing_roles": f"SELECT s_suppkey, {_array(COMPANIES)}[s_suppkey % 5 + 1] AS company FROM supplier WHERE s_suppkey % 3 > 0 AND s_suppkey % 5 = 2",
    "unsupported_items": f"SELECT p_partkey, {_array(ITEMS)}[p_partkey % 7 + 1] AS item FROM part WHERE p_partkey % 7 IN (1, 4)",
    "failure_modes": "SELECT o_orderkey AS doc, 'unsupported_ref' AS mode FROM orders WHERE o_orderkey % 7 IN (2, 4, 6) UNION ALL SELECT o_orderkey, 'invented_metric' FROM orders WHERE (o_orderkey + 3) % 7 IN (2, 4, 6)",
    "escalations": "WITH k AS (SELECT o_orderkey, [0, 1, 2, 3, 1][o_orderkey % 5 + 1] AS a, CASE WHEN o_orderkey // 5 % 6 <> 5 THEN [0, 1, 2, 3, 1][o_orderkey // 5 % 5 + 1] END AS b FROM orders) SELECT o_orderkey AS doc, CASE WHEN b > a THEN 'retry' ELSE 'first' END AS chosen FROM k",
    "projections": """WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, bool_or(l_partkey % 4 <> 0) AS p, bool_or(l_suppkey % 2 = 0) AS c FROM lineitem GROUP BY 1, 2)
        SELECT o::VARCHAR AS url, round(100.0::DOUBLE * count(*) FILTER (c OR (o % 2 = 0 AND n IN (1, 2) AND o IN (SELECT o_orderkey FROM orders))) / count(*), 6) AS projected_coverage FROM r WHERE p GROUP BY o""",
    "term_ways": """WITH a AS (SELECT o_orderkey, list_transform(range(o_orderkey % 5, o_orderkey % 5 + 4), lambda x: 't' || x) AS t, list_transform(range(o_orderkey % 3, o_orderkey % 3 + 4), lambda x: 't' || x) AS c, list_transform(range(o_orderkey % 4, o_orderkey % 4 + 4), lambda x: 't' || x) AS m FROM orders)
        SELECT o_orderkey, array_to_string(list_sort(list_filter(t, lambda x: list_contains(c, x))), ',') AS on_cv, array_to_string(list_sort(list_filter(t, lambda x: list_contains(m, x) AND NOT list_contains(c, x))), ',') AS master_only, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(m, x) AND NOT list_contains(c, x))), ',') AS neither, o_orderkey % 5 = o_orderkey % 4 AS same FROM a""",
    "signal_blocks": "WITH postings AS (" + fixtures.duck(fixtures.POSTINGS) + ") SELECT url, 'Language: priority' || CASE WHEN ordinal % 2 = 0 THEN ' (java)' ELSE '' END || chr(10) || 'Clearance: none' || CASE WHEN employment_type = 'contract' THEN chr(10) || 'Rate: pass — enough' ELSE '' END AS signals FROM postings",
}
