"""Keyword coverage of CVs: terms, gaps, scan verdicts, suggestions, projections, and CV documents.

A CV is one text that every worker gets (its size is checked); postings and their
terms stay distributed: one row a (url, term), so sums and ranks are plain
aggregates and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import terms as t
from jobloom.functions.lexicon import Lexicon
from jobloom.functions.text import staged

#: Percent of priority terms for a pass; least weight of a hard gap; characters below which a text is a snippet.
PASS_COVERAGE, GAP_WEIGHT, SNIPPET_CHARS = 85.0, 2.0, 1000
MAX_GAPS, MAX_SUGGESTIONS, MAX_EVIDENCED, ON_CV = 25, 12, 20, 0.7
#: Characters that a CV or fact base may have to be sent to every worker.
MAX_CV_CHARS = 4_000_000
#: Achievements of one fact base at most; they are broadcast.
MAX_FACTS = 20_000
TERM = "term string, count int, in_requirements int, in_duties int, in_nice int, skill boolean, capitalised boolean, in_title boolean, surfaces array<string>"


class _Seen:
    """Term rows of postings; those of a text that was met before are taken again, not extracted again.

    Adverts repeat, and what a company's name changes in one is the few of its words that
    the advert or its title has: title, text and these tell the rows. Held rows are
    bounded; when they are too many, only texts that were met again stay.
    """

    #: Rows that are held, and characters of their texts.
    MOST, CHARS = 200_000, 20_000_000

    def __init__(self, extract, told, names: list[str]):
        self.extract, self.told, self.names = extract, told, names
        self.places: dict[tuple, tuple[int, int]] = {}
        self.words: dict[tuple[str, str], frozenset[str]] = {}
        self.again: set[tuple] = set()
        self.chars, self.held = 0, self._batch([])

    def _batch(self, found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(self.told(found), self.names)

    def _words(self, title: str, body: str) -> frozenset[str]:
        """Runs of letters and digits: no other word of a text can be one of a company's name."""
        out = self.words.get((title, body))
        if out is None:
            out = self.words[title, body] = frozenset(re.findall("[a-z0-9]+", t.normalise(body) + " " + t.normalise(title)))
        return out

    def rows(self, titles: pa.Array, companies: pa.Array, recruiters: pa.Array, bodies: pa.Array) -> tuple[np.ndarray, pa.RecordBatch]:
        """How many rows each posting has, and the rows."""
        bodies, start, size, fresh = bodies.dictionary_encode(), [], [], []
        texts, top = bodies.dictionary.to_pylist(), self.held.num_rows
        for title, company, recruiter, k in zip(titles.to_pylist(), companies.to_pylist(), recruiters.to_pylist(), bodies.indices.to_pylist(), strict=True):
            title, body = title or "", (texts[k] if k is not None else None) or ""
            stop = t.noise_terms(company or "", recruiter or "") & self._words(title, body)
            key = (title, body, stop)
            place = self.places.get(key)
            if place is None:
                fresh.append(self.extract(body, title, stop))
                place = self.places[key] = (top, len(fresh[-1]))
                top += place[1]
                self.chars += self._size(key)
            else:
                self.again.add(key)
            start.append(place[0])
            size.append(place[1])
        if fresh:
            self.held = pa.concat_batches([self.held, self._batch(fresh)])
        size = np.array(size, np.int64)
        out = self.held.take(pa.array(_ranges(np.array(start, np.int64), size)))
        if self.held.num_rows > self.MOST or self.chars > self.CHARS:
            self._shrink()
        return size, out

    @staticmethod
    def _size(key: tuple) -> int:
        return len(key[0]) + len(key[1]) + 100

    def _shrink(self) -> None:
        kept = {k: self.places[k] for k in self.again}
        if sum(n for _, n in kept.values()) > self.MOST // 2 or sum(map(self._size, kept)) > self.CHARS // 2:
            kept = {}
        size = np.array([n for _, n in kept.values()], np.int64)
        self.held = self.held.take(pa.array(_ranges(np.array([a for a, _ in kept.values()], np.int64), size)))
        self.places = dict(zip(kept, zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True), strict=True))
        self.words = {k[:2]: self.words[k[:2]] for k in kept}
        self.again, self.chars = set(), sum(map(self._size, kept))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one behind the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def posting_terms(postings: DataFrame, lexicon: Lexicon = Lexicon(), text: str = "post_text", marks: dict[str, str] | None = None, surfaces: bool = True) -> DataFrame:
    """One row a (url, term) with counts, weight, section and priority.

    Words of the company's name, and of a column ``recruiter`` if there is one, are
    no terms. ``marks``: Boolean columns to add and the text whose terms they tell (C7); they
    are told in the same pass, each different term once a worker. Without ``surfaces``
    (lists, the dearest column) rows lack these.
    """
    marks = marks or {}
    for x in marks.values():
        _sendable(x)
    columns = TERM.split(", ") if surfaces else TERM.split(", ")[:-1]
    names = [x.split()[0] for x in columns]
    kinds = [pa.string(), *[pa.int32()] * 4, *[pa.bool_()] * 3, pa.list_(pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, looks = t.Extractor(lexicon), [t.Present(x) for x in marks.values()]

        known: dict[str | tuple[str, ...], tuple[bool, ...]] = {}

        def marked(term: str, forms: dict[str, int]) -> tuple[bool, ...]:
            """Of a term and its surfaces whether each text has it."""
            key = term if len(forms) == 1 and term in forms else (term, *sorted(forms))
            out = known.get(key)
            if out is None:
                own = sorted(forms)
                out = tuple([look.has(term, own) for look in looks])
                if len(known) < t.Present.MOST:
                    known[key] = out
            return out

        def told(found: list[dict]) -> list[pa.Array]:
            rows = [v for own in found for v in own.values()]
            cols = [[k for own in found for k in own], *([v[n] for v in rows] for n in names[1:8])]
            if surfaces:
                cols.append([sorted(v["surfaces"]) for v in rows])
            yes = [marked(k, v["surfaces"]) for k, v in zip(cols[0], rows, strict=True)] if looks else []
            return [*(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=False)), *(pa.array([y[i] for y in yes], pa.bool_()) for i in range(len(looks)))]

        seen = _Seen(extract.posting, told, [*names, *marks])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, rows = seen.rows(*part.columns[1:])
                urls = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([urls, *rows.columns], ["url", *names, *marks])

    recruiter = F.col("recruiter") if "recruiter" in postings.columns else F.lit(None).cast("string").alias("recruiter")
    found = postings.select("url", "title", "company", recruiter, F.col(text).alias("body")).mapInArrow(work, ", ".join(["url string", *columns, *(f"{m} boolean" for m in marks)]))
    weight = 3.0 * F.col("in_requirements") + 1.5 * F.col("in_duties") + F.col("count") + 0.5 * F.col("in_nice")
    section = F.when(F.col("in_requirements") > 0, "requirements").when(F.col("in_duties") > 0, "duties").when(F.col("in_nice") > 0, "nice-to-have").otherwise("mentioned")
    found = found.withColumn("weight", weight).withColumn("section", section)
    priority = F.col("in_title") | F.when(F.col("skill"), F.col("weight") >= 2.5).otherwise(F.col("capitalised") & ((F.col("in_requirements") > 0) | (F.col("in_duties") > 0)))
    return found.withColumn("priority", priority)


def _sendable(text: str) -> str:
    if len(text) > MAX_CV_CHARS:
        raise ValueError("the text is too long to be sent to every worker")
    return text


def present(text: str):
    """A Boolean expression of (term, surfaces): whether one text has the term."""
    _sendable(text)

    @F.pandas_udf("boolean")
    def has(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        look = t.Present(text)
        for term, surfaces in batches:
            yield pd.Series([look.told(a, list(b)) for a, b in zip(term, surfaces, strict=True)], dtype=bool)

    return lambda: has(F.col("term"), F.col("surfaces"))


def with_coverage(found: DataFrame, cv: str, master: str) -> DataFrame:
    """Terms with on_cv, in_master and kind: on_cv, closable (only the fact base has it) or unclosable (U2). Marks that are there are not told again."""
    told = {"on_cv": cv, "in_master": master}
    rows = found.withColumns({k: present(v)() for k, v in told.items() if k not in found.columns})
    return rows.withColumn("kind", F.when(F.col("on_cv"), "on_cv").when(F.col("in_master"), "closable").otherwise("unclosable"))


def hard_gap() -> Column:
    return ~F.col("on_cv") & F.col("priority") & F.col("skill") & (F.col("in_requirements") > 0) & (F.col("weight") >= GAP_WEIGHT)


def _top(test: Column, n: int) -> Column:
    """Up to ``n`` terms that meet a test, heaviest first."""
    key = F.struct((-F.col("weight")).alias("w"), F.col("term").alias("term"))
    return F.transform(F.slice(F.array_sort(F.collect_list(F.when(test, key))), 1, n), lambda x: x["term"])


def scan(postings: DataFrame, cv: str, master: str, lexicon: Lexicon = Lexicon(), truncated: Column | None = None) -> DataFrame:
    """One row a posting: coverage, gaps and verdict (C14, A5). An unreliable text comes before hard gaps, these before coverage; without priority terms coverage is 100."""
    rows = with_coverage(posting_terms(postings, lexicon, marks={"on_cv": cv, "in_master": master}, surfaces=False), cv, master)
    p = F.col("priority")
    per = rows.groupBy("url").agg(
        F.count("*").alias("terms_found"), F.count_if("on_cv").alias("present"), F.count_if(p).alias("priority_total"), F.count_if(p & F.col("on_cv")).alias("priority_on_cv"),
        F.count_if(hard_gap()).alias("hard_gap_count"), _top(hard_gap(), MAX_GAPS).alias("hard_gaps"), _top(p & ~F.col("on_cv"), MAX_GAPS).alias("priority_gaps"), _top(p & F.col("on_cv"), MAX_EVIDENCED).alias("evidenced"),
        _top(p & (F.col("kind") == "closable"), MAX_GAPS).alias("closable"), _top(p & (F.col("kind") == "unclosable"), MAX_GAPS).alias("unclosable"),
        F.max((F.col("in_requirements") > 0) | (F.col("in_duties") > 0) | (F.col("in_nice") > 0)).alias("has_sections"),
    )
    chars = F.length(F.coalesce("post_text", F.lit("")))
    out = postings.select("url", chars.alias("posting_chars"), (F.lit(False) if truncated is None else truncated).alias("__cut")).join(per, "url", "left").na.fill(0, ["terms_found", "present", "priority_total", "priority_on_cv", "hard_gap_count"])
    unreliable = F.when(F.col("__cut") | (F.col("posting_chars") < SNIPPET_CHARS), "snippet").when(~F.coalesce("has_sections", F.lit(False)), "no_headings")
    share = lambda a, b, none: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(none)
    out = out.withColumns({"unreliable": unreliable, "priority_coverage": share("priority_on_cv", "priority_total", 100.0), "all_term_coverage": share("present", "terms_found", 0.0)})
    verdict = F.when(F.col("unreliable").isNotNull(), "unknown").when(F.col("hard_gap_count") > 0, "fail").when(F.col("priority_coverage") < PASS_COVERAGE, "borderline").otherwise("pass")
    return out.withColumn("verdict", verdict).drop("__cut", "has_sections")


def gap_report(found: DataFrame, tailored: str, master: str) -> DataFrame:
    """url, heading, term, weight, section (C9): priority gaps (hard and other), evidenced, dropped in tailoring (U3), background; in no order."""
    rows = with_coverage(found, tailored, master)
    p, on = F.col("priority"), F.col("on_cv")
    heading = F.when(p & ~on & F.col("in_master"), "dropped").when(hard_gap(), "hard gap").when(p & ~on, "priority gap").when(p, "evidenced").otherwise("background")
    return rows.select("url", heading.alias("heading"), "term", "weight", "section")


def gap_figures(found: DataFrame, tailored: str) -> DataFrame:
    """url, total, present, percent, priority_percent of the gap report; without priority terms its percentage is 0."""
    rows = found.withColumn("on_cv", present(tailored)())
    per = rows.groupBy("url").agg(F.count("*").alias("total"), F.count_if("on_cv").alias("present"), F.count_if("priority").alias("p"), F.count_if(F.col("priority") & F.col("on_cv")).alias("pp"))
    return per.select("url", "total", "present", (100.0 * F.col("present") / F.col("total")).alias("percent"), F.when(F.col("p") > 0, 100.0 * F.col("pp") / F.col("p")).otherwise(0.0).alias("priority_percent"))


def suggestions(rows: DataFrame, achievements: DataFrame, cv: str, most: int = MAX_SUGGESTIONS) -> DataFrame:
    """Achievements of the fact base that close priority gaps (C15): url, achievement_id, kind, overlap, closes, weight_closed, rank.

    ``rows``: terms with coverage; ``achievements``: role_id, achievement_id, text, tags, metrics. An achievement whose wording one CV line has already is to be reworded.
    """
    closable = rows.filter((F.col("kind") == "closable") & F.col("priority")).select("url", "term", "surfaces", "weight")
    lines = cv.splitlines()

    @F.pandas_udf("double")
    def best(text: pd.Series) -> pd.Series:
        return pd.Series([t.overlap(x or "", lines) for x in text], dtype=float)

    hay = F.concat_ws(" ", "text", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("metrics", F.array().cast("array<string>")), " "))
    facts = achievements.select("role_id", "achievement_id", F.trim("text").alias("text"), hay.alias("hay"))
    known = facts.select("role_id", "achievement_id", "hay").limit(MAX_FACTS + 1).collect()
    if len(known) > MAX_FACTS or sum(len(x.hay) for x in known) > MAX_CV_CHARS:
        raise ValueError("too many achievements to be sent to every worker")
    ids, texts = [(x.role_id, x.achievement_id) for x in known], [x.hay for x in known]

    @F.pandas_udf("array<struct<role_id:string,achievement_id:string>>")
    def closed_by(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        index, known = t.Facts(texts), {}
        for term, surfaces in batches:
            out = []
            for key in zip(term, map(tuple, surfaces), strict=True):
                if key not in known:
                    if len(known) >= t.Present.MOST:
                        known.clear()
                    known[key] = [{"role_id": ids[k][0], "achievement_id": ids[k][1]} for k in index.having(key[0], list(key[1]))]
                out.append(known[key])
            yield pd.Series(out)

    # Told in the pass that finds the terms; each different term with its surfaces once a worker: another posting's surfaces say nothing of this one.
    met = closable.select("url", "term", "weight", F.explode(closed_by("term", "surfaces")).alias("f")).select("url", "term", "weight", "f.*")
    per = met.join(F.broadcast(facts.select("role_id", "achievement_id", "text", best("text").alias("overlap"))), ["role_id", "achievement_id"])
    out = per.groupBy("url", "role_id", "achievement_id", "text", "overlap").agg(F.array_sort(F.collect_list("term")).alias("closes"), F.round(F.sum("weight"), 2).alias("weight_closed"))
    out = out.withColumn("kind", F.when(F.col("overlap") >= ON_CV, "reword_achievement").otherwise("add_achievement"))
    order = Window.partitionBy("url").orderBy(F.desc("weight_closed"), F.col("kind") != "add_achievement", F.desc(F.size("closes")), "achievement_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def projection(rows: DataFrame, proposed: DataFrame) -> DataFrame:
    """url, coverage if every suggestion were added (C16): terms on the CV or closed by one."""
    closed = proposed.select("url", F.explode("closes").alias("term")).distinct().withColumn("__c", F.lit(True))
    met = rows.filter("priority").join(closed, ["url", "term"], "left")
    return met.groupBy("url").agg((100.0 * F.count_if(F.col("on_cv") | F.coalesce("__c", F.lit(False))) / F.count("*")).alias("projected_coverage"))


# Words of employers' names that a CV does not repeat.
LEGAL_WORDS = ("ltd", "limited", "inc", "llc", "plc", "group", "holdings", "services", "service", "solutions", "company", "computer", "technologies", "technology", "consulting", "the", "and")


def missing_roles(roles: DataFrame, cv: str) -> DataFrame:
    """Roles with achievements whose employer the CV does not name (C17): the stem of the name's first telling word is nowhere in the CV's stemmed text. ``roles``: role_id, company, achievements (their number)."""
    line = t.stemmed(_sendable(cv))
    telling = F.filter(F.split(F.lower(F.coalesce("company", F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*LEGAL_WORDS))

    @F.pandas_udf("boolean")
    def absent(word: pd.Series) -> pd.Series:
        return pd.Series([t.stem_key(w) not in line for w in word], dtype=bool)

    first = roles.filter("achievements > 0").withColumn("__word", F.get(telling, F.lit(0))).filter("__word is not null")
    return first.filter(absent("__word")).drop("__word")


# CV documents --------------------------------------------------------------------------------


def resolve(tailored: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bullets of a tailored CV (C11, J10), and references that the master lacks.

    ``tailored``: ref (role), achievement_ref (null: all of the role), text (overrides), position; ``master``: role_id, achievement_id, text, ordinal.
    References to one achievement meet the master by it, so a long role is not compared with itself.
    """
    m = master.select("role_id", "achievement_id", F.col("text").alias("__text"), "ordinal")
    one, every = tailored.filter("achievement_ref is not null"), tailored.filter("achievement_ref is null")
    own = F.nullif(F.trim("text"), F.lit(""))
    made = ["role_id", "achievement_id", F.coalesce(own, F.col("__text")).alias("text"), "position", "ordinal", F.when(own.isNull() | (F.col("text") == F.col("__text")), "verbatim").otherwise("reworded").alias("origin")]
    by_both = (F.col("ref") == F.col("role_id")) & (F.col("achievement_ref") == F.col("achievement_id"))
    good = one.join(m, by_both).select(*made).unionByName(every.join(m, F.col("ref") == F.col("role_id")).select(*made))
    lost = one.join(m, by_both, "left_anti").unionByName(every.join(m, F.col("ref") == F.col("role_id"), "left_anti"))
    return good, lost.select("ref", "achievement_ref")


def draft_labels(tailored: DataFrame, master: DataFrame) -> DataFrame:
    """ref, achievement_ref, origin (C20): verbatim, reworded, or not-in-master for bullets whose role or achievement the master lacks. Columns as of ``resolve``."""
    good, dangling = resolve(tailored, master)
    return good.select(F.col("role_id").alias("ref"), F.col("achievement_id").alias("achievement_ref"), "origin").unionByName(dangling.withColumn("origin", F.lit("not-in-master")))


def structural_problems(drafts: DataFrame, experience: DataFrame, skills: DataFrame) -> DataFrame:
    """doc, problem: what is missing in drafts (C21), as a draft that was cut off has it.

    ``drafts``: doc, summary; ``experience``: doc, position, ref, listed (whether
    it lists achievements), achievement_position, achievement_ref; ``skills``:
    doc, position, grp. Positions count from 0. A role that lists nothing has all.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    at = lambda name, c: F.concat(F.lit(f"{name}["), F.col(c).cast("string"), F.lit("]"))
    found = drafts.filter(blank("summary")).select("doc", F.lit("no summary").alias("problem"))
    found = found.unionByName(drafts.join(experience.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit("no experience").alias("problem")))
    roles = experience.filter(blank("ref")).select("doc", F.concat(at("experience", "position"), F.lit(" has no ref")).alias("problem")).distinct()
    bullets = experience.filter(F.col("listed") & ~blank("ref") & blank("achievement_ref")).select("doc", F.concat(at("experience", "position"), F.lit("."), at("achievements", "achievement_position"), F.lit(" has no ref")).alias("problem"))
    groups = skills.filter(blank("grp")).select("doc", F.concat(at("skills", "position"), F.lit(" has no group")).alias("problem"))
    return found.unionByName(roles).unionByName(bullets).unionByName(groups)


def restore_required(drafted: DataFrame, required: DataFrame) -> DataFrame:
    """Drafted items with missing required ones put back (C13, U6): each behind the last drafted item that the master has before it. Columns: doc, item, ordinal (drafted); item, ordinal, required (master: at most MAX_FACTS rows).

    A document's items are compared with the master's in one array each.
    """
    if required.limit(MAX_FACTS + 1).count() > MAX_FACTS:
        raise ValueError("too many items in the master")
    items = required.agg(F.collect_list(F.struct("item", "ordinal", "required")).alias("a")).select("a").scalar()
    per = drafted.groupBy("doc").agg(F.collect_list(F.struct("item", "ordinal")).alias("own")).withColumn("master", items)
    place = lambda item: F.get(F.filter("master", lambda m: m["item"] == item), F.lit(0))["ordinal"]
    own = F.transform("own", lambda x: F.struct(x["ordinal"].cast("double").alias("k"), F.lit(False).alias("restored"), F.lit(0).alias("m"), x["item"].alias("item"), place(x["item"]).alias("at")))
    per = staged(per, own=own)
    missing = F.filter("master", lambda m: m["required"] & ~F.exists("own", lambda x: x["item"] == m["item"]))
    behind = lambda m: F.coalesce(F.array_max(F.transform(F.filter("own", lambda x: x["at"] < m["ordinal"]), lambda x: x["k"])), F.lit(-1.0))
    back = F.transform(missing, lambda m: F.struct(behind(m).alias("k"), F.lit(True).alias("restored"), m["ordinal"].cast("int").alias("m"), m["item"].alias("item"), m["ordinal"].alias("at")))
    every = per.select("doc", F.posexplode(F.array_sort(F.concat("own", back))).alias("position", "x"))
    return every.select("doc", F.col("x.item").alias("item"), (F.col("position") + 1).alias("position"), F.col("x.restored").alias("restored"))


def unsupported(items: DataFrame, facts: list[str]) -> DataFrame:
    """Skill items that the master's facts (its skills, tags, metrics, project names) do not support (C12): neither a form of the item nor forms of all its words occur in them. ``items``: item; blank ones are left out."""
    known: set[str] = set()
    _sendable(" ".join(facts))
    for fact in facts:
        for part in (t.normalise(fact), *t.tokens(fact)):
            known |= t.variants(part) if part else set()

    @F.pandas_udf("boolean")
    def lacks(item: pd.Series) -> pd.Series:
        flat = item.map(t.normalise)
        return ~flat.map(lambda x: bool(t.variants(x) & known) or (bool(x) and all(t.variants(w) & known for w in x.split()))).astype(bool)

    return items.filter(F.trim(F.coalesce("item", F.lit(""))) != "").filter(lacks("item"))


# What a verification can find, and the mode that it counts as; answers that find nothing.
FAILURES = {"unsupported_refs": "unsupported_ref", "invented_metrics": "invented_metric", "fabricated_claims": "fabricated_claim"}
NOTHING = r"(?i)^(?:(?:none|n/?a|no|nothing)\s*[.!]?\s*$|(?:none|n/?a|nothing)\s*[.!:]\s)"


def failure_modes(verifications: DataFrame) -> DataFrame:
    """doc, mode of findings that name a problem (C18). ``verifications``: doc, unsupported_refs, invented_metrics, fabricated_claims."""
    found = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.trim(F.coalesce(c, F.lit(""))).rlike(NOTHING)
    modes = F.array_compact(F.array(*(F.when(found(c), F.lit(m)) for c, m in FAILURES.items())))
    return verifications.select("doc", F.explode(modes).alias("mode"))


RANKS = {"reject": 0, "unknown": 1, "revise": 2, "accept": 3}


def escalation(attempts: DataFrame) -> DataFrame:
    """doc, chosen: the retry only where its verdict ranks strictly higher (C19). Columns: doc, first, retry."""
    rank = lambda c: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in RANKS.items()), F.lit(RANKS["unknown"]))
    return attempts.select("doc", F.when(F.col("retry").isNotNull() & (rank("retry") > rank("first")), "retry").otherwise("first").alias("chosen"))


def best_sibling(url_chars: DataFrame, gain: int = 600) -> DataFrame:
    """url, better, chars (O5): of a cluster (root) the longest other text if it has ``gain`` characters more; ties by url."""
    top = url_chars.groupBy("root").agg(F.min(F.struct((-F.col("chars")).alias("n"), "url")).alias("m")).select("root", F.col("m.url").alias("better"), (-F.col("m.n")).alias("better_chars"))
    return url_chars.join(top, "root").filter((F.col("better") != F.col("url")) & (F.col("better_chars") - F.col("chars") >= gain)).select("url", "better", "better_chars")


def signal_block() -> Column:
    """The screening signals of an enriched row as text for a reader."""
    return F.concat_ws("\n", F.concat(F.lit("Language: "), "language_tier", F.coalesce(F.concat(F.lit(" ("), "language_hits", F.lit(")")), F.lit(""))), F.concat(F.lit("Clearance: "), "clearance_status", F.coalesce(F.concat(F.lit(" — "), "clearance_evidence"), F.lit(""))), F.when(F.col("employment_type") == "contract", F.concat(F.lit("Rate: "), "rate_verdict", F.lit(" — "), "rate_reason")))
