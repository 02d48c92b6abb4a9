"""Terms, CV scans, gaps, suggestions and the text of pages against brute force: posting by posting, word by word, pair by pair."""

import html
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.functions import terms as T
from jobloom.functions.lexicon import Lexicon
from jobloom.operators import coverage
from jobloom.plans import registry
from jobloom.sources import pages
from tests.conftest import DATA

LEX = Lexicon()
ADVERT = "Intro\n\nRequirements\n\n- Java, Docker and automated testing\n- Test plans, test strategies\n\nWhat you will do\n\n- Jenkins pipelines\n\nNice to have\n\n- Helm\n"
#: url, title, company, text: nulls, empty, repeated and long texts, an employer named after a skill, one term by two surfaces.
EDGES = [
    ("n", None, None, None), ("e", "", "", ""), ("t", "Java Tester", None, None), ("a", "QA Engineer", "Acme", ADVERT), ("a2", "QA Engineer", "Acme", ADVERT), ("j", "QA", "Java Docker Ltd", ADVERT + "java java"),
    ("s", "QA", "Bee", "Requirements\n\n- Automation testing of unit tests, continuous integration\n- ci cd and CI/CD\n\n" + "calm " * 300), ("s2", "QA", "Bee", "Requirements\n\n- automated testing, Groovy\n\n" + "calm " * 300),
    ("l", "Senior SDET", "Cee", ADVERT * 60), ("b", "QA", "Dee", "RESTING apitesting test  plan's «éà» C++ .net -- Spock's x"), ("h", "QA", "Eee", "Why us?\n\nREQUIREMENTS:\nPython; Kafka.\n\nBenefits\n\nJava"), ("o", "QA", "Fee", "Duties:\n\n" + "Groovy and Spock. " * 200),
]
FACTS = [("r1", f"a{i}", x, tags, metrics) for i, (x, tags, metrics) in enumerate([
    ("Groovy and Spock for contract tests.", ["x"], []), ("Test engineer. Java, JUnit and Maven suites for payment services.", None, None), ("Ran the automation testing of a bank", [], ["docker"]), ("automated testing", None, []),
    ("Python scripts for stakeholder management", ["kafka"], None), ("Ruby on Rails", [], []), ("Ruby on Rails", [], []), ("", ["Docker"], []),
])]


def phrase_forms(phrase):
    return [phrase[:-1] + "ies", phrase] if phrase.endswith("y") else [phrase + "s", phrase]


def count(text, stop):
    """term -> [count, skill, capitalised, surfaces], phrases first and cut out, then words one by one."""
    out = defaultdict(lambda: [0, False, False, set()])
    named = {w.lower().strip(".'-") for w in re.findall(r"\b[A-Z][A-Za-z0-9+#.\-]*", text)}
    low, plain = T.normalise(text), "abcdefghijklmnopqrstuvwxyz0123456789"
    for phrase in sorted((p for p in LEX.skills if " " in p), key=lambda p: (-len(p), p)):
        at = 0 if phrase[:-1] in low else len(low)
        while at < len(low):
            hit = next((f for f in phrase_forms(phrase) if low.startswith(f, at) and low[at - 1 : at] not in [*plain] and low[at + len(f) : at + len(f) + 1] not in [*plain]), None)
            if hit is None:
                at += 1
                continue
            low, at = low[:at] + " " + low[at + len(hit) :], at + 1
            x = out[LEX.skills[phrase]]
            x[0], x[1] = x[0] + 1, True
            x[3].add(phrase)
    for raw in low.split():
        w = raw.strip(".'-")
        skill = w in LEX.skills
        word = w not in LEX.boilerplate and (re.fullmatch("[a-z]{2,6}", w) or len(w) >= 4 and re.search("[a-z]", w))
        if w and w not in LEX.stop and w not in stop and (skill or word):
            x = out[LEX.skills.get(w, w)]
            x[0], x[1], x[2] = x[0] + 1, x[1] or skill, x[2] or w in named
            x[3].add(w)
    return dict(out)


def found(title, company, text):
    """One dict a term: count, weight, section, skill, priority, surfaces, req."""
    own = re.findall("[a-z0-9]+", (company or "").lower())
    first = "".join(w[0] for w in own)
    stop = {*(w for w in own if len(w) > 2), *([first] if 2 <= len(first) <= 4 else [])}
    parts = T.sections(text or "")
    asked = {w.strip(".'-") for k in ("requirements", "duties") for w in T.normalise(parts[k]).split()}
    stop -= {w for w in stop if w in asked and w in LEX.skills}
    by = {k: count(parts[k], stop) for k in ("requirements", "duties", "nice")}
    head = count(title or "", stop)
    terms = head | by["duties"] | by["nice"] | count(text or "", stop)
    out = {}
    for term, (n, skill, capital, surfaces) in terms.items():
        r, d, o = (by[k][term][0] if term in by[k] else 0 for k in ("requirements", "duties", "nice"))
        weight = 3 * r + 1.5 * d + n + 0.5 * o
        section = "requirements" if r else "duties" if d else "nice-to-have" if o else "mentioned"
        priority = term in head or (weight >= 2.5 if skill else capital and r + d > 0)
        out[term] = {"count": n, "weight": weight, "section": section, "skill": skill, "priority": priority, "surfaces": sorted(surfaces), "req": r}
    return out


def told(rows, cv, master):
    """url -> (text, term -> dict with on_cv, in_master)."""
    looks = T.Present(cv), T.Present(master)
    out = {}
    for url, title, company, text in rows:
        terms = found(title, company, text)
        for term, x in terms.items():
            x["on_cv"], x["in_master"] = (look.has(term, x["surfaces"]) for look in looks)
        out[url] = (text or "", terms)
    return out


def scanned(text, terms):
    p = [x for x in terms.values() if x["priority"]]
    gaps = sum(not x["on_cv"] and x["skill"] and x["req"] > 0 and x["weight"] >= 2 for x in p)
    unreliable = "snippet" if len(text) < 1000 else None if any(x["section"] != "mentioned" for x in terms.values()) else "no_headings"
    share = 100 * sum(x["on_cv"] for x in p) / len(p) if p else 100.0
    every = 100 * sum(x["on_cv"] for x in terms.values()) / len(terms) if terms else 0.0
    verdict = "unknown" if unreliable else "fail" if gaps else "borderline" if share < 85 else "pass"
    return verdict, unreliable, round(share, 6), round(every, 6), gaps, len(terms)


def heading(x):
    if not x["priority"]:
        return "background"
    if x["on_cv"]:
        return "evidenced"
    if x["in_master"]:
        return "dropped"
    return "hard gap" if x["skill"] and x["req"] and x["weight"] >= 2 else "priority gap"


def proposed(terms, facts, cv, most=12):
    lines, out = cv.splitlines(), []
    for _, name, text, tags, metrics in facts:
        look = T.Present(" ".join([text, " ".join(tags or []), " ".join(metrics or [])]))
        closes = sorted(t for t, x in terms.items() if x["priority"] and not x["on_cv"] and x["in_master"] and look.has(t, x["surfaces"]))
        if closes:
            own = [w for w in map(T.stem_key, T.tokens(text)) if len(w) >= 4]
            share = max(sum(w in T.stemmed(line).split() for w in own) for line in lines) / len(own) if own else 0
            out.append((-sum(terms[t]["weight"] for t in closes), share >= 0.7, -len(closes), name))
    return [(name, "reword_achievement" if reword else "add_achievement", -w, k) for k, (w, reword, _, name) in enumerate(sorted(out)[:most], 1)]


def compare(rows, terms, scan, gaps, suggested, facts, cv, master):
    want = told(rows, cv, master)
    flat = lambda keys: sorted((u, t, *(x[k] for k in keys)) for u, (_, xs) in want.items() for t, x in xs.items())
    assert sorted(tuple(r) for r in terms.select("url", "term", "count", "weight", "section", "skill", "priority").collect()) == flat(("count", "weight", "section", "skill", "priority"))
    got = {r.url: (r.verdict, r.unreliable, round(r.priority_coverage, 6), round(r.all_term_coverage, 6), r.hard_gap_count, r.terms_found) for r in scan.collect()}
    assert got == {u: scanned(*x) for u, x in want.items()}
    assert sorted(map(tuple, gaps.select("url", "term", "heading", "weight", "section").collect())) == sorted((u, t, heading(x), x["weight"], x["section"]) for u, (_, xs) in want.items() for t, x in xs.items())
    wanted = sorted((u, *x) for u, (_, xs) in want.items() for x in proposed(xs, facts, cv))
    assert sorted(map(tuple, suggested.select("url", "achievement_id", "kind", "weight_closed", "rank").collect())) == wanted
    return got, wanted


def test_edges_equal_brute_force(spark):
    cv, master = "Java checks.\nTest engineer for payment services, JUnit suites.", "Java, Docker, Kafka. " + " ".join(f[2] for f in FACTS)
    rows = spark.createDataFrame(EDGES, "url string, title string, company string, post_text string").repartition(3)
    facts = spark.createDataFrame(FACTS, "role_id string, achievement_id string, text string, tags array<string>, metrics array<string>")
    marked = coverage.posting_terms(rows, marks={"on_cv": cv, "in_master": master})
    suggested = coverage.suggestions(coverage.with_coverage(marked, cv, master), facts, cv)
    got, wanted = compare(EDGES, marked, coverage.scan(rows, cv, master), coverage.gap_report(marked, cv, master), suggested, FACTS, cv, master)
    assert {x[0] for x in got.values()} >= {"unknown", "fail"} and {x[1] for x in got.values()} >= {"snippet", None}
    assert {x[2] for x in wanted} <= {"add_achievement", "reword_achievement"} and wanted
    none = coverage.posting_terms(rows.limit(0), marks={"on_cv": cv, "in_master": master})
    assert none.count() == coverage.scan(rows.limit(0), cv, master).count() == coverage.suggestions(coverage.with_coverage(none, cv, master), facts, cv).count() == 0


def test_a_posting_is_closed_by_its_own_surfaces(spark):
    """A term's surface in one posting says nothing of another posting's."""
    rows = [("u1", "x", ["p"], 3.0), ("u2", "x", ["q"], 3.0)]
    frame = spark.createDataFrame(rows, "url string, term string, surfaces array<string>, weight double").withColumns({"kind": F.lit("closable"), "priority": F.lit(True), "on_cv": F.lit(False)})
    facts = spark.createDataFrame([("r", "a", "q", None, None)], "role_id string, achievement_id string, text string, tags array<string>, metrics array<string>")
    assert [r.url for r in coverage.suggestions(frame, facts, "nothing").collect()] == ["u2"]


def test_queries_equal_brute_force(spark):
    rows = [tuple(r) for r in registry._adverts(spark, DATA).select("url", "title", "company", "post_text").collect()]
    facts = [("r1", f"a{i}", x, ["tag"], []) for i, x in enumerate(registry.MASTER.splitlines())]
    run = lambda name: registry.QUERIES[name](spark, DATA)
    compare(rows, run("posting_terms"), run("cv_scan"), run("gap_report"), run("suggestions"), facts, registry.CV, registry.MASTER)


def text_of(page):
    """Text by a pattern of tags; what is in dropped elements goes, its line breaks too."""
    out, inside, bullet = "", 0, False
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", "", page or "")
    page = re.sub(r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", r"\1\3", page)
    for token in re.findall(r"(?s)<[^>]*>|[^<]+", page):
        tag = re.match(r"<(/?)([a-zA-Z0-9]+)", token)
        if tag is None:
            said = html.unescape(token)
            out += "" if inside else said.lstrip() if bullet else said
            bullet &= bool(inside)
            continue
        name, begins = tag[2].lower(), not tag[1] and not token.endswith("/>")
        if name in ("script", "style", "noscript", "template", "svg", "head"):
            inside = max(0, inside + 1 if begins else inside - 1)
        elif not inside and name in "p div section article ul ol li br tr td th table h1 h2 h3 h4 h5 h6 blockquote pre".split():
            out += "\n- " if name == "li" and begins else "\n"
            bullet = name == "li" and begins or bullet and name != "li"
    lines = [x.strip() for x in out.split("\n")]
    kept = [x for k, x in enumerate(lines) if x or k == 0 or lines[k - 1]]
    return "\n".join(kept).strip()


@pytest.mark.parametrize("page", ["", "<p>a</p><script>if (a < b) {}</script><ul><li>b &amp; c</li></ul>", "<button>x<div>y</div></button>z<br/><svg><p>q</p></svg>" * 30, "<DIV>A<span> b</span></DIV><!-- <p>no</p> -->&#163;5", "<head><p>no</p></head><ul><li>  a<li><p> b</p></ul><pre>c  d</pre>"])
def test_text_of_small_pages(page):
    assert pages.html_text(page) == text_of(page)


def test_text_of_pages_equals_brute_force(spark):
    want = {r.page_id: text_of(r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in registry.QUERIES["page_html_text"](spark, DATA).collect()} == want


def by_patterns(phrases, text):
    """Phrases masked by one pattern after another."""
    out = []
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        body = re.escape(p[:-1]) + "(?:y|ies)" if p.endswith("y") else re.escape(p) + "s?"
        text, n = re.subn(rf"(?<![a-z0-9]){body}(?![a-z0-9])", " ", text)
        if n:
            out.append((p, n))
    return text, out


def test_phrases_are_masked_as_by_patterns():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abs.#+y") for _ in range(r.randint(1, 3)))
    for _ in range(300):
        phrases = list({" ".join(word() for _ in range(r.randint(2, 3))) for _ in range(30)})
        phrases = [p for p in phrases if not re.search(r"[^a-z0-9\s] [^a-z0-9\s]", p)]
        bits = [r.choice([word(), r.choice(phrases), r.choice(phrases) + "s", r.choice(phrases)[:-1] + "ies"]) for _ in range(40)]
        text = "".join(b + r.choice([" ", " ", "", "."]) for b in bits)
        assert T.Phrases(phrases).masked(text) == by_patterns(phrases, text)
    assert T.Phrases([]).masked("a b") == ("a b", []) and T.Phrases(["a b"]).masked("") == ("", [])


def test_many_phrases_cost_no_more_than_few():
    import time

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    phrases = [" ".join(r.choice(words) for _ in range(2)) for _ in range(100_000)]
    texts = [" ".join([*(r.choice(words) for _ in range(300)), phrases[k % 100], phrases[k]]) for k in range(300)]
    took = []
    for few in (phrases[:100], phrases):
        found = T.Phrases(few)
        began = time.process_time()
        assert all(len(found.masked(t)[1]) >= 1 for t in texts)
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.2


def _posting_rows(extract, rows):
    """What each posting gives by itself."""
    return [[(k, v["count"], v["in_title"], tuple(sorted(v["surfaces"]))) for k, v in extract.posting(body, title, T.noise_terms(company)).items()] for title, company, body in rows]


@pytest.mark.parametrize(("most", "chars"), [(200_000, 20_000_000), (12, 20_000_000), (200_000, 300)])
def test_a_text_met_again_is_not_extracted_again(monkeypatch, most, chars):
    """Postings of one text give the same rows as each by itself, company's words aside; whatever is held."""
    monkeypatch.setattr(coverage._Seen, "MOST", most)
    monkeypatch.setattr(coverage._Seen, "CHARS", chars)
    extract, asked = T.Extractor(), []
    bodies = ["Requirements\n\n- Java, Selenium and Docker\n- C++ in pipelines", "Java shop. Acme-built foo-machine learning-bar tools", "", None]
    rows = [(title, f"{name} {k % 2}", bodies[k % 4]) for k in range(120) for title, name in (("Acme Test Engineer", "Acme Java Ltd"), ("QA Engineer", "Foo Bar"), ("QA Engineer", f"Nobody{k}"))]
    want = _posting_rows(extract, [(a, b, c or "") for a, b, c in rows])

    def posting(*args):
        asked.append(args)
        return extract.posting(*args)

    def told(found):
        flat = [(k, v["count"], v["in_title"], sorted(v["surfaces"])) for own in found for k, v in own.items()]
        return [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string())))]

    seen, got = coverage._Seen(posting, told, list("abcd")), []
    for at in range(0, len(rows), 40):
        title, company, body = (pa.array(x, pa.string()) for x in zip(*rows[at : at + 40], strict=True))
        sizes, out = seen.rows(title, company, pa.nulls(len(title), pa.string()), body)
        flat = [(x["a"], x["b"], x["c"], tuple(x["d"])) for x in out.to_pylist()]
        ends = sizes.cumsum()
        got += [flat[b - n : b] for b, n in zip(ends, sizes, strict=True)]
    assert got == want
    assert len(asked) <= (12 if most > 12 and chars > 300 else 12 * 9)
    assert seen.held.num_rows <= most + 40 * 12


def test_suggestions_extract_terms_once(spark):
    plan = registry.QUERIES["suggestions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_terms_without_surfaces_are_the_same(spark):
    """The scan and the gap report take no lists of surfaces."""
    rows = registry._adverts(spark, DATA).limit(40)
    marks = {"on_cv": registry.CV, "in_master": registry.MASTER}
    whole, bare = coverage.posting_terms(rows, marks=marks), coverage.posting_terms(rows, marks=marks, surfaces=False)
    assert set(whole.columns) - set(bare.columns) == {"surfaces"}
    assert sorted(map(str, whole.select(bare.columns).collect())) == sorted(map(str, bare.collect()))
    for name in ("cv_scan", "gap_report"):
        assert "surfaces" not in registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_read_as_their_plain_rules_say():
    quotes = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"})
    odd = ["", " ", "java", "Java", "C++", "node.js", "re-use", "x’y", "a–b—c", "“Q”", "É", "İstanbul", "ß", "ﬁn", "a\u00a0b", "a\x1cb", "tests-", "ITIES", "ab12", "ªb", "٣", "glasses", "processes", "markedly", "running", "add-ons", "the-ies", "eee"]
    for x in odd + [a + b for a in odd for b in odd]:
        want = " ".join(re.sub(r"[^a-z0-9+#.'\-\s]", " ", x.lower().translate(quotes)).split())
        assert T.normalise(x) == want
        for word in want.split():
            forms = {word, T.stem(word), T.stem_key(word)}
            for f in [f for f in forms if "-" in f]:
                forms |= {f.replace("-", ""), f.replace("-", " "), *f.split("-")}
            assert T.variants(word) == forms - {""}
            fits = [(a, b) for a, b in T._SUFFIXES if len(word) > 3 and word.endswith(a) and len(word) - len(a) >= 3]
            assert fits or T.stem(word) == word
    of = lambda name: re.findall("[a-z0-9]+", (name or "").lower())
    for a in (None, "", "Acme", "Bee Sea Dee", "A B", "Éa Ltd", "One two three four five"):
        for b in (None, "", "Re Cruit", "HR"):
            own = "".join(w[0] for w in of(a))
            assert T.noise_terms(a, b) == frozenset(w for w in (*of(a), *of(b)) if len(w) > 2) | ({own} if 2 <= len(own) <= 4 else set())
