"""Duplicates, mutations, arrivals, the incremental run and coverage on small tables."""

import itertools
import json
import random
import time

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from jobloom import folders, schemas
from jobloom.functions import terms as T
from jobloom.functions import text
from jobloom.operators import arrivals, audit, board, coverage, duplicates, screen, store
from jobloom.plans import registry, responses
from jobloom.sources import boards, pages
from jobloom.streaming import ingest
from tests.conftest import DATA


def postings(spark, rows):
    return spark.createDataFrame([(f"u{i}", c, t, place, f"2026-01-{i + 1:02d}", i) for i, (c, t, place) in enumerate(rows)], "url string, company string, title string, location string, fetched_at string, ordinal long")


def test_clusters_are_anchored_to_their_root(spark):
    p = postings(spark, [("Acme", "QA Engineer", "London"), ("Acme Ltd", "QA Engineer X2", "UK"), ("Acme", "QA Engineer", "Bristol"), ("Acme", "QA Engineer", "Leeds"), ("Acme", "Principal QA Engineer", "London"), (None, "QA", "London")])
    got = sorted((r.root, r.url) for r in duplicates.clusters(p).collect())
    assert got == [("u0", "u0"), ("u0", "u1")]
    links = {r.url: r.original for r in duplicates.originals(p, p).collect()}
    assert links == {"u1": "u0", "u2": "u1", "u3": "u1"}  # a link may end at a duplicate


def test_clusters_do_not_depend_on_partitions(spark):
    places = ["London", "UK", "Bristol", "Remote", "Leeds", "London, UK", "Ankara", "Ankara"]
    p = postings(spark, [("Acme", "QA", x) for x in places])
    a = sorted(map(tuple, duplicates.clusters(p).collect()))
    assert a == sorted(map(tuple, duplicates.clusters(p.repartition(7)).collect()))


def test_statuses_are_inherited_and_spread(spark):
    details = spark.createDataFrame([("a", None, "1"), ("b", "a", "2"), ("c", "a", "3"), ("d", None, "4")], "url string, duplicate_of string, fetched_at string")
    statuses = spark.createDataFrame([("b", "applied", None, "t", None)], schemas.USER_STATUS)
    got = {(r.url, r.my_status, r.inherited_from) for r in duplicates.inheritances(details, statuses).collect()}
    assert got == {("a", "applied", "b"), ("c", "applied", "b")}
    decided = spark.createDataFrame([("a", "skipped"), ("d", None)], "url string, my_status string")
    after = {r.url: (r.my_status, r.inherited_from) for r in store.save_status(statuses, details, decided, "now").collect()}
    assert after == {"a": ("skipped", None), "b": ("applied", None), "c": ("skipped", "a"), "d": (None, None)}


def test_mutations(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "url string, n int, s string")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "url string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.replace(old, new)) == [("a", 1, "x"), ("b", 5, None), ("c", 6, None)]
    assert rows(store.insert_new(old, new.withColumn("s", F.lit("n")))) == [("a", 1, "x"), ("b", 2, None), ("c", 6, "n")]
    assert rows(store.update(old, new, ["n"])) == [("a", 1, "x"), ("b", 5, None)]
    assert rows(store.upsert(old, new, ["n"])) == [("a", 1, "x"), ("b", 5, None), ("c", 6, None)]
    with pytest.raises(ValueError):
        store.upsert(old, new, ["s"])
    with pytest.raises(ValueError):
        schemas.conform(old, schemas.USER_STATUS)
    events = spark.createDataFrame([("m", "1", "a"), ("m", "2", "b"), ("n", "1", "c")], "mode string, at string, evidence string")
    assert rows(store.lessons(events)) == [("m", 2, "1", "2", "2", "b"), ("n", 1, "1", "1", None, "c")]


def brute_new(batch, seen):
    urls, keys, out = {u for u, _ in seen}, {k for _, k in seen}, []
    for u, k in batch:
        if u not in urls and k not in keys:
            urls.add(u)
            keys.add(k)
            out.append((u, k))
    return out


def test_arrivals_are_sequential(spark):
    for seed in range(3):
        batch = [(f"u{(i * 7 + seed) % 5}", f"k{(i * i + seed) % 4}") for i in range(14)]
        rows = spark.createDataFrame([(u, k, "", "", i) for i, (u, k) in enumerate(batch)], "url string, company string, title string, location string, ordinal long")
        seen = spark.createDataFrame([("u9", "k3::::")], "url string, company_title_key string")
        got = [(r.url, r.company_title_key) for r in arrivals.new_postings(rows, seen).orderBy("ordinal").collect()]
        assert got == brute_new([(u, f"{k}::::") for u, k in batch], [("u9", "k3::::")])


def sized(rows, spark):
    return spark.createDataFrame([(u, k, "", "", i) for i, (u, k) in enumerate(rows)], "url string, company string, title string, location string, ordinal long")


def chain(n):
    """Each row shares its url with the one before or its key with it, so that every second row is new."""
    return [(f"u{(i + 1) // 2}", f"k{i // 2}") for i in range(n)]


@pytest.mark.parametrize("kind", ["no url", "chain", "mixed"])
def test_arrivals_take_as_many_jobs_for_long_chains(spark, tmp_path, kind):
    r = random.Random(6)
    batch = {"no url": [(None, f"k{r.randrange(60)}") for _ in range(10_000)], "chain": chain(10_000), "mixed": [(r.choice([None, f"u{r.randrange(300)}"]), f"k{r.randrange(400)}") for _ in range(3000)] + [(f"v{u}", k) for u, k in chain(64)] + [("hot", f"h{i}") for i in range(900)]}[kind]
    seen = [("u9", "k3::::"), (None, "k5::::")]
    got = arrivals.new_postings(sized(batch, spark), spark.createDataFrame(seen, "url string, company_title_key string"), f"file://{tmp_path}/rounds")
    urls, keys, want = {u for u, _ in seen if u}, {k for _, k in seen}, []
    for i, (u, k) in enumerate(batch):
        if u not in urls and f"{k}::::" not in keys:
            want.append(i)
            keys.add(f"{k}::::")
            if u is not None:
                urls.add(u)
    assert [x.ordinal for x in got.orderBy("ordinal").collect()] == want
    tables = [x for x in tmp_path.rglob("_SUCCESS")]
    assert len(tables) <= (3 if kind == "no url" else 26)


def test_components(spark, tmp_path):
    from jobloom.operators.components import components

    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 300 + i) for i in range(50)] + [(901, 900), (900, 901), (902, 902)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {i: 1 for i in range(1, 201)} | {300 + i: 300 for i in range(50)} | {500: 300, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/none").count() == 0


def test_batches_rewrite_only_their_buckets(spark, tmp_path):
    def rows(numbers):
        listed = [(f"u{i}" if i % 17 else None, f"Company {i % 40}", f"QA Engineer {i}", "London", "We test Java services. Active SC clearance is required." if i % 3 else "We test Java services.", i) for i in numbers]
        frame = spark.createDataFrame(listed, "url string, company string, title string, location string, description string, ordinal long")
        return frame.select(*(F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.POSTING), "ordinal")

    state = ingest.State(spark, f"file://{tmp_path}/state", buckets=64, keep=2)
    first, second = rows(range(1, 300)), rows([*range(1, 6), *range(300, 306)])
    state.commit(ingest.run_batch(state.tables(), first, "2026-01-01 00:00:00"), "s#0")
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "state/data").rglob("part-*.parquet")}
    before = files()
    whole = {k: sorted(map(str, v.collect())) for k, v in ingest.run_batch(state.tables(), second, "2026-01-02 00:00:00").items()}
    only = state.touched(second)
    assert 0 < len(only) <= 11
    seen_totals = Observation("run")
    state.commit(ingest.run_batch(state.tables(), second, "2026-01-02 00:00:00", own=state.tables(only), totals=seen_totals), "s#1", only)
    after = files()
    assert {p: t for p, t in after.items() if p in before} == before
    written = {p.split("bucket=")[1].split("/")[0] for p in set(after) - set(before)}
    assert written <= set(map(str, only))
    assert {k: sorted(map(str, v.collect())) for k, v in state.tables().items()} == whole
    # Totals come from the run itself.
    new = arrivals.new_postings(second, ingest.State(spark, f"file://{tmp_path}/none").tables()["seen_jobs"].unionByName(spark.createDataFrame([(f"u{i}", "", "", "", "") for i in range(1, 6)], schemas.SEEN_JOBS)))
    assert seen_totals.get == audit.run_totals(screen.enrich(new)).first().asDict() and seen_totals.get["clearance_only"] > 0
    # Old versions go, with the buckets that only they name.
    for k in (2, 3):
        state.commit(ingest.run_batch(state.tables(), second, f"2026-01-0{k} 00:00:00", own=state.tables(only)), f"s#{k}", only)
    assert state.done("s#3") and state.done("s#1") and not state.done("s#4")
    assert sorted(p.name for p in (tmp_path / "state/versions").iterdir() if not p.name.startswith(".")) == ["2", "3"]
    assert not set(after) - set(before) & set(files()) or len(files()) < len(after)
    with pytest.raises(ValueError):
        state.commit(ingest.run_batch(state.tables(), first, "2026-01-09 00:00:00"), "s#4", only)


def test_polled_boards_survive_restarts(spark, tmp_path):
    """Each stored poll is read once, over three starts of the stream, one of them after a batch that failed."""
    job = lambda k: {"title": f"QA Engineer {k}", "absolute_url": f"g{k}", "location": {"name": "London"}, "first_published": None, "updated_at": "2026-01-01", "content": "We test Java services."}
    poll = lambda n, ks, board="acme": (tmp_path / f"greenhouse-{board}.{n}.json").write_text(json.dumps({"jobs": [job(k) for k in ks]}))
    spark.dataSource.register(boards.BoardSource)
    listed = [{"name": "Acme", "ats": "greenhouse", "slug": "acme"}, {"name": "Bee", "ats": "greenhouse", "slug": "bee"}]
    state, polls, fail = ingest.State(spark, f"file://{tmp_path}/state", buckets=8), [], [False]

    def each(raw, number):
        polls.append((number, sorted(len(json.loads(r.body)["jobs"]) for r in raw.collect())))

    def run():
        source = lambda: spark.readStream.format("jobboards").option("boards", json.dumps(listed)).option("files", str(tmp_path)).load()
        raw = source().writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/raw").trigger(availableNow=True).start()
        raw.awaitTermination()

        def clock():
            if fail[0]:
                raise RuntimeError("lost")
            return "2026-01-01 00:00:00"

        q = ingest.start(boards.parse(source()).select(*schemas.POSTING.names), state, f"{tmp_path}/ck", clock, availableNow=True)
        q.awaitTermination()

    poll(0, [1, 2])
    poll(0, [7], "bee")
    run()
    poll(1, [2, 3])
    poll(2, [3, 4, 5])
    fail[0] = True
    with pytest.raises(Exception, match="lost"):
        run()
    fail[0] = False
    poll(3, [])
    run()
    assert [p for _, p in polls] == [[1, 2], [2, 3], [0]]
    seen = [r.url for r in state.tables()["seen_jobs"].collect()]
    assert sorted(seen) == ["g1", "g2", "g3", "g4", "g5", "g7"]


def test_landed_polls_are_read_again(monkeypatch, tmp_path):
    asked = []

    def get(url, body=None):
        asked.append(url)
        if "bad" in url:
            raise OSError("no route, app_key=secret&x=1")
        return json.dumps({"jobs": [], "n": len(asked)})

    monkeypatch.setattr(boards, "http_get", get)
    listed = [{"name": "A", "ats": "greenhouse", "slug": "a"}, {"name": "B", "ats": "lever", "slug": "bad"}, {"name": "C", "ats": "adzuna", "params": {"what": "qa"}}]
    for k in ("APP_ID", "APP_KEY"):
        monkeypatch.setenv(f"ADZUNA_{k}", "x")
    options = {"boards": json.dumps(listed), "landing": f"file://{tmp_path}/landing", "every": "3600", "max_days_old": "14"}
    with pytest.raises(ValueError):
        boards.BoardStream({"boards": "[]"})
    stream = boards.BoardStream(options)
    start, end = stream.initialOffset(), stream.latestOffset()
    assert set(start) == {"greenhouse-a", "lever-bad", "adzuna-C"} and all(end[k] - start[k] == 1 for k in end)
    parts = stream.partitions({"greenhouse-a": start["greenhouse-a"] - 40}, end)
    assert [(p.board["slug"] if "slug" in p.board else None, p.poll) for p in parts] == [("a", end["greenhouse-a"] - 1), ("bad", end["lever-bad"] - 1), (None, end["adzuna-C"] - 1)]
    once = [list(stream.read(p)) for p in parts]
    assert len(asked) == 3 and "max_days_old=14" in asked[2] and once[1][0][3] is None and "secret" not in once[1][0][4]
    again = boards.BoardStream(options)
    assert [list(again.read(p)) for p in parts] == once and len(asked) == 3
    again.commit(start)
    assert len(list((tmp_path / "landing").iterdir())) == 3
    again.commit(end)
    assert not list((tmp_path / "landing").iterdir())
    assert stream.partitions(end, end) == []


def test_a_version_is_made_once(spark, tmp_path):
    final, uri = tmp_path / "7", f"file://{tmp_path}"
    for k in (1, 2):
        (tmp_path / f"_{k}").write_text(str(k))
        assert folders.appear(spark, f"{uri}/_{k}", f"{uri}/7") is (k == 1)
    assert final.read_text() == "1" and [p.name for p in tmp_path.iterdir()] == ["7"]


def test_incremental_runs_equal_one_batch(spark, tmp_path):
    p = [("greenhouse", "Acme", "QA Engineer", "London"), ("lever", "Acme", "QA Engineer", "UK"), ("lever", "Bee", "SDET", "London"), ("lever", "Acme", "QA Engineer", "London"), ("lever", "Bee", "SDET", "London")]
    rows = [(f"u{i}", c, t, place, None, "We test Java services.", "unknown", None, None, None, s, i) for i, (s, c, t, place) in enumerate(p)]
    schema = schemas.struct(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.POSTING) + ", ordinal long")
    frame = spark.createDataFrame(rows, schema)
    once = ingest.State(spark, f"file://{tmp_path}/once")
    once.commit(ingest.run_batch(once.tables(), frame, "2026-01-01 00:00:00"))
    frame.write.partitionBy("source").mode("overwrite").parquet(f"{tmp_path}/unused")
    steps = ingest.State(spark, f"file://{tmp_path}/steps")
    for k, part in enumerate(itertools.batched(rows, 2)):
        spark.createDataFrame(list(part), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = ingest.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), steps, f"{tmp_path}/ck", lambda: "2026-01-01 00:00:00", availableNow=True)
        q.awaitTermination()
    look = lambda s: sorted((r.url, r.duplicate_of, r.passed_filters) for r in s.tables()["job_details"].collect())
    assert look(once) == look(steps)
    assert [u for u, *_ in look(once)] == ["u0", "u1", "u2"]


def test_a_new_checkpoint_goes_on_from_the_last_version(spark, tmp_path):
    columns = "url string, company string, title string, location string"
    state = ingest.State(spark, f"file://{tmp_path}/state")
    feed = lambda k, rows: schemas.conform(spark.createDataFrame(rows, columns), schemas.POSTING).coalesce(1).write.parquet(f"{tmp_path}/{k}/x")

    def run(k, checkpoint):
        q = ingest.start(spark.readStream.schema(schemas.POSTING).parquet(f"{tmp_path}/{k}/*"), state, f"{tmp_path}/{checkpoint}", lambda: "2026-01-01 00:00:00", availableNow=True)
        q.awaitTermination()

    feed("a", [("u1", "Acme", "QA Engineer", "London"), ("u2", "Bee", "SDET", "London")])
    run("a", "ck1")
    assert state.current() == 0
    feed("b", [("u3", "Cee", "Tester", "London"), ("u1", "Acme", "QA Engineer", "London")])
    run("b", "ck2")  # its first batch has number 0 again
    assert state.current() == 1 and sorted(r.url for r in state.tables()["seen_jobs"].collect()) == ["u1", "u2", "u3"]
    assert {r.url: r.last_listed_at for r in state.tables()["job_details"].collect()} == {"u1": "2026-01-01 00:00:00", "u2": None, "u3": None}
    assert state.done(f"{tmp_path}/ck2#0") and not state.done(f"{tmp_path}/ck2#1")
    (tmp_path / "state/versions/2").write_text("")  # a writer that died
    assert state.current() == 1 and len(state.tables()["seen_jobs"].collect()) == 3


def test_numbers_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i % 7}", f"c{i}") for i in range(40)], "url string, company string")
    a, b = (sorted(map(tuple, ingest.numbered(rows.repartition(n), f"file://{tmp_path}/{n}").selectExpr("url", "company", "row_number() over (order by ordinal) as n").collect())) for n in (1, 5))
    assert a == b


def test_board_sorts_nulls_last(spark):
    rows = spark.createDataFrame([("a", None), ("b", 3), ("c", 9)], "url string, match_score int")
    assert [r.url for r in board.sort_board(rows).collect()] == ["c", "b", "a"]
    assert [r.url for r in board.sort_board(rows, descending=False).collect()] == ["b", "c", "a"]


ADVERT = """About us

We pay well.

Requirements

- Java and Selenium
- Azure DevOps
- Stakeholder management

What you will do

- Maintain pipelines in Jenkins
- Keep the suites honest

Nice-to-have

- Kubernetes
- Helm
"""


def test_terms_and_sections():
    got = T.Extractor().posting(ADVERT + "calm " * 10, "Java Engineer")
    assert got["java"]["in_requirements"] == 1 and got["java"]["in_title"]
    assert got["azure devops"]["in_requirements"] == 1 and got["jenkins"]["in_duties"] == 1 and got["kubernetes"]["in_nice"] == 1
    assert T.stem_key("pipelines") == T.stem_key("pipeline") and T.stem_key("warehousing") == T.stem_key("warehouse")
    cv = T.Present("Worked with stakeholder management, RestAssured and pipelines.")
    assert cv.has("stakeholder management") and cv.has("pipeline") and cv.has("rest-assured") is False or cv.has("restassured")
    assert not cv.has("docker")


def test_scan_verdicts(spark):
    long_text = ADVERT + "\ncalm words " * 120
    rows = spark.createDataFrame([("u1", "QA", "Acme", long_text), ("u2", "QA", "Acme", "short"), ("u3", "QA", "Acme", "calm words " * 200), ("u4", None, None, None)], "url string, title string, company string, post_text string")
    full = "Java Selenium Azure DevOps stakeholder management Jenkins pipelines Kubernetes Helm QA Maintain Keep"
    got = {r.url: (r.verdict, r.unreliable) for r in coverage.scan(rows, full, full).collect()}
    assert got == {"u1": ("pass", None), "u2": ("unknown", "snippet"), "u3": ("unknown", "no_headings"), "u4": ("unknown", "snippet")}
    part = coverage.scan(rows.filter("url = 'u1'"), "Selenium", full).first()
    assert part.verdict == "fail" and "java" in part.hard_gaps and "java" in part.closable


def test_boards_are_parsed(spark, tmp_path):
    bodies = {
        "greenhouse": '{"jobs": [{"title": "QA", "absolute_url": "g1", "location": {"name": "London"}, "first_published": null, "updated_at": "2026-01-01", "content": "x"}]}',
        "lever": '[{"text": "QA", "hostedUrl": "l1", "createdAt": 1758000000000, "categories": {"location": "A", "allLocations": ["A", "B"]}}]',
        "workable": '{"jobs": [{"title": "QA", "url": "w1", "telecommuting": true, "locations": [{"city": "Leeds", "country": "UK", "hidden": false}, {"city": "X", "hidden": true}]}]}',
        "adzuna": '{"results": [{"title": "QA", "redirect_url": "z1", "contract_type": "contract", "salary_max": 130000, "salary_is_predicted": "1", "company": {"display_name": "Acme"}}]}',
        "smartrecruiters": '{"content": [{"name": "QA", "id": "7", "location": {"city": "Oslo", "country": "no"}}]}',
    }
    for k, v in bodies.items():
        (tmp_path / f"{k}-s.json").write_text(v)
    spark.dataSource.register(boards.BoardSource)
    listed = [{"name": "Acme", "ats": k, "slug": "s"} for k in [*bodies, "ashby"]]
    raw = spark.read.format("jobboards").option("boards", json.dumps(listed)).option("files", str(tmp_path)).load()
    got = {r.url: r for r in boards.parse(raw).collect()}
    assert got["g1"].posted_at == "2026-01-01" and got["l1"].location == "A, B" and got["w1"].location == "Remote (Leeds, UK)"
    assert got["z1"].day_rate_max == 500.0 and got["z1"].day_rate_source == "estimated_by_adzuna"
    assert got["https://jobs.smartrecruiters.com/s/7"].location == "Oslo, NO"
    assert [r.ats for r in boards.failures(raw).collect()] == ["ashby"]


def test_fetches_stop_at_a_short_page():
    pages_ = iter(['{"content": [' + ",".join(["{}"] * 100) + "]}", '{"content": [{}]}'])
    assert len(list(boards.fetch_board("A", "smartrecruiters", "s", lambda _: next(pages_)))) == 2
    (row,) = boards.fetch_board("A", "nope", "s")
    assert row[3] is None and "unknown" in row[4]


def test_pages():
    html = '<h1 class="topcard__title">QA</h1><div class="show-more-less-html__markup"><p>a</p><script>x</script><ul><li>b</li></ul></div><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">Contract</span>'
    got = pages.job_page(html)
    assert got["title"] == "QA" and got["criteria"] == "Contract" and got["company"] is None
    assert "x" not in pages.html_text(html) and "- b" in pages.html_text(html)


def test_cv_documents(spark):
    master = spark.createDataFrame([("r1", "a1", "did x", 1), ("r1", "a2", "did y", 2)], "role_id string, achievement_id string, text string, ordinal int")
    tailored = spark.createDataFrame([("r1", "a1", "Did X!", 1), ("r1", "zz", None, 2), ("r9", None, None, 3)], "ref string, achievement_ref string, text string, position int")
    good, dangling = coverage.resolve(tailored, master)
    assert [(r.achievement_id, r.text, r.origin) for r in good.collect()] == [("a1", "Did X!", "reworded")]
    assert dangling.count() == 2
    drafted = spark.createDataFrame([("d", "a", 0), ("d", "c", 1)], "doc string, item string, ordinal int")
    required = spark.createDataFrame([("a", 0, True), ("b", 1, True), ("c", 2, False)], "item string, ordinal int, required boolean")
    assert [r.item for r in coverage.restore_required(drafted, required).orderBy("position").collect()] == ["a", "b", "c"]


def test_manual_rows_and_loaders(spark):
    from jobloom.operators import manual
    from jobloom.sources import loaders

    stored = schemas.conform(spark.createDataFrame([("u1", "Acme", "QA", "Leeds")], "url string, company string, title string, location string"), schemas.JOB_DETAILS)
    rows = schemas.conform(spark.createDataFrame([("u1", "Acme", "QA", "Leeds"), ("u2 ", "ACME", "qa", "leeds")], "url string, company string, title string, location string"), schemas.POSTING)
    details, report = manual.add(stored, rows, "2026-01-01 00:00:00")
    assert sorted((r.url, r.added, r.twin) for r in report.collect()) == [("u1", False, None), ("u2", True, "u1")]
    assert {r.url: r.passed_filters for r in details.collect()} == {"u1": None, "u2": True}
    assert loaders.registry(spark, [{"name": "A", "type": "adzuna", "params": {"what": 1}}]).first().params == {"what": "1"}
    assert loaders.cv_text(spark, "x", "2026-01-01 00:00:00", "2026-01-03 00:00:00").first().stale
    assert loaders.workday_endpoint("acme/Careers") == ("https://acme.wd3.myworkdayjobs.com", "acme", "Careers")
    for bad in ("nope", "acme.wd3.myworkdayjobs.com/acme/Careers", "acme/Careers/wd999", ""):
        with pytest.raises(ValueError):
            loaders.workday_endpoint(bad)
    pages_ = spark.createDataFrame([("Acme Ltd", "Welcome to Acme"), ("Big Blue", "blue and big"), ("Big Blue", "x")], "c string, p string")
    assert [r.x for r in pages_.select(loaders.names_agree(F.col("c"), F.col("p")).alias("x")).collect()] == ["strong", "weak", "none"]


def test_drafts_get_back_what_they_left_out(spark):
    from jobloom.operators import drafts

    schema = f"doc string, owner string, experience {drafts.ROLES}, extra int"
    b = lambda *refs: [(x, None) for x in refs]
    rows = [("kept", "o", [("r2", b("b", "a")), ("r1", None)], 1), ("empty", "o", [("r1", []), ("r3", b("x"))], 2), ("unknown", "o", [("zz", b("q")), ("r2", b("b", "zz"))], 3), ("none", "o", None, 4), ("no roles", "o", [], 5), ("no master", "p", [("r1", b("a"))], 6), ("text", "o", [("r1", [("k", "reworded")]), ("r2", None), ("r3", None)], 7)]
    roles = [("r1", "One", ["k", "l"]), ("r2", "Two", ["a", "b", "c"]), ("r3", "Three", [])]
    masters = spark.createDataFrame([("o", roles)], "owner string, roles array<struct<id:string,company:string,achievements:array<string>>>")
    got = {r.doc: (r.experience and [(x.ref, x.achievements and [tuple(a) for a in x.achievements]) for x in r.experience], r.notes) for r in drafts.merge_experience(spark.createDataFrame(rows, schema), masters).collect()}
    role = "(role re-added, with every achievement)"
    assert got["kept"] == ([("r2", b("b", "a", "c")), ("r1", None), ("r3", None)], ["c (re-added to Two)", f"Three {role}"])
    assert got["empty"] == ([("r1", b("k", "l")), ("r2", None), ("r3", b("x"))], ["k, l (re-added to One)", f"Two {role}"])
    assert got["unknown"] == ([("r1", None), ("zz", b("q")), ("r2", b("a", "b", "c", "zz")), ("r3", None)], ["a, c (re-added to Two)", f"One {role}", f"Three {role}"])
    assert got["none"] == (None, []) and got["no roles"] == ([], []) and got["no master"] == ([("r1", b("a"))], [])
    assert got["text"] == ([("r1", [("k", "reworded"), ("l", None)]), ("r2", None), ("r3", None)], ["l (re-added to One)"])


def test_required_groups_come_back(spark):
    from jobloom.operators import drafts

    schema = "doc string, owner string, skills array<struct<group:string,items:array<string>>>"
    rows = [("gone", "o", [("Own", ["z"]), ("Tools", ["git"])]), ("items", "o", [("Tools", []), ("Testing", ["x", "bdd"])]), ("none", "o", []), ("no master", "p", [("Tools", ["a"])])]
    masters = spark.createDataFrame([("o", [("Testing", ["bdd", "tdd"]), ("Tools", ["git", "jira"])])], "owner string, groups array<struct<group:string,items:array<string>>>")
    out = drafts.merge_groups(spark.createDataFrame(rows, schema), masters, ["Testing", "Tools"], {"Tools": ["git", "jira"], "Testing": ["bdd"]})
    got = {r.doc: ([tuple(g) for g in r.skills], r.notes) for r in out.collect()}
    assert got["gone"] == ([("Testing", ["bdd", "tdd"]), ("Tools", ["git", "jira"]), ("Own", ["z"])], ["jira (re-added to their group)", "Testing"])
    assert got["items"] == ([("Tools", ["git", "jira"]), ("Testing", ["x", "bdd"])], ["git, jira (re-added to their group)"])
    assert got["none"] == ([], []) and got["no master"] == ([("Tools", ["a"])], [])


def test_cv_texts_are_cached(spark):
    from jobloom.sources import cv_cache

    now = F.lit("2026-09-21 12:00:00").cast("timestamp")
    requests = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", None)], "owner string, doc_id string")
    cache = spark.createDataFrame([("a", "d1", "old", "export", "2026-09-21 11:00:00"), ("a", "d1", "older", "export", "2026-09-01 00:00:00"), ("b", "d2", "copy", "export", "2026-09-19 12:00:00")], cv_cache.CACHE)
    assert [tuple(r) for r in cv_cache.due(requests, cache, now).collect()] == [("b", "d2")]
    assert cv_cache.due(requests, cache, now, force=True).count() == 2
    attempts = lambda rows: spark.createDataFrame(rows, "owner string, position int, source string, text string, error string")
    lost = {r.owner: (r.text, r.source, r.stale, r.age_hours, r.reason, r.error) for r in cv_cache.texts(requests, cache, attempts([("b", 1, "export", None, "timed out")]), now).collect()}
    assert lost == {"a": ("old", "cache", False, 1.0, None, None), "b": ("copy", "cache", True, 48.0, "export: timed out", None), "c": (None, None, None, None, None, "no document configured")}
    found = cv_cache.texts(requests, cache, attempts([("b", 2, "export", "second", None), ("b", 1, "service_account", " ", None)]), now)
    stored = cv_cache.versions(cache, found)
    assert stored.count() == 4 and cv_cache.due(requests, stored, now).count() == 0
    assert {r.owner: r.text for r in cv_cache.texts(requests, stored, attempts([]), now).collect()} == {"a": "old", "b": "second", "c": None}


def test_runs_are_added_whole_and_once(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    rows = spark.range(40).repartition(3).select(*(F.concat(F.lit('a "b", é\n'), "id").alias(c) if c == "title" else F.col("id").cast("double").alias(c) if c in ("day_rate_min", "day_rate_max", "perm_equivalent") else F.lit(None).cast("string").alias(c) if c == "source" else F.col("id").cast("string").alias(c) for c in store.CANDIDATE_COLUMNS))
    read = lambda: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(at)
    broken = rows.withColumn("url", F.when(F.col("url") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("url")))
    with pytest.raises(Exception, match="lost"):
        store.candidates_csv(broken, at, "monday")
    assert not list((tmp_path / "out").rglob("*.csv"))
    store.candidates_csv(rows, at, "monday")
    store.candidates_csv(rows, at, "monday")
    assert sorted((r.url, r.title, r.source) for r in read().collect()) == sorted((str(k), f'a "b", é\n{k}', None) for k in range(40))
    store.scored_csv(rows.limit(5).withColumn("tags", F.array(F.lit("x"))), at + "2", ["url", "title"], "tuesday")
    store.candidates_csv(rows.filter("url < '2'"), at, "tuesday")
    store.candidates_csv(rows.filter("false"), at, "empty")
    assert read().count() == 40 + rows.filter("url < '2'").count()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["run=monday", "run=tuesday"]
    assert next((tmp_path / "out2").rglob("*.csv")).read_text().startswith("url,title,company,")
    with pytest.raises(Exception, match="not a name of a run"):
        store.candidates_csv(rows, at, "../x")


def test_addresses_are_followed_over_the_network(spark):
    """Two hosts of one server: each address once, at the host's rate, with patience where it is asked for, and failures as rows."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from jobloom.sources import redirects

    seen, lock = [], threading.Lock()

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                seen.append((self.headers["Host"].split(":")[0], self.path, time.time()))
                before = sum(p == self.path for _, p, _ in seen)
            other = f"http://localhost:{self.server.server_port}"
            moved = {"/a": "/b", "/b": f"{other}/c", "/d": f"{other}/c", "/loop": "/pool", "/pool": "/loop"}.get(self.path)
            status = 302 if moved else 404 if self.path == "/gone" else 429 if self.path == "/busy" and before == 1 else 503 if self.path == "/shut" else 200
            self.send_response(status)
            for k, v in {"Location": moved, "Retry-After": {"/busy": "1", "/shut": "9999"}.get(self.path)}.items():
                if v:
                    self.send_header(k, v)
            self.end_headers()
            self.wfile.write(f"<p>page of {self.path} é</p>".encode() if status == 200 else b"")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at, to = f"http://127.0.0.1:{server.server_port}", f"http://localhost:{server.server_port}"
        paths = ["/a", "/d", "/loop", "/gone", "/busy", "/shut", *(f"/x{i}" for i in range(6))]
        asked = [(p, at + p) for p in paths] + [("twin", at + "/a"), ("none", None), ("file", "file:///etc/hostname"), ("bad", "http://127.0.0.1:1/")]
        got = {r.url: r for r in redirects.landed(spark.createDataFrame(asked, "url string, address string"), redirects.http_hops(rate=10, lanes=2), most=3).collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert len(got) == len(asked)
    assert all(got[u].final_url == f"{to}/c" and got[u].page == "<p>page of /c é</p>" and got[u].error is None for u in ("/a", "/d", "twin"))
    assert got["/busy"].page == "<p>page of /busy é</p>" and got["/x5"].final_url == f"{at}/x5"
    wrong = {u: got[u].error for u in ("/loop", "/gone", "/shut", "none", "file", "bad")}
    assert wrong == {"/loop": "more than 3 redirects", "/gone": "status 404", "/shut": "status 503", "none": "no address", "file": "ValueError", "bad": "URLError"}
    assert all(got[u].page is None for u in wrong)
    assert {p for _, p, _ in seen} == {*paths, "/b", "/c", "/pool"}
    assert all(sum(p == q for _, p, _ in seen) == (2 if q == "/busy" else 1) for q in {p for _, p, _ in seen})
    busy = [t for _, p, t in seen if p == "/busy"]
    assert busy[1] - busy[0] >= 1
    times = [t for h, p, t in seen if h == "127.0.0.1" and p in paths]
    assert max(times) - min(times) >= 1  # thirteen answers of a host in two queues, each at half its rate


def test_queues_wait_for_themselves_only(monkeypatch):
    from jobloom.sources import redirects

    clock, calls = [0.0], []
    monkeypatch.setattr(redirects.time, "time", lambda: clock[0])
    monkeypatch.setattr(redirects.time, "sleep", lambda s: clock.__setitem__(0, clock[0] + s))

    def ask(address):
        calls.append((address, clock[0]))
        return (429, {"retry-after": "5"}, "") if address == "a1" and len(calls) == 1 else (200, {}, address)

    got = list(redirects.asked_in_turn([("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b")], {}, 1.0, 3, 60.0, ask))
    assert [x[0] for x in got] == ["b1", "b2", "a1", "a2"]
    assert calls == [("a1", 0.0), ("b1", 0.0), ("b2", 1.0), ("a1", 5.0), ("a2", 6.0)]
    assert redirects.seconds_asked({"Retry-After": "Thu, 01 Jan 1970 00:01:00 GMT"}, 20.0) == 40.0
    assert redirects.as_answer("http://x/a/b", 302, {"LOCATION": "../c"}, "")[2] == "http://x/c"


def test_requests_without_rows(spark):
    from jobloom.sources import redirects

    none = spark.createDataFrame([], "url string, address string")
    assert redirects.landed(none, redirects.stored_hops(spark.createDataFrame([], redirects.ANSWER))).count() == 0


def test_merged_drafts_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Of rows of one order and line number the smallest part and supplier count, in the query and in its SQL."""
    rows = [(1, 1, 9, 3), (1, 1, 4, 2), (1, 1, 4, 1), (1, 2, 7, 0), (1, 2, 8, 2), (2, 3, 5, 1), (2, 3, 5, 3)]
    for name, own in (("a", rows), ("b", rows[::-1])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        got = sorted(map(tuple, registry.QUERIES["merged_drafts"](spark, at).collect()))
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{at}/lineitem.parquet/*.parquet'")
            want = sorted(con.execute(registry.SQL["merged_drafts"]).fetchall())
        assert got == want
        assert "r1[a1.1,a1.2,a1.3,a1.4]" in got[0][1]  # supplier 1: an empty list, filled


def test_rejected_rows_are_screened_once_and_not_enriched(spark):
    plan = registry.QUERIES["rejected_rows"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and "REPARTITION_BY_COL" in plan


def test_single_blanks_stay_and_other_white_space_is_one_blank(spark):
    texts = ["", " ", "  ", "\n", " \n", "\n ", "a b", "a  b", "a\nb", "a \n b", "a b", "a  b  c", "\t\t x \x85y ", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(text.one_blank(F.col("t")), F.regexp_replace("t", r"(?U)\s+", " ")).collect()
    assert all(a == b for a, b in got)


def test_texts_read_once_give_what_each_row_gives(spark, monkeypatch):
    """Nulls, empty and repeated texts, short and long ones: ``once`` changes no row."""
    monkeypatch.setattr(screen, "SHORT", 60)
    texts = [None, "", "Java at £500 per day outside IR35", "Active SC clearance required. " + "calm words " * 9, "Python only"]
    rows = [(f"u{k}", (None, "", "QA Engineer")[k % 3], texts[k % 5], 450.0 if k % 4 == 0 else None) for k in range(30)]
    df = spark.createDataFrame(rows, "url string, title string, description string, day_rate_max double")
    each, once = screen.enrich(df), screen.enrich(df, once=True)
    cols = sorted(each.columns)
    assert sorted(once.columns) == cols
    assert sorted(map(str, once.select(*cols).collect())) == sorted(map(str, each.select(*cols).collect()))


def test_the_window_reads_dates_once_and_no_text(spark):
    plan = registry.QUERIES["board_windowed"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and "REPARTITION_BY_COL" in plan and "text:string" not in plan


def test_a_backfill_that_reads_texts_once_writes_the_same(spark):
    texts = [None, "Java at £500 per day outside IR35", "Active SC clearance required.", "Python only " + "calm words " * 200]
    rows = [(f"u{k}", ("QA Engineer", None)[k % 2], "London", texts[k % 4], k % 3 > 0, "none") for k in range(24)]
    df = spark.createDataFrame(rows, "url string, title string, location string, description string, passed_filters boolean, language_tier string")
    each, once = audit.backfill(df, demote=True), audit.backfill(df, demote=True, once=True)
    cols = sorted(each.columns)
    assert sorted(map(str, once.select(*cols).collect())) == sorted(map(str, each.select(*cols).collect()))
    assert "keys=[title" in registry.QUERIES["backfill"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_references_are_found_once_a_text(spark):
    n = 20_000
    began = time.time()
    got = spark.createDataFrame([("x&#65; &amp;&nope; " * n,)], "t string").select(text.decoded(F.col("t")).alias("t")).first().t
    assert got == "xA &&nope; " * n and time.time() - began < 60


def test_briefs_judge_a_text_once(spark):
    plan = registry.QUERIES["briefs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(…|") == 1


@pytest.mark.parametrize("name", ["board_details", "boards_together", "board_workday"])
def test_more_postings_are_more_tasks(spark, monkeypatch, name):
    """Whatever holds rows (lists of a board, rows and requests by url) is dealt to as many tasks as the postings need."""
    monkeypatch.setattr(responses, "PER_TASK", 100)
    n = responses._parts(spark, DATA)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    assert sum(f", {n}), REPARTITION_BY_NUM" in x and "board#" in x for x in dealt) >= 1 and sum("url#" in x for x in dealt) >= 1


def _advert(k, text, **more):
    return {"url": f"u{k}", "company": f"Company {k}", "title": "QA Engineer", "location": "London", "description": text, "employment_type": "contract", "ordinal": k} | more


def _adverts(spark, rows):
    schema = schemas.struct(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.POSTING) + ", ordinal long")
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def test_a_run_reads_each_short_text_once(spark, tmp_path, monkeypatch):
    met, read = [], screen.with_advert
    monkeypatch.setattr(screen, "with_advert", lambda df: met.append(df.count()) or read(df))
    texts = ("Java at £500 per day outside IR35", "Active SC clearance required.", "Python only")
    rows = _adverts(spark, [_advert(k, texts[k % 3]) for k in range(40)])
    state = ingest.State(spark, f"file://{tmp_path}/state", buckets=4)
    state.commit(ingest.run_batch(state.tables(), rows.filter("ordinal < 20"), "2026-01-01 00:00:00"), "s#0")
    assert sum(met) == 3
    met.clear()
    state.commit(ingest.run_batch(state.tables(), rows, "2026-01-02 00:00:00"), "s#1")
    assert sum(met) == 6  # new postings and known ones
    monkeypatch.undo()
    cols = [*schemas.CONTRACT_FIELDS, *schemas.SCREEN_FIELDS]
    assert sorted(map(str, state.tables()["job_details"].select("url", *cols).collect())) == sorted(map(str, screen.enrich(rows).select("url", *cols).collect()))


def test_rates_judged_once_change_no_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(screen, "SHORT", 60)
    texts = [None, "", "Java at £500 per day outside IR35", "£640 per day. " + "calm words " * 9, "Inside IR35", "Python only"]
    rows = _adverts(spark, [_advert(k, texts[k % 6], day_rate_min=(None, 300.0, 0.0)[k % 3], day_rate_max=(None, 450.0, 1e9, 700.0)[k % 4], day_rate_source="given") for k in range(48)])
    each, once, alone = screen.enrich(rows), screen.enrich(rows, once=True, at=f"file://{tmp_path}/a"), screen.contracts(rows, at=f"file://{tmp_path}/b")
    cols = sorted(each.columns)
    assert sorted(once.columns) == cols and set(alone.columns) == set(cols) - set(schemas.SCREEN_FIELDS)
    assert sorted(map(str, once.select(*cols).collect())) == sorted(map(str, each.select(*cols).collect()))
    cols = sorted(alone.columns)
    assert sorted(map(str, alone.select(*cols).collect())) == sorted(map(str, each.select(*cols).collect()))


def test_a_known_posting_listed_twice_is_refreshed_by_its_last_row(spark, tmp_path):
    state = ingest.State(spark, f"file://{tmp_path}/state", buckets=4)
    state.commit(ingest.run_batch(state.tables(), _adverts(spark, [_advert(1, "We test Java.")]), "2026-01-01 00:00:00"), "s#0")
    again = [_advert(1, f"We test Java. £{p} per day.", ordinal=n) for n, p in ((7, 510), (9, 530), (8, 520))]
    state.commit(ingest.run_batch(state.tables(), _adverts(spark, again), "2026-01-02 00:00:00"), "s#1")
    assert [r.day_rate_max for r in state.tables()["job_details"].collect()] == [530.0]


def test_links_within_rows_are_those_of_all(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([f"u{k}", f"u{k}", None]), r.choice(["Acme", "Bee", "", f"Co {k}"]), r.choice(["QA Engineer", "SDET", None]), r.choice(["London", "UK", "Leeds", None]), r.choice([None, "2026-01-01", "2026-01-02"]), k % 3 == 0) for k in range(90)]
    df = spark.createDataFrame(rows, "url string, company string, title string, location string, fetched_at string, new boolean")
    want = sorted(map(tuple, duplicates.originals(df.filter("new"), df).collect()), key=str)
    got = sorted(map(tuple, duplicates.originals_within(df, F.col("new"), f"file://{tmp_path}/links").collect()), key=str)
    assert got == want and len(want) > 5


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    state = ingest.State(spark, f"file://{tmp_path}/state", buckets=1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        state.commit({"seen_jobs": spark.range(0, 40_000, 1, 4).select(*(F.concat(F.lit(f.name), F.sha2(F.col("id").cast("string"), 256)).alias(f.name) for f in schemas.SEEN_JOBS))})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len([*tmp_path.rglob("bucket=0/part-*.parquet")]) > 1
    assert state.tables()["seen_jobs"].distinct().count() == 40_000


def test_a_batch_of_new_postings_is_settled_by_one_round(spark, tmp_path):
    batch = [(f"u{k}", f"k{k}") for k in range(50)]
    got = arrivals.new_postings(sized(batch, spark), spark.createDataFrame([], "url string, company_title_key string"), f"file://{tmp_path}/rounds")
    assert got.count() == 50 and len([*tmp_path.rglob("_SUCCESS")]) == 2


def test_the_ingest_query_reads_its_postings_once(spark, monkeypatch):
    from jobloom.plans import fixtures

    read, rows = spark.sparkContext.accumulator(0), fixtures.postings(spark, DATA).limit(60)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(fixtures, "postings", lambda s, d: rows.mapInArrow(counted, rows.schema))
    assert registry.QUERIES["ingested"](spark, DATA).count() == 60
    assert read.value == 60


def test_listing_pages_are_fetched_again(spark):
    page = "What? Where?  Search\n Popular Jobs Recruiters"
    rows = _adverts(spark, [_advert(1, "We test Java."), _advert(2, page), _advert(3, None), _advert(4, "Java " + page)])
    seen = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",), ("u9",), (None,)], "url string")
    assert sorted(r.url or "" for r in store.requeue_polluted(seen, rows).collect()) == ["", "u1", "u3", "u9"]


def test_a_large_batch_is_not_sent_to_every_worker(spark, tmp_path, monkeypatch):
    """Files of these rows are small, but what is read of them again must not be broadcast."""
    monkeypatch.setattr(folders, "FEW", 10)
    plans, written = [], folders.written
    monkeypatch.setattr(folders, "written", lambda df, at: plans.append(df) or written(df, at))
    rows = written(_adverts(spark, [_advert(k, f"We test Java {k}.", company=f"Company {k // 2}", location=("London", "Leeds")[k % 2], day_rate_max=400.0 + k) for k in range(48)]), f"file://{tmp_path}/rows")
    state = ingest.State(spark, f"file://{tmp_path}/state", buckets=4)
    state.commit({"user_status": spark.createDataFrame([(f"u{k}", "saved", None, "t", None) for k in range(24)], schemas.USER_STATUS)})
    state.commit(ingest.run_batch(state.tables(), rows.filter("ordinal < 24"), "2026-01-01 00:00:00", f"file://{tmp_path}/0"), "s#0")
    plans.clear()
    out = ingest.run_batch(state.tables(), rows, "2026-01-02 00:00:00", f"file://{tmp_path}/1")
    found = [df._jdf.queryExecution().executedPlan().toString() for df in (*plans, *out.values())]
    assert sum("Join" in x for x in found) > 8 and not any("Broadcast" in x for x in found)
    assert [df.count() for df in out.values()] == [48, 48, 24]


def test_the_ingest_query_reads_whole_adverts(spark, monkeypatch):
    from jobloom.plans import fixtures

    rows, given = fixtures.postings(spark, DATA).limit(20), []
    monkeypatch.setattr(fixtures, "postings", lambda s, d: rows)
    monkeypatch.setattr(ingest, "run_batch", lambda tables, batch, *more: given.append(batch) or tables)
    registry.QUERIES["ingested"](spark, DATA)
    cols = [c for c in schemas.POSTING.names if c != "company"]
    assert sorted(map(str, given[-1].select(cols).collect())) == sorted(map(str, rows.select(cols).collect()))


def test_all_boards_take_the_postings_dealt_out_once(spark, monkeypatch):
    from jobloom.plans import fixtures

    read, rows = spark.sparkContext.accumulator(0), fixtures.postings(spark, DATA).limit(60)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(fixtures, "postings", lambda s, d: rows.mapInArrow(counted, rows.schema))
    assert {r.source: r.n for r in registry.QUERIES["boards_together"](spark, DATA).collect()}["lever"] == 60
    assert read.value <= 120  # once whole, once the numbers alone
