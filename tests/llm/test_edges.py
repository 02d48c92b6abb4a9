"""Nulls, ties, repeated rows, wide ids, clashing names, empty tables and hot keys of the training-data operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.llm import bpe, fingerprint, jaccard_join, licenses, lm, mixing, pipeline_stages, pretokens, quality, repeats, shared, tokenfiles
from tests.llm.test_operators import brute_classes, brute_repeats, library

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int, h long, part int, k long"


def at(spark) -> str:
    return shared.folder(spark, "edges")


@pytest.fixture(scope="module")
def messy(spark):
    """Null and repeated ids, ids over the whole range of a long, repeated rows, names that the operators use themselves."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    some = lambda n: " ".join(["the", "and", *(r.choice(words) for _ in range(n))])
    a, b = some(60), some(80)
    texts = [(None, some(40)), (None, None), (None, some(50)), (5, a), (5, some(45)), (5, a), (7, b), (8, b + " x"), (-9 * 10**18, some(70)), (9 * 10**18, some(70)), (11, ""), (12, some(9000)), (13, " \n")]
    rows = [(i, t, "en", s, len(t or ""), 1, 2, 3, 4) for (i, t), s in zip(texts, ["x", None, "x", "x", "y", "x", "y", "y", None, "x", "x", "y", "x"], strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def ordered(rows):
    """Rows by id (null first), ties by the hash that the operator takes."""
    return sorted(rows, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.x))


# Fingerprints ---------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [2, 4, 1000])
def test_next_rows_of_any_ids(spark, rows):
    r = random.Random(rows)
    ids = [None, None, -9 * 10**18, 9 * 10**18, *range(40), *(10**15 + k for k in range(30)), *[77] * 25]
    table = spark.createDataFrame([(i, f"t{r.random()}") for i in ids], "doc_id long, t string").repartition(4)
    want = ordered(table.select("*", F.xxhash64("doc_id", "t").alias("x")).collect())
    got = {r.t: r.next.t for r in fingerprint.with_next(table, rows=rows).collect()}
    assert got == {a.t: b.t for a, b in zip(want, want[1:] + want[:1], strict=True)}


def test_a_hot_id_and_clustered_ids_are_dealt_out(spark):
    table = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 2990, 10**12 + F.col("id")).otherwise(-F.col("id") * 10**14).alias("doc_id"), F.col("id").cast("string").alias("t"))
    sizes = [r["count"] for r in fingerprint._binned(table, "doc_id", 100).groupBy("__bin").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400


def test_fingerprints_of_messy_rows(spark, messy):
    rows = ordered(messy.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("*", F.xxhash64("doc_id", "t").alias("x")).collect())
    got = fingerprint.edited_fingerprints(messy, at(spark)).collect()
    want = []
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(a.t) // 2
        want.append((str(a.doc_id), len(a.t), hashlib.sha256((a.t[: len(a.t) - half] + b.t[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert fingerprint.edited_fingerprints(messy.filter("false"), at(spark)).count() == 0
    assert fingerprint.edited_fingerprints(messy.filter("doc_id = 7"), at(spark)).first().near_next == 1.0


# Quality rules --------------------------------------------------------------------------------


def test_quality_replaces_a_column_of_its_own_name(spark, messy):
    got = quality.quality_rules(messy)
    assert got.columns == [*(c for c in messy.columns if c != "quality"), "quality"] and got.count() == messy.count()
    assert quality.quality_rules(messy.withColumn("__quality_words", F.lit(1)), out="Quality").filter("Quality.n_words = 0").count() == 3


# Repeats --------------------------------------------------------------------------------------


def test_repeats_keep_each_rows_own_columns(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "a"), (1, text, "fr", "b"), (2, "other", "de", "c"), (1, text, "fr", "b"), (None, None, None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), at(spark), with_text=True).collect()
    assert Counter((r.doc_id, r.lang, r.source) for r in got) == Counter((i, lang, s) for i, _, lang, s in rows)
    assert sum(r.n_removed for r in got) == 2 * len(text)


def test_repeats_of_messy_rows(spark, messy):
    got = repeats.remove_repeats(messy, at(spark), with_text=True)
    assert got.count() == messy.count() and set(got.columns) >= set(messy.columns) - {"text"}
    rows = messy.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect()
    want = brute_repeats([(r.doc_id, r.t) for r in ordered(rows)])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(messy, at(spark)).collect()), key=str) == sorted(want, key=str)


# Mixing, pipeline -----------------------------------------------------------------------------


def mixed_rows():
    """Three sources: ids of their own; one id (with different and equal texts); no ids at all, half of the rows equal."""
    r = random.Random(3)
    rows = []
    for k in range(300):
        source, i = [("a", k), ("b", 7), ("c", None)][k % 3]
        text = " ".join("w" for _ in range(r.randint(20, 60))) + f" {k}"
        rows.append((i, "same words again " * 8 if source != "a" and k % 2 else text, "en", source, 1))
    return rows


def test_mix_of_null_and_repeated_ids_reaches_its_targets(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = mixing.mix(docs, at(spark)).collect()
    largest = max(r["size"] for r in got)
    assert len(got) == 300 and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest
    again = mixing.mix(docs.repartition(3), at(spark)).collect()
    order = lambda rows: Counter((r.doc_id, r.source, r.text_hash, r.n_taken) for r in rows)
    assert order(got) == order(again)
    stage = pipeline_stages.mixing_stage(spark, docs, "").groupBy("doc_id", "source", F.xxhash64("text").alias("h")).count().collect()
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.text_hash] += r.n_taken
    assert {(r.doc_id, r.source, r.h): r["count"] for r in stage} == +want


def test_rows_are_numbered_in_groups_of_any_size(spark):
    table = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), F.lit("x").alias("t"))
    got = Counter((r.k, r.number) for r in mixing.numbered(table, ["k", "t"]).collect())
    sizes = Counter(k for k, _ in got)
    assert sum(sizes.values()) == 5000 and all(got[k, n] == 1 for k in sizes for n in range(sizes[k]))


def test_near_duplicates_keep_short_rows_without_ids(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(None, "", "en", "a", 0), (None, "", "en", "a", 0), (None, None, "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, long, "en", "a", 9), (None, long, "en", "a", 9), (4, long + " end", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text or "") for r in pipeline_stages.near_duplicates_stage(spark, docs, "").collect())
    assert got == Counter({(None, ""): 3, (3, "one two"): 1, (None, long): 1})


def test_fingerprints_keep_columns_of_every_name(spark):
    names = ["__canon", "__d1", "__d2", "__dm", "canon", "row", "h1", "d1", "dm", "__h1", "__check", "ordinal"]
    table = spark.createDataFrame([(1, "a b", *names), (2, "A  B", *names), (3, None, *names)], ["doc_id", "text", *names])
    weak = lambda c: (F.length(c).cast("long"), F.lit(1).cast("long"))
    for hashed in (fingerprint.wide, weak):
        got = fingerprint.fingerprints(table, hashed=hashed)
        assert got.columns == [*table.columns, "fingerprint"] and all([r[c] for c in names] == names for r in got.collect())
        assert len({r.fingerprint for r in got.collect()}) == 2


def test_token_files_are_even_where_ids_are_not(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "RANGE_BYTES", 1 << 14)
    table = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("equal words of a text")).otherwise(F.concat(F.lit("other words "), "id")).alias("text")).repartition(4)
    where = at(spark)
    files = tokenfiles.write_tokens(table, where, bpe.public_path()).orderBy("part").collect()
    sizes = [r.bytes for r in files]
    assert len(sizes) >= 4 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    rows = tokenfiles.read_files(spark.createDataFrame(files), where, 2).orderBy("start").collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and len(ids) == 4000


@pytest.mark.parametrize("sign", ["\u0301", "\u200d", "_", "\u20ac", "\u00a0", "\u2167"])
def test_licenses_are_found_whatever_stands_beside_their_words(spark, sign):
    text = licenses.TEMPLATES["MIT"] if "MIT" in licenses.TEMPLATES else next(iter(licenses.TEMPLATES.values()))
    texts = [text.replace(" ", f"{sign} "), text.replace(" ", f" {sign}"), f"{sign}{text}{sign}", text.upper()]
    known = licenses.Templates(licenses.TEMPLATES)
    want = Counter((k, *x) for k, t in enumerate(texts) for x in known.find(t))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in rows) == want and (sign == "\u2167" or len({k for k, *_ in want}) == 4)


def test_mixing_stage_gives_each_row_its_own_copies(spark):
    r = random.Random(2)
    rows = [(i % 9, " ".join("w" for _ in range(r.randint(0, 30))) + f" {i}", "en", f"s{i % 4}" if i % 5 else None, i) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = Counter()
    for x in mixing.mix(docs, at(spark)).collect():
        want[x.doc_id, x.source, x.text_hash] = x.n_taken
    assert set(want.values()) == {0, 1, 2} or set(want.values()) == {1, 2}
    got = Counter((x.doc_id, x.source, x.h) for x in pipeline_stages.mixing_stage(spark, docs, "").select("doc_id", "source", F.xxhash64("text").alias("h")).collect())
    assert got == +want


def test_pipeline_of_messy_rows(spark, messy, tmp_path):
    import corpus_pipeline

    messy.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, docs, str(tmp_path)), f"file://{tmp_path}/out-{len(kept)}")
        kept[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(pipeline_stages.COLUMNS)
        docs = out
    good = [r for r in quality.quality_rules(messy).filter("quality.kept").select("text").collect()]
    assert kept["quality rules"] == len(good)
    assert kept["n-gram Jaccard join"] == len({c for _, c, _ in brute_classes([(k, r.text) for k, r in enumerate(good)])})
    assert kept["suffix-array dedup"] == kept["n-gram Jaccard join"] and kept["BPE encoding and decoding"] == kept["mixing sources to target weights"] > 0
    for c in docs.collect():
        assert c.n_tokens > 0
    empty = messy.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


# Joins, scores --------------------------------------------------------------------------------


def test_join_of_messy_rows(spark, messy):
    got = jaccard_join.jaccard_join(messy, at(spark)).collect()
    texts = Counter((r.doc_id, r.text or "") for r in messy.collect())
    rows = [x for x, n in texts.items() for _ in range(n)]
    want = Counter(n for _, _, n in brute_classes([(k, t) for k, (_, t) in enumerate(rows)]))
    assert Counter(r.n_links for r in got) == want and len(got) == messy.count()


def test_scores_of_messy_rows_and_of_held_out_rows_alone(spark, messy):
    got = lm.score_texts(messy, at(spark)).collect()
    assert len(got) == messy.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1) for r in messy.collect())
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    alone = lm.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string"), at(spark)).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0 for r in alone)


# Token files ----------------------------------------------------------------------------------


def test_token_files_of_messy_rows(spark, messy):
    where, tokenizer = at(spark), library()
    got = tokenfiles.read_files(tokenfiles.write_tokens(messy, where, bpe.public_path()), where, 2, with_ids=True).orderBy("start").collect()
    assert len(got) == messy.count()
    keys = [(-(2**63) if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys) and [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    want = Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in messy.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_pretokens_equal_the_library_on_random_texts():
    from tokenizers import Tokenizer

    r = random.Random(8)
    pools = ["ab 'sTre\n\t.", "é ñß²½ 12", "日本 語ｱ　 ", "🙂‍🏽 \x1c\x85\xa0", "".join(map(chr, range(0x20, 0x500)))]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["".join(map(chr, range(a, a + 256))) for a in (*range(0, 0xD800, 0x700), 0xF900, 0x1F600)]
    tokenizer = Tokenizer.from_file(bpe.public_path())
    encode, special, _ = tokenfiles.library(bpe.public_path())
    from jobloom.llm.kernels import column

    ids, count = pretokens.Store(encode).batch(*column(pa.array(texts)), special)
    bound = np.concatenate([[0], np.cumsum(count)])
    for t, a, b in zip(texts, bound[:-1], bound[1:], strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


# Licenses -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_licenses_equal_a_search_of_all_windows(seed):
    """Every window that reaches the coverage meets a found stretch; found ones reach it and don't overlap."""
    r = random.Random(seed)
    templates = {"one": "permission is granted to use copy and modify", "two": "no warranty of any kind is given for the work by its authors"}
    known = licenses.Templates(templates)
    for _ in range(12):
        ws = []
        for _ in range(r.randint(1, 5)):
            t = templates[r.choice(list(templates))].split()
            if r.random() < 0.5:
                del t[r.randrange(len(t))]
            if r.random() < 0.3:
                t[r.randrange(len(t))] = "changed"
            ws += [r.choice(["some", "other", "words", "of"]) for _ in range(r.randint(0, 6))] + t
        text = " ".join(ws)
        found = known.find(text)
        _, spans = licenses.words(text)
        for name, template in known.words.items():
            n = len(template)
            own = sorted((a, b, c) for k, c, a, b in found if k == name)
            assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
            for a, b, c in own:
                assert c >= licenses.COVERAGE and len(licenses.align(text[a:b].split(), template)) / n == pytest.approx(c)
            for i in range(len(ws)):
                for j in range(i + 1, min(len(ws), i + n + 2) + 1):
                    if len(licenses.align(ws[i:j], template)) >= licenses.COVERAGE * n:
                        assert any(a < spans[j - 1][1] and spans[i][0] < b for a, b, _ in own), (name, ws[i:j])


def test_license_scan_of_messy_rows(spark, messy):
    mit = licenses.TEMPLATES["MIT-notice"]
    rows = [(None, mit), (5, mit), (5, mit), (6, None), (7, ""), (8, "word " * 60_000 + mit + " word" * 60_000)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("x"), "start": F.lit(1)})).collect()
    assert sorted(((r.doc_id, r.license, r.start) for r in got), key=str) == sorted([(None, "MIT-notice", 0), (5, "MIT-notice", 0), (5, "MIT-notice", 0), (8, "MIT-notice", 300_000)], key=str)
    assert licenses.scan(messy.filter("false")).count() == 0
    table = spark.createDataFrame([("own", "this house was built by hand")], "license string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "This house was BUILT by hand.")], "doc_id long, text string"), licenses.templates_of(table)).first().license == "own"

