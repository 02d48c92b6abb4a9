"""The training-data operators against brute force on small tables with nulls, ties, repeated rows, empty and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.llm import bpe, bwt, fingerprint, jaccard_join, kernels, licenses, lm, mixing, quality, repeats, shards, shared, tokenfiles
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts(seed: int = 0) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé ñ".replace(" ", "")) for _ in range(r.randint(1, 9))) for _ in range(300)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, out = some(60), [None, "", " \n\t ", "a b", "one", "x" * 500]
    for _ in range(25):
        t = some(r.randint(5, 150))
        out.append(t)
        if r.random() < 0.4:
            out += [t] * r.randint(1, 3)
        if r.random() < 0.4:
            w = t.split(" ")
            w[r.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    out += [f"{some(20)} {passage} {some(20)}" for _ in range(6)]
    out.append(some(6000))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, None if i % 7 == 0 else f"s{i % 4}", "extra", i) for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fingerprint string, row long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def at(spark) -> str:
    return shared.folder(spark, "test")


def by_id(df, *cols):
    return sorted(tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect())


def pairs_of(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


# 1 ------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent, links = {i: i for i in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 5 * k >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(i, find(i), links[i]) for i in sorted(sets)]


def test_join_equals_brute_force(spark, docs, empty):
    assert by_id(jaccard_join.jaccard_join(docs, at(spark)), "class_id", "n_links") == brute_classes(pairs_of(docs))
    assert jaccard_join.jaccard_join(empty, at(spark)).count() == 0


def test_join_of_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(130):
        w = list(base)
        w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(60))) for i in range(130)]
    got = by_id(jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), at(spark)), "class_id", "n_links")
    assert got == brute_classes(rows)


def test_blocks_of_a_component_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rows = [(i, " ".join(f"w{k}" for k in range(100)) + f" e{i}") for i in range(30)]
    got = by_id(jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), at(spark)), "class_id", "n_links")
    assert got == [(i, 0, 29) for i in range(30)]


def test_join_of_rows_without_ids(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join([*base, "x"])), (4, " ".join([*base, "y"])), (4, None), (4, "other words here")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), at(spark))
    assert sorted(r.n_links for r in got.collect()) == [0, 0, 2, 2, 2]


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.9999) >= jaccard_join.runs_for(0.9) >= 1


# 2 ------------------------------------------------------------------------------------------


def test_quality_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = quality.op2(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = c.sql(quality.SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns].astype(got.dtypes))
    assert 0 < got.kept.sum() < len(got)


def test_quality_of_edge_cases(spark, docs, empty):
    rows = {r.doc_id: r.quality for r in quality.quality_rules(docs).collect()}
    assert len(rows) == docs.count() and rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    for i, t in pairs_of(docs):
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (rows[i].n_words, rows[i].n_repeat_words, rows[i].word_chars) == (len(w), len(covered), sum(map(len, w)))
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_rules(docs).filter("quality.kept").count() == sum(r.kept for r in rows.values())


# 3 ------------------------------------------------------------------------------------------


def test_shards_keep_all_rows_and_versions(spark, docs):
    store = shards.ShardStore(spark, at(spark), target=40_000, fan_in=3)
    for k in range(5):
        store.append(docs.filter(F.col("doc_id") % 5 == k))
    before = store.versions()[-1]
    last = store.compact_all()
    key = ["doc_id", "text", "source", "row"]
    assert last > before
    for v in (before, last):
        assert sorted(map(str, store.read(v).select(key).collect())) == sorted(map(str, docs.select(key).collect()))
    assert store.manifest(last).count() < store.manifest(before).count()
    store.vacuum()
    assert store.versions() == [last] and store.read().count() == docs.count()
    with pytest.raises(shards.Conflict):
        store._commit(store.manifest(), last, store.schema())


def test_shards_of_an_empty_table(spark, docs, empty):
    store = shards.ShardStore(spark, at(spark))
    assert store.read().count() == 0 and store.compact() is None
    store.append(empty)
    assert store.read().columns == empty.columns and store.read().count() == 0 and store.compact() is None
    store.append(docs)
    assert store.read().count() == docs.count()


def test_shards_pass_over_a_half_written_version(spark, docs):
    where = at(spark)
    store = shards.ShardStore(spark, where)
    store.append(docs)
    for name in ("0000000002", "_passing"):
        fs, path = shared.hadoop(spark, f"{where}/versions/{name}")
        fs.create(path, False).close()
    assert store.versions() == [1] and store.read().count() == docs.count()
    assert store.append(docs) == 3 and store.read().count() == 2 * docs.count()


def test_shards_with_a_new_column(spark):
    store = shards.ShardStore(spark, at(spark), fan_in=2)
    stamp = F.lit("2026-01-01 10:00:00").cast("timestamp")
    store.append(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").coalesce(1).withColumn("at", stamp))
    store.append(spark.createDataFrame([(None, None, [1, 2])], "doc_id long, text string, more array<int>").coalesce(1).withColumn("at", stamp))
    want = sorted([(1, "a", None), (1, "a", None), (None, None, [1, 2])], key=str)
    look = lambda: sorted(((r.doc_id, r.text, r.more) for r in store.read().collect()), key=str)
    assert look() == want
    assert store.compact() == 3 and store.manifest().count() == 1
    assert look() == want and store.read().select("at").distinct().count() == 1
    with pytest.raises(ValueError, match="text"):
        store.append(spark.createDataFrame([(1, 2)], "doc_id long, text int"))


def test_writers_conflict_and_leave_nothing(spark, docs):
    where = at(spark)
    one, two = (shards.ShardStore(spark, where, fan_in=2) for _ in range(2))
    for k in range(3):
        one.append(docs.filter(F.col("row") % 3 == k).coalesce(1))
    known = two._next()
    two._next = lambda: known  # has looked before the other's commit
    assert one.compact() == known
    with pytest.raises(shards.Conflict):
        two.append(docs)
    one.vacuum(failed_after_hours=0.0)
    left = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{where}/data").count()
    assert left == one.manifest().count() and one.read().count() == docs.count()


def test_tiers_and_sizes(spark, docs):
    target, fan_in = 60_000, 3
    store = shards.ShardStore(spark, at(spark), target=target, fan_in=fan_in)
    for k in range(7):
        store.append(docs.filter(F.col("doc_id") % 7 == k).repartition(2))
    largest = max(r.bytes for r in store.manifest().collect())
    store.compact_all()
    rows = store.manifest().collect()
    assert all(r.bytes <= target + largest for r in rows) and sum(r.rows for r in rows) == docs.count()
    open_ = Counter(r.tier for r in rows if not r.full)
    assert all(n < fan_in for n in open_.values()) and all(r.full == (r.bytes >= target // 2) for r in rows)


def test_op3_keeps_the_table(spark):
    got = shards.op3(spark, DATA)
    want = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.xxhash64("text").alias("text_hash"))
    assert sorted(map(tuple, got.select("doc_id", "text_hash").collect())) == sorted(map(tuple, want.collect()))


# 4 ------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs):
    rows = pairs_of(docs)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, at(spark)).collect()}
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    canon = lambda t: " ".join(t.casefold().split())
    for (i, a), (j, b) in combinations(rows, 2):
        assert (got[i].fingerprint == got[j].fingerprint) == (canon(a) == canon(b))


def test_colliding_digests_are_told_apart(spark):
    texts = spark.createDataFrame([("a",), ("B",), ("b",), (None,), ("",), ("Straße",), ("STRASSE",), ("ﬁ",), ("fi",)], "text string")
    poor = lambda c: (F.lit(7).cast("long"), F.lit(8).cast("long"))
    for hashed in (fingerprint.wide, poor):
        f = [r.fingerprint for r in fingerprint.fingerprints(texts, hashed=hashed).orderBy("text").select("text", "fingerprint").collect()]
        assert len(set(f)) == 5
    assert fingerprint.exact_groups(spark.createDataFrame([(1, "x"), (2, "X "), (3, "y")], "doc_id long, text string").coalesce(1)).filter("n_copies = 2").count() == 2


# 5 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, docs, empty, order):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    rows = [(i, [*WORD.findall(t.translate(low)), None]) for i, t in pairs_of(docs)]
    grams = lambda t, n: list(zip(*([*[0] * (n - 1), *t][k:] for k in range(n)), strict=False))
    one, levels = Counter(), {n: Counter() for n in range(1, order + 1)}
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t)
            levels[order].update(grams(t, order))
    for n in range(order - 1, 0, -1):  # numbers of different predecessors
        levels[n].update(g[1:] for g in levels[n + 1])
    total, v = sum(one.values()), len(one)
    d = {n: lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for n, c in levels.items()}
    follow = {n: defaultdict(list) for n in levels}
    for n, c in levels.items():
        for g, x in c.items():
            follow[n][g[:-1]].append(x)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (v + 1)
        x, own = levels[n][g], follow[n].get(g[:-1])
        if not own:
            return p(g[1:])
        return max(x - d[n][min(x, 3)], 0) / sum(own) + sum(d[n][min(y, 3)] for y in own) / sum(own) * p(g[1:])

    got = {r.doc_id: r for r in lm.score_texts(docs, at(spark), order).collect()}
    for i, t in rows:
        assert got[i].base_score == pytest.approx(sum(math.log10((one[b] + 1) / (total + v + 1)) for b in t))
        assert got[i].score == pytest.approx(sum(math.log10(p(g)) for g in grams(t, order)))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(one[b] > 0 for b in t), total)
    assert lm.score_texts(empty, at(spark), order).count() == 0


# 6 ------------------------------------------------------------------------------------------


def test_transform_of_random_collections():
    r = random.Random(1)
    for trial in range(12):
        alphabet = r.choice(["ab", "abcdefgh"])
        strings = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 20))]
        strings += strings[: trial % 3]
        data, length = np.frombuffer("".join(strings).encode(), np.uint8), np.array([len(s) for s in strings])
        string, offset, common = bwt.collection(data, np.cumsum(length) - length, length, 10)
        suffixes = [strings[s][o:] for s, o in zip(string, offset, strict=True)]
        assert suffixes == sorted(suffixes) and len(suffixes) == length.sum() + len(strings)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
            assert n == min(10, next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, docs, empty):
    cols = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(repeats.remove_repeats(docs, at(spark)), *cols) == brute_repeats(pairs_of(docs))
    assert repeats.remove_repeats(empty, at(spark)).count() == 0
    again = docs.select(F.lit(5).cast("long").alias("doc_id"), "text").filter("length(text) > 200").limit(4)
    got = repeats.remove_repeats(again.unionAll(again), at(spark))  # one doc_id for all, each row twice
    assert got.count() == 8 and got.filter("n_removed = n_bytes").count() >= 4


# 7, 10 --------------------------------------------------------------------------------------

ODD = ["", "don't we'll I'D 'S", "  two  spaces \n\n x\n", "tab\tend \t ", "日本語 テスト 123² ½ x×y ÷ naïve œuvre", "a<|endoftext|>b <|endoftext|>", "aaaaaaaaaa" * 60 + " =====---", None, " ", "x \n", "\x1c\x1d a\x85b\xa0c", "é'té 'l 'll", "🙂🙂 emoji", "ªº µ"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path())


def test_ids_equal_the_library():
    encode, _ = bpe.encoder(bpe.public_path())
    texts = ODD + make_texts(5)
    ids, count = encode(pa.array(texts))
    bound = np.concatenate([[0], np.cumsum(count)])
    for t, a, b in zip(texts, bound[:-1], bound[1:], strict=True):
        assert ids[a:b].tolist() == library().encode(t or "", add_special_tokens=False).ids


def test_encode_decode(spark, docs, empty):
    got = {r.doc_id: r for r in bpe.encode_decode(docs, bpe.public_path(), with_ids=True).collect()}
    for i, t in pairs_of(docs):
        assert got[i].decoded == t and got[i].n_tokens == len(got[i].ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, got[i].ids)).encode()).hexdigest()
    assert bpe.encode_decode(empty, bpe.public_path()).count() == 0


def test_number_code_round_trip():
    for n in (0, 1, 3, 4, 1000):
        x = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) >> np.random.default_rng(9).integers(0, 32, n).astype(np.uint32)
        control, data = tokenfiles.pack_numbers(x)
        assert (tokenfiles.unpack_numbers(control, data, n) == x).all()


def test_token_files(spark, docs, empty):
    where = at(spark)
    files = tokenfiles.write_tokens(docs, where, bpe.public_path())
    got, start = {r.doc_id: r for r in tokenfiles.read_files(files, where, 2).collect()}, 0
    for i, t in pairs_of(docs):
        ids = np.array([*library().encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    where = at(spark)
    assert tokenfiles.read_files(tokenfiles.write_tokens(empty, where, bpe.public_path()), where, 1).count() == 0


# 8 ------------------------------------------------------------------------------------------


def test_mix_equals_sql_and_its_rules(spark, docs, empty):
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "source", "text").toPandas())
    got = mixing.mix(docs, at(spark))
    want = c.sql(mixing.SQL).fetchall()
    assert by_id(got, "size", "source_size", "target", "taken") == sorted(want)
    rows = got.collect()
    assert all(r.taken <= 2 * r.size for r in rows)
    largest = max(r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * largest
    assert mixing.mix(empty, at(spark)).count() == 0


# 9 ------------------------------------------------------------------------------------------


def test_licenses(spark):
    known = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = known.find("Some prose of the license kind. " + text.upper() + " More of the software.")
        assert max((c for n, c, *_ in found if n == name), default=0) == 1.0
    assert known.find("The license of the software is a permission to use it.") == []
    rows = spark.createDataFrame([(1, "x\n" + licenses.TEMPLATES["MIT"].replace("charge", "fee")), (2, None), (3, ""), (4, "no such words")], "doc_id long, text string")
    got = licenses.scan(rows).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT")} and 0.9 < got[0].coverage < 1 and got[0].start == 2


def test_longest_increasing():
    for seed in range(20):
        v = random.Random(seed).sample(range(12), 8)
        i = licenses.increasing(v)
        assert [v[k] for k in i] == sorted(v[k] for k in i)
        assert len(i) == max(n for n in range(9) if any(list(c) == sorted(c) for c in combinations(v, n)))


# Kernels, pipeline --------------------------------------------------------------------------


def test_words_and_batches():
    texts = make_texts(2)
    data, off = kernels.column(pa.array(texts))
    begin, end, first = kernels.words(data, off)
    got = [[bytes(data[a:b]).decode() for a, b in zip(begin[x:y], end[x:y], strict=True)] for x, y in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    batch = pa.record_batch({"text": pa.array(texts)})
    assert [t for p in kernels.pieces([batch], limit=500) for t in p.column("text").to_pylist()] == texts


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = {r.doc_id: r for r in table.collect()}
    kept = {r.doc_id for r in quality.quality_rules(table).filter("quality.kept").collect()}
    classes = brute_classes([(i, rows[i].text) for i in sorted(kept)])
    alone = [i for i, c, _ in classes if i == c]
    texts, seen = {}, set()
    for i in alone:
        raw = rows[i].text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        flags = np.frombuffer(bytes(gone), np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
        a, b = repeats.whole_characters(raw, edge[::2], edge[1::2])
        for x, y in reversed(list(zip(a, b, strict=True))):
            raw = raw[:x] + raw[y:]
        if raw:
            texts[i] = raw.decode()
    c = duckdb.connect()
    import pandas as pd

    c.register("documents", pd.DataFrame([(i, rows[i].source, t) for i, t in texts.items()], columns=["doc_id", "source", "text"]))
    taken = {i: t // s if s else 0 for i, s, _, _, t in c.sql(mixing.SQL).fetchall()}
    tokenizer = library()
    want = []
    for i, n in taken.items():
        ids = tokenizer.encode(texts[i], add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())] * n
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
