"""Vector codes, spelling variants and packing against brute force, on small tables with nulls, ties, repeated rows, long texts and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobloom.llm import packing, queries, shared, spelling, vectors
from jobloom.llm.bpe import public_path
from tests.conftest import DATA
from tests.llm.test_operators import library


def at(spark) -> str:
    return shared.folder(spark, "test")


@pytest.mark.parametrize("name,table", [("op11_vector_codes", "embeddings"), ("op12_spelling_variants", "documents")])
def test_query_equals_sql(spark, name, table):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    cell = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda t: sorted(tuple(map(str, map(cell, r))) for r in t[columns].values.tolist())
    assert sorted(got.columns) == columns and rows(got) == rows(want)


# Vectors --------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Of (id, label, vector) rows: (id, label, code, error) and the codebooks."""
    fit = sorted((r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.floor(np.array([r[2] for r in fit]) * 256).astype(np.int64).reshape(len(fit), parts, -1)
    books = x[:entries].copy()
    for k in range(rounds + 1):
        far = ((x[:, None] - books[None]) ** 2).sum(3)
        code = far.argmin(1)
        if k < rounds:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    own = x[code[:, p] == e, p]
                    books[e, p] = own.sum(0) // len(own)
    error = far.min(1).sum(1)
    coded = [(r[0], r[1], "".join(f"{c:02x}" for c in code[i]), int(error[i])) for i, r in enumerate(fit)]
    return coded, books.transpose(1, 0, 2)


def vector_rows():
    r = random.Random(8)
    some = lambda: [r.choice([r.gauss(0, 1), 0.5, -0.25, 0.0]) for _ in range(32)]
    rows = [(i, r.choice([None, 1, 2, 3]), some()) for i in range(900)]
    hot = some()
    rows += [(2000 + i, 1, hot) for i in range(500)] + [(2000, 1, hot), (5, 2, some()), (None, 3, some()), (None, None, some()), (-(2**62), 9, some())]
    bad = [(7000, 1, None), (7001, 1, [None, *some()[1:]]), (7002, 1, [float("nan"), *some()[1:]]), (7003, 1, [*some()[1:], float("-inf")])]
    return rows, bad


@pytest.mark.parametrize("block", [vectors.BLOCK, 37])
def test_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows, bad = vector_rows()
    table = spark.createDataFrame([(i, label, v, "extra", "code") for i, label, v in rows + bad], "vec_id long, label int, embedding array<double>, error string, code string").repartition(3)
    coded, books = vectors.compress(table, at(spark))
    want, want_books = brute_codes(rows)
    assert (books == want_books).all()
    got = vectors.label_errors(coded).collect()
    assert sorted(((r.key, r.label, r.code, r.error) for r in got), key=str) == sorted(want, key=str)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in got)


def test_label_errors_of_many_labels(spark, monkeypatch):
    rows, _ = vector_rows()
    table = spark.createDataFrame([(i, label, v) for i, label, v in rows], "vec_id long, label int, embedding array<double>")
    coded, _ = vectors.compress(table, at(spark))
    want = sorted(map(str, vectors.label_errors(coded).collect()))
    monkeypatch.setattr(vectors, "FEW_LABELS", 2)
    assert sorted(map(str, vectors.label_errors(coded).collect())) == want


def test_vectors_of_other_lengths_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [0.1] * 16, 0), (2, [0.2] * 16, None), (3, [0.3] * 32, 0), (4, [], 0), (5, None, 1)]
    coded, books = vectors.compress(spark.createDataFrame(rows, schema), at(spark))
    got = {r.key: (r.code, r.error) for r in coded.collect()}
    assert got == {1: ("00" * 16, 0), 2: ("01" * 16, 0), 3: (None, None), 4: (None, None)} and books.shape == (16, 2, 1)
    coded, books = vectors.compress(spark.createDataFrame(rows, schema).filter("false"), at(spark))
    assert coded.count() == 0 and books.size == 0 and vectors.label_errors(coded).count() == 0


def test_trees_give_each_point_its_nearest_entry():
    r = np.random.default_rng(3)
    for n, d, k in ((1, 1, 1), (500, 4, 64), (700, 2, 7), (300, 6, 64)):
        points, book = r.integers(-9, 9, (n, d)), r.integers(-9, 9, (k, d))
        order, levels = vectors.build(points)
        want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (vectors.codes_of(points, order, levels, book) == want).all()
        total, count = vectors.sums_of(points, order, levels, book)
        assert (count == np.bincount(want, minlength=k)).all() and all((total[e] == points[want == e].sum(0)).all() for e in range(k))


# Words ----------------------------------------------------------------------------------------


def brute_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    by = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            by[w[:p], p, w[p + 1 :]].add(w)
    near = defaultdict(set)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for p in range(len(w)):
            if (d := w[:p] + w[p + 1 :]) in n:
                near[w].add(d)
                near[d].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def word_docs():
    r = random.Random(5)
    bases = ["".join(r.choice("abcé") for _ in range(r.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷×÷×÷"]
    bases += ["x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" * 70 + "z" * 30, "y" * 69 + "z" * 31, "y" * 69 + "z" * 30, "y" * 50 + "q" + "z" * 49]
    out = []
    for k, b in enumerate(bases):
        out += [b] * (5 * r.choice([1, 6, 40]))
        for _ in range(3):
            p = r.randrange(len(b))
            out += [r.choice([b[:p] + b[p + 1 :], b[:p] + r.choice("abcd") + b[p + 1 :], b[:p] + r.choice("abcd") + b[p:]])] * r.randint(3, 9)
    r.shuffle(out)
    chunk = [" ".join(out[i : i + 40]) for i in range(0, len(out), 40)]
    texts = [None, "", " ", "12345 !?", "établissement ābcdef 中abcdef", "ABCDEF ABCDEF abcdef AbcDef ABCDEF abcdeF", "a" * 3000, *["b" * 3000] * 6, "Établi " * 9, " ".join(out), *chunk, *chunk[:3]]
    return [(None if i % 11 == 3 else i * 7 % 50, t) for i, t in enumerate(texts)]


def test_variants_equal_brute_force(spark):
    docs = word_docs()
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.variants(table, at(spark)).collect()
    want = brute_variants(docs)
    assert sum(r[1] is not None for r in want) > 30 and any(len(r[0]) > 64 and r[4] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got), key=str) == want
    assert spelling.variants(table.filter("false"), at(spark)).count() == 0


def test_runs_of_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer("abcdef abcdeg abcdef abcdefg".encode(), np.uint8)
    start, end = spelling.runs(data, np.array([0, 14, 14, len(data)]))
    assert [bytes(data[a:b]) for a, b in zip(start, end, strict=True)] == [b"abcdef", b"abcdeg", b"abcdef", b"abcdefg"]
    monkeypatch.setattr(spelling.kernels.Hashes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    first, group = spelling.distinct(data, start, end)
    assert group.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_checksums_of_joined_texts():
    sums, texts = spelling.Checksums(), [("12:", "word"), ("", "x"), ("-9:", "été"), ("7:", "a" * 5000)]
    crc = lambda i: np.array([zlib.crc32(t[i].encode()) for t in texts], np.uint32)
    got = sums.joined(crc(0), crc(1), np.array([len(b.encode()) for _, b in texts]))
    assert got.tolist() == [zlib.crc32((a + b).encode()) for a, b in texts]


# Packing --------------------------------------------------------------------------------------


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def check_plan(count, capacity, runs):
    held = np.zeros(capacity + 1, np.int64)
    for lengths, n in runs:
        assert n > 0 and 0 < sum(lengths) <= capacity
        np.add.at(held, lengths, n)
    assert (held == count).all()
    return sum(n for _, n in runs)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_near_the_fewest(seed):
    r = np.random.default_rng(seed)
    capacity = 2048
    lengths = [r.integers(1, 2049, 3000), r.integers(600, 1100, 3000), np.repeat(r.integers(1, 2048, 5), 400), r.choice([683, 682, 1024, 1025, 341], 2000), (r.pareto(1.0, 4000) * 60 + 1).astype(int).clip(1, 2048), np.concatenate([np.full(50_000, 700), r.integers(1, 300, 900)])][seed]
    count = histogram(lengths, capacity)
    n = check_plan(count, capacity, packing.plan(count))
    own = [([capacity], int(count[capacity]))] if count[capacity] else []
    rest = count.copy()
    rest[capacity] = 0
    greedy = sum(k for _, k in own + packing.best_fit([], rest, capacity))
    assert n <= greedy * 1.002 + 2 and n >= -(-int((count * np.arange(capacity + 1)).sum()) // capacity)


def test_best_fit_takes_the_fullest_sequence_with_room():
    for seed in range(20):
        r = random.Random(seed)
        capacity, lengths = 30, [r.randint(1, 20) for _ in range(80)]
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fits = [y for y in rooms if y >= x]
            room = min(fits, default=capacity)
            if fits:
                rooms.remove(room)
            rooms.append(room - x)
        got = packing.best_fit([], histogram(np.array(lengths), capacity), capacity)
        assert sorted(capacity - sum(a) for a, n in got for _ in range(n)) == sorted(rooms)


def test_configurations_of_few_lengths_are_the_fewest():
    for lengths, fewest in (([12] * 30 + [8] * 30, 30), ([11] * 10 + [9] * 10 + [7] * 20 + [6] * 10, 20), ([10] * 40, 20)):
        count = histogram(np.array(lengths), 20)
        assert check_plan(count, 20, packing.plan(count, 20)) == fewest


def test_packing_of_messy_rows(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(["word", "an", "thing", "Xé", "12", "<|endoftext|>"]) for _ in range(n))
    texts = [None, "", text(9000), text(2047), "a", *[text(r.randint(1, 3000)) for _ in range(40)], *["same text"] * 300]
    docs = [(None if k % 9 == 0 else k // 2, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, piece int, offset int").repartition(3)
    got = packing.pack(table, at(spark), public_path(), with_ids=True).cache()
    encode = library()
    want = Counter()
    total = 0
    for i, t in docs:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = got.collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    held = defaultdict(list)
    for x in rows:
        held[x.sequence_id].append((x.offset, x.length))
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32
    for own in held.values():
        own.sort()
        assert [a for a, _ in own] == list(np.cumsum([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= 2048
    assert len(held) <= 1.02 * total / 2048 + 2
    built = packing.sequences(got).collect()
    assert len(built) == len(held) and all(len(x.ids) <= 2048 for x in built) and sum(len(x.ids) for x in built) == total
    assert packing.pack(table.filter("false"), at(spark), public_path()).count() == 0


def test_digest_is_of_decimal_components():
    assert vectors.digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_no_vocabulary_is_sent_to_the_driver(spark):
    """Small files of words are many times their size once salted: no join of op12 may be a broadcast under Spark's own threshold."""
    words = shared.written(spark.createDataFrame([("abcdef", 9), ("abcdeg", 50)], "word string, n long"), f"{at(spark)}/few")
    links = words.select("word", F.lit("abcdeg").alias("root"))
    found = spelling.variants(spark.createDataFrame([(1, "abcdef " * 5 + "abcdeg " * 40)], "doc_id long, text string"), at(spark))
    for df in (spelling.doubled(links), found):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(x.word, x.root, x.moved) for x in spelling.doubled(links).collect()} == {("abcdef", "abcdeg", True), ("abcdeg", "abcdeg", True)}
