"""Grouping of spelling variants: words one edit apart, found without pairs.

Words are counted in Arrow batches: a batch's runs are told apart by their bytes,
each different run is one row with its number, and Spark adds the rows up.

Words one replacement apart share a wildcard (position, prefix, suffix). A
wildcard group keeps its size and its two most frequent words: each of its words
is near all the others, and the most frequent of these is the first word, or the
second for the first itself. A group has at most as many words as there are
letters. Words one insertion or deletion apart meet where the longer one's
deletions (one for each run of equal letters) join the vocabulary: the shorter
word gets the group's size and top word, each deletion the shorter word. Two words
meet in one place at most, so sizes add up; no pair is ever a row. Each word
makes as many rows as it has letters, dealt out by hash.

A form is at least ``RATIO`` times as frequent as its variant, so forms have no
cycles, and a chain has at most log(largest count) / log(RATIO) links; roots are
found by doubling, in the logarithm of that many joins, salted as a root may have
many variants.

Keys of ``LONG`` letters or more, which would grow with the square of a word's
length, are shuffled as 128-bit digests.

Defined results: a null text has no words; a null doc_id counts as an empty id in
the hash; repeated rows count each; ties in number go to the smaller word in
code-point order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm import kernels, shared
from jobloom.llm.kernels import ragged

#: Shortest word, fewest occurrences, how much more frequent a form is, one run in how many loses a letter.
SHORTEST, FEWEST, RATIO, ONE_IN = 6, 5, 5, 199
#: Letters from which a key goes by its digest; salts of the join of roots; different runs that a task holds.
LONG, SALTS, HELD = 64, 16, 400_000

# Runs: ASCII letters and U+00C0 to U+00FF, which in UTF-8 are the bytes C3 80 to C3 BF.
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# CRC-32 of "<id>:<word>" from those of its two parts --------------------------------------------


def _zeros_table(n: int) -> np.ndarray:
    """For each byte of a CRC register, what ``n`` zero bytes behind it make of each value: CRC-32 is linear."""
    one = np.array([zlib.crc32(bytes(n), 1 << i) ^ zlib.crc32(bytes(n), 0) for i in range(32)], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            table[k, 1 << bit : 2 << bit] = table[k, : 1 << bit] ^ one[8 * k + bit]
    return table


class Checksums:
    """CRC-32 of prefixes followed by words of known CRC and length."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def joined(self, head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of each head's text followed by each tail's (``length`` bytes)."""
        out = tail.copy()
        for n in np.unique(length).tolist():
            table = self.tables.get(n)
            if table is None:
                table = _zeros_table(n)
                if n <= 4096:
                    self.tables[n] = table
            at = np.flatnonzero(length == n)
            h = head[at]
            out[at] ^= table[0, h & 255] ^ table[1, h >> 8 & 255] ^ table[2, h >> 16 & 255] ^ table[3, h >> 24]
        return out


# Runs of a batch -------------------------------------------------------------------------------


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters; none crosses a text's end."""
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = letter[edge]
    last[edge - 1] = letter[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of equal byte ranges, number of its group for each range); ranges of one hash are compared byte by byte."""
    _, first, group = np.unique(kernels.Hashes(data).of(start, end), return_index=True, return_inverse=True)
    size = end - start
    differ = size != size[first[group]]
    for a in range(0, len(start), 1 << 16):
        at = np.flatnonzero(~differ[a : a + (1 << 16)]) + a
        unequal = data[ragged(start[at], size[at])] != data[ragged(start[first[group[at]]], size[at])]
        if unequal.any():
            differ[at[np.searchsorted(np.cumsum(size[at]), np.flatnonzero(unequal), "right")]] = True
    if differ.any():  # two words of one hash
        own: dict[bytes, int] = {}
        group = np.array([own.setdefault(data[a:b].tobytes(), len(own)) for a, b in zip(start, end, strict=True)])
        first = np.unique(group, return_index=True)[1]
    return first, group


def _counted(shortest: int, one_in: int):
    """Rows (id, text) -> (word, n), words of each task added up as far as ``HELD`` goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, found = Checksums(), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in kernels.pieces(batches, "text"):
            data, off = kernels.column(batch.column("text"))
            start, end = runs(data, off)
            data = _LOWER[data]
            leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
            letters = end - start - (leads[end] - leads[start])
            some = letters >= shortest  # a shorter run has no word, whole or cut
            start, end, letters = start[some], end[some], letters[some]
            if not len(start):
                continue
            first, group = distinct(data, start, end)
            words = [data[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("id").to_pylist()], np.uint32)
            tails = np.array([zlib.crc32(w) for w in words], np.uint32)
            h = sums.joined(heads[np.searchsorted(off, start, "right") - 1], tails[group], end - start)
            cut = h % np.uint32(one_in) == 0
            for w, n in zip(words, np.bincount(group[~cut], minlength=len(words)).tolist(), strict=True):
                if n:
                    found[w] += n
            for g, place, n in zip(group[cut].tolist(), (h[cut] % letters[cut].astype(np.uint32)).tolist(), letters[cut].tolist(), strict=True):
                if n > shortest:
                    w = words[g].decode()
                    found[(w[:place] + w[place + 1 :]).encode()] += 1
            if len(found) >= HELD:
                yield rows()
        if found:
            yield rows()

    return work


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of the words of all whole texts that occur ``fewest`` times or more."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_counted(shortest, one_in), "word binary, n long")
    return found.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


# Near words ------------------------------------------------------------------------------------


def _short(key: Column) -> Column:
    """The key itself, or of a long one its digest (behind a sign that no word has)."""
    return F.when(F.length(key) < LONG, key).otherwise(F.concat(F.lit("#"), F.md5(key)))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word of the most frequent near word) of every word of (word, n) with a near word."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("place"))
    top = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    # Replacements: (position, prefix, suffix).
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc("n"), "word")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prefix, suffix = F.substr(F.col("word"), F.lit(1), F.col("place")), F.substr(F.col("word"), F.col("place") + 2)
    wild = places.select("word", "n", _short(F.concat(prefix, F.lit("*"), suffix)).alias("key"))
    wild = wild.select("word", F.count("*").over(every).alias("size"), F.row_number().over(order).alias("rank"), F.first(top).over(every).alias("first"), F.nth_value(top, 2).over(every).alias("second"))
    wild = wild.filter("size > 1").select("word", (F.col("size") - 1).alias("near"), F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")).alias("best"))
    # Deletions of the longer word that are words: one place of each run of equal letters.
    cut = places.filter(F.substr(F.col("word"), F.col("place") + 1, F.lit(1)) != F.substr(F.col("word"), F.col("place") + 2, F.lit(1)))
    cut = cut.select(_short(F.concat(prefix, suffix)).alias("key"), F.lit(None).cast("long").alias("own"), top.alias("longer"), F.lit(None).cast("string").alias("shorter"))
    whole = words.select(_short(F.col("word")).alias("key"), F.col("n").alias("own"), F.lit(None).cast(cut.schema["longer"].dataType).alias("longer"), F.col("word").alias("shorter"))
    met = cut.unionAll(whole).select("*", F.max("own").over(group).alias("n_short"), F.max("shorter").over(group).alias("short"), F.count("longer").over(group).alias("size"), F.min("longer").over(group).alias("top"))
    met = met.filter("n_short IS NOT NULL AND size > 0")
    indel = met.select(
        F.coalesce("longer.word", "short").alias("word"),
        F.when(F.col("own").isNull(), F.lit(1).cast("long")).otherwise(F.col("size")).alias("near"),
        F.when(F.col("own").isNull(), F.struct((-F.col("n_short")).alias("minus"), F.col("short").alias("word"))).otherwise(F.col("top")).alias("best"),
    )
    return wild.unionByName(indel).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def doubled(now: DataFrame) -> DataFrame:
    """(word, root, moved): each root's own root.

    Never a broadcast, for which Spark would take the files' size: it does not see the
    salts, and a small file of words is many times its size in the driver's memory.
    """
    ahead = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
    rows = now.withColumn("__own", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    step = rows.join(ahead.hint("merge"), (F.col("root") == F.col("__at")) & (F.col("__own") == F.col("__salt")), "left")
    return step.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))


def roots(forms: DataFrame, at: str) -> DataFrame:
    """(word, root) of every row of (word, form): where following forms ends."""
    now = shared.written(forms.select("word", F.col("form").alias("root")), f"{at}/roots0")
    for k in range(1, 64):
        step = shared.written(doubled(now), f"{at}/roots{k}")
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            break
    return now


def variants(docs: DataFrame, at: str, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO, one_in: int = ONE_IN) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents. ``at``: a shared folder."""
    words = shared.written(vocabulary(docs, shortest, fewest, one_in), f"{at}/words")
    near = near_words(words)
    found = words.join(near.hint("merge"), "word", "left")
    strong = -F.col("best.minus") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    found = shared.written(found, f"{at}/near")
    ends = roots(found.filter("form IS NOT NULL"), at)
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    """DuckDB: the same words and their neighbours from wildcards and deletions; CRC-32 as a fold over bytes."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, table_of[xor(c & 255, x) + 1])), 4294967295)"
    key = lambda mark: f"substr(word, 1, p) || '{mark}' || substr(word, p + 2)"
    return f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS table_of FROM bits WHERE k = 8),
e AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM e WHERE length(run) >= {SHORTEST} GROUP BY ALL),
h AS (SELECT run, n, flatten(list_transform(list_transform(string_split(s, ''), lambda x: unicode(x)), lambda x: CASE WHEN x < 128 THEN [x::BIGINT] ELSE [195::BIGINT, x::BIGINT - 64] END)) AS b FROM r),
g AS (SELECT run, n, {crc} AS h FROM h, t),
c AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM g),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {FEWEST}),
x AS (SELECT DISTINCT word, {key('*')} AS wild, {key('')} AS cut, p FROM w, LATERAL (SELECT unnest(range(length(word))) AS p)),
pairs AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.wild = b.wild AND a.word <> b.word
          UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
y AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY w.n DESC, p.near) AS best, max(w.n) AS best_n FROM pairs p JOIN w ON p.near = w.word GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END::BIGINT AS form_n FROM w LEFT JOIN y USING (word)),
o AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT o.word, o.next, f.form FROM o JOIN f ON o.next = f.word)
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o ON o.word = f.word AND o.next IS NULL"""


SQL = _sql()


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shared.folder(spark, "op12"))
