"""Exact document fingerprints over a canonical form, in Spark's own expressions.

Canonical form: Unicode NFKC, then full case folding, then every run of white
space as one blank and none at the ends. The digest is two xxhash64 values with
different seeds (128 bits). Buckets of equal digests with two or more rows are
compared by their bytes; where they hold different canonical texts, each of
these gets its own ordinal, so that equal fingerprints mean equal canonical
texts and the reverse. Only 16-byte digests are shuffled to find such buckets;
texts are compared with a partial minimum and maximum for each bucket, so a
group of copies that holds a third of all rows costs one text a task.

NFKC and case folding are reached as static Java methods through SQL's
``reflect``; no Python runs on the executors.

Defined results: a null text counts as empty; empty texts are equal to each
other; repeated rows get equal fingerprints; extra columns stay as they are;
columns that the operator adds are named by its parameters. The next document
is the next in order of doc_id (null first), ties by the hash of the row; rows
equal in all columns can be told apart by nothing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm import shared


def canonical(text: Column) -> Column:
    """NFKC, case folding, white space as single blanks. ASCII texts skip the two Java calls, which would not alter more than their case."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc, F.lit(True))
    plain = F.octet_length(t) == F.length(t)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(t)).otherwise(folded), r"[\s\u0085   -     　]+", " "))


def wide(text: Column) -> tuple[Column, Column]:
    """128 bits as two 64-bit hashes with different seeds."""
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text)


def as_hex(h1: Column, h2: Column, ordinal: Column | None = None) -> Column:
    text = F.concat(F.lpad(F.lower(F.hex(h1)), 16, "0"), F.lpad(F.lower(F.hex(h2)), 16, "0"))
    return text if ordinal is None else F.concat(text, F.when(ordinal > 0, F.concat(F.lit("-"), ordinal.cast("string"))).otherwise(F.lit("")))


def collisions(texts: DataFrame, digests: DataFrame | None = None, hashed=wide) -> DataFrame | None:
    """From canonical texts ``canon``: h1, h2, check, ordinal of texts whose digest another text has too; None if there are none (as good as always).

    ``digests`` has h1 and h2 of all rows, so that only rows of buckets with two
    or more of them get to the byte comparison; without it all texts do, reduced
    to two a bucket and task before they are shuffled. ``hashed`` can be a poor
    hash in tests.
    """
    keyed = texts.select("canon", *(h.alias(n) for h, n in zip(hashed(F.col("canon")), ("h1", "h2"), strict=True)))
    some = keyed
    if digests is not None:
        shared = digests.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
        some = keyed.join(shared, ["h1", "h2"], "left_semi")
    lo_hi = some.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    mixed = lo_hi.filter("lo <> hi").select("h1", "h2")
    if mixed.isEmpty():
        return None
    different = keyed.join(mixed, ["h1", "h2"], "left_semi").distinct()
    order = Window.partitionBy("h1", "h2").orderBy("canon")
    return different.select("h1", "h2", F.md5(F.col("canon")).alias("check"), (F.row_number().over(order) - 1).alias("ordinal"))


def named(digests: DataFrame, apart: DataFrame | None, h1: str, h2: str, check: str, out: str) -> DataFrame:
    """``digests`` with the fingerprint ``out`` in place of the columns h1, h2 and check."""
    ordinal = F.lit(0)
    if apart is not None:
        own = apart.select(*(F.col(c).alias(f"__{c}") for c in ("h1", "h2", "check", "ordinal")))
        digests = digests.join(own, (F.col(h1) == F.col("__h1")) & (F.col(h2) == F.col("__h2")) & (F.col(check) == F.col("__check")), "left")
        ordinal = F.coalesce("__ordinal", F.lit(0))
    return digests.withColumn(out, as_hex(F.col(h1), F.col(h2), ordinal)).drop(h1, h2, check, "__h1", "__h2", "__check", "__ordinal")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", hashed=wide) -> DataFrame:
    """``df`` with the column ``out`` (in place of one of that name): 32 hex digits, with an ordinal behind them where different texts share a digest."""
    canon = canonical(F.col(f"`{text}`"))
    texts = df.select(canon.alias("canon"))
    digests = texts.select(*(h.alias(n) for h, n in zip(hashed(F.col("canon")), ("h1", "h2"), strict=True)))
    # The frame's own columns travel as one, so none of their names can meet those used here.
    base = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), canon.alias("canon"))
    h1, h2 = hashed(F.col("canon"))
    base = base.select("row", h1.alias("d1"), h2.alias("d2"), F.md5("canon").alias("dm"))
    found = named(base, collisions(texts, digests, hashed), "d1", "d2", "dm", "fingerprint")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), F.col("fingerprint").alias(out))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id (the group's smallest doc_id), n_copies."""
    found = fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).select("doc_id", "fingerprint")
    sizes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    return found.join(sizes, "fingerprint").select("doc_id", "fingerprint", "group_id", "n_copies")


#: Rows that a bin of the order should have; bins at most; sampled ids for each bin, from which the bounds are taken.
BIN_ROWS, BINS, PER_BIN = 4_000, 20_000, 20
_NULL_ID = -(2**63)


def _below(bounds: Column, n: int, x: Column, equal: bool) -> Column:
    """How many of ``n`` sorted bounds are less than ``x`` (``equal``: or equal to it), by halving steps."""
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(max(1, n.bit_length())))))
    at = lambda p, step: F.get(bounds, p + step - 1)
    return F.aggregate(steps, F.lit(0), lambda p, step: p + F.when((at(p, step) <= x) if equal else (at(p, step) < x), step).otherwise(F.lit(0)))


def _binned(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` with __k (the id), __h (hash of the row) and __bin, which rises with (__k, __h).

    Bounds are quantiles of a bounded sample of ids, so bins are even however the
    ids lie; an id that spans several bounds is dealt to their bins by hash. The
    bounds decide only how the work is dealt.
    """
    placed = df.withColumns({"__k": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL_ID)), "__h": F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))})
    count = df.count()
    n = min(BINS, -(-count // rows))
    sample = sorted(r[0] for r in placed.select("__k").sample(min(1.0, PER_BIN * n / count), seed=7).collect()) if n > 1 else []
    bounds = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    if not bounds:
        return placed.withColumn("__bin", F.lit(0))
    known = F.from_json(F.lit(str(bounds)), "array<bigint>")
    low, high = (_below(known, len(bounds), F.col("__k"), e) for e in (False, True))
    placed = placed.withColumns({"__low": low, "__high": high})
    share = F.col("__h").cast("double") / F.lit(2.0**64) + 0.5
    own = F.least(F.floor(share * (F.col("__high") - F.col("__low") + 1)).cast("int"), F.col("__high") - F.col("__low"))
    return placed.withColumn("__bin", F.col("__low") + own).drop("__low", "__high")


def with_next(df: DataFrame, key: str = "doc_id", rows: int = BIN_ROWS) -> DataFrame:
    """``df`` with ``next``: the struct of the following row in order of the integer ``key``, ties by the row's hash (after the last row: the first), without ordering all rows in one task.

    Each bin is ordered by itself and hands its first row to the bin before by a
    join; only the bins' numbers, at most ``BINS``, are put in one order.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    order, row = Window.partitionBy("__bin").orderBy("__k", "__h"), F.struct(*cols)
    inside = _binned(df, key, rows).select("*", F.lead(row).over(order).alias("__next"), F.row_number().over(order).alias("__nth"))
    heads = inside.filter("__nth = 1").select("__bin", row.alias("__head"))
    everywhere = Window.orderBy("__bin")
    before = F.coalesce(F.lag("__bin").over(everywhere), F.last("__bin").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    chain = heads.select("__bin").select("__bin", before.alias("__before"))
    heads = heads.join(chain, "__bin").select("__before", "__head")
    return inside.join(heads, F.col("__bin") == F.col("__before"), "left").select(*cols, F.coalesce("__next", "__head").alias("next"))


#: Ids of rows whose bytes are to be compared that may be broadcast: 32 MB.
BROADCAST_IDS = 2_000_000


def edited(t: Column, after: Column) -> Column:
    """The text, its last half replaced by the first code points of ``after``."""
    half = F.floor(F.length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.length(t) - half), F.substring(after, F.lit(1), half))


def edited_fingerprints(docs: DataFrame, at: str) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and the likeness (1 or 0: the digest is exact). ``at``: a shared folder for the digests.

    Whole texts are shuffled once, to meet the next one; of the byte comparison
    only those whose digest occurs twice are moved.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    clean = docs.select("doc_id", t.alias("t"))
    keys = {"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "th": F.xxhash64("t")}  # a row is known by id and text
    pairs = with_next(clean).withColumns(keys).withColumns({"next_k": F.coalesce(F.col("next.doc_id").cast("long"), F.lit(_NULL_ID)), "next_t": F.col("next.t")})
    names = ("doc_id", "k", "th", "next_k", F.xxhash64("next_t").alias("next_th"))
    canon = pairs.withColumn("edited", edited(F.col("t"), F.col("next_t"))).select(*names, F.length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("t")).alias("c"), canonical(F.col("edited")).alias("ec"), canonical(F.col("next_t")).alias("nc"))
    (h1, h2), (e1, e2), (n1, n2) = wide(F.col("c")), wide(F.col("ec")), wide(F.col("nc"))
    columns = {"h1": h1, "h2": h2, "hm": F.md5("c"), "e1": e1, "e2": e2, "em": F.md5("ec"), "n1": n1, "n2": n2, "nm": F.md5("nc")}
    digests = shared.written(canon.select("doc_id", "k", "th", "next_k", "next_th", "n_chars", "edited_sha256", *(v.alias(k) for k, v in columns.items())), f"{at}/digests")
    shared.free_shuffles(spark)
    both = digests.select("h1", "h2").unionAll(digests.select(F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    twice = shared.written(both.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), f"{at}/twice")
    own_ids = digests.join(twice, ["h1", "h2"], "left_semi").select("k", "th").distinct()
    edit_ids = digests.join(twice.toDF("e1", "e2"), ["e1", "e2"], "left_semi").select("k", "th", "next_k", "next_th").distinct()
    few = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    clean = clean.withColumns(keys)
    own = clean.join(few(own_ids), ["k", "th"], "left_semi").select(canonical(F.col("t")).alias("canon"))
    wanted = shared.written(edit_ids, f"{at}/edits")
    some, rows = digests.agg(F.countDistinct("k", "th"), F.count("*")).first()
    once = lambda df, *on: df if some == rows else df.dropDuplicates([*on])
    heads = once(clean.join(few(wanted.select("k", "th").distinct()), ["k", "th"], "left_semi"), "k", "th").join(few(wanted), ["k", "th"]).select("next_k", "next_th", "t")
    tails = clean.select(F.col("k").alias("next_k"), F.col("th").alias("next_th"), F.col("t").alias("next_t"))
    tails = once(tails.join(few(wanted.select("next_k", "next_th").distinct()), ["next_k", "next_th"], "left_semi"), "next_k", "next_th")
    apart = collisions(own.unionAll(heads.join(tails, ["next_k", "next_th"]).select(canonical(edited(F.col("t"), F.col("next_t"))).alias("canon"))))
    out = digests
    for keys, name in ((("h1", "h2", "hm"), "fingerprint"), (("e1", "e2", "em"), "edited_fingerprint"), (("n1", "n2", "nm"), "next_fingerprint")):
        out = named(out, apart, *keys, name)
    like = lambda x: F.when(F.col("fingerprint") == F.col(x), 1.0).otherwise(0.0)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_fingerprints(docs, shared.folder(spark, "op4"))
