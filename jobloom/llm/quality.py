"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``measures`` adds per-document counts, ``judge`` compiles a threshold table into
one Boolean expression over their ratios. All of it stays in Spark's own
expressions and needs no shuffle, so neither a hot source nor a group of copies
matters: each row is judged from its own text.

Defined results: a null text is judged as an empty one; an empty text has 0 words
and fails the length rule; ratios with a zero divisor count as 0; repeated rows
are judged each; an empty table gives no rows; columns of the input whose names
clash with the measures are kept apart (``measures`` returns a struct column
under a name of your choice, in whose place a column of that name goes).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by are this at from or an have not they which "
    "le la les de des du et en un une que qui dans pour sur par au avec est pas "
    "der die das und den von zu mit ist im ein eine nicht auf für dem des sich auch als "
    "el los las y que en un una por con para del se su al lo como es"
).split()
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Words in a window that counts as repeated.
WINDOW = 8
#: Least words, and the most percent of words in repeated windows, of the base verdict.
BASE_WORDS, BASE_REPEAT_PERCENT = 20, 30


class Rule(NamedTuple):
    """``measure`` must lie in [least, most]; None leaves a side open."""

    measure: str
    least: float | None
    most: float | None


#: Production thresholds. No upper limit on words: a long document is no worse for it.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("stutter_ratio", None, 0.3),
    Rule("repeat_ratio", None, 0.3),
)


def _word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def measures(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``df`` with a struct column ``out`` of counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop, n_stutter, n_repeat_words."""
    taken, mark = {c.lower() for c in df.columns}, f"__{out}"
    while any(c.startswith(mark.lower()) for c in taken):
        mark = f"_{mark}"
    t, w, lines, hashes, pos = (f"{mark}_{x}" for x in ("text", "words", "lines", "hashes", "pos"))
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    step = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t))
    step = step.select("*", _word_array(F.col(t)).alias(w), F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias(lines))
    # Hashes of the word windows; a text without equal hashes (most) goes no further.
    step = step.select("*", F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, WINDOW)))).alias(hashes))
    once = F.size(F.array_distinct(hashes)) == F.size(hashes)
    at = F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select("*", F.when(~once, at).alias(pos))
    p = F.col(pos)
    same = lambda a, b: F.get(p, a)["h"] == F.get(p, b)["h"]
    equal = F.filter(p, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    covered = F.aggregate(
        F.array_sort(F.transform(equal, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + (i + WINDOW - F.greatest(a["end"], i))).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    length = lambda c: F.length(c).cast("long")
    found = F.struct(
        F.size(w).cast("long").alias("n_words"),
        length(F.translate(F.col(t), WHITE, "")).alias("word_chars"),
        (length(F.col(t)) - length(F.translate(F.col(t), SYMBOLS, ""))).alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.col(w), lambda x: x.isin([*STOP_WORDS, *(s.capitalize() for s in STOP_WORDS)]))).cast("long").alias("n_stop"),
        F.size(F.filter(F.col(w), lambda x, i: F.coalesce(F.get(F.col(w), i - 1) == x, F.lit(False)))).cast("long").alias("n_stutter"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    # A generator: filters on its column stay above it, instead of being taken apart into the lambdas below.
    return step.select(*keep, F.explode(F.array(found)).alias(out))


def ratios(q: Column) -> dict[str, Column]:
    """The measures that rules name, from a struct of counts."""
    over = lambda a, b: F.coalesce(F.try_divide(q[a].cast("double"), q[b]), F.lit(0.0))
    return {
        "n_words": q["n_words"],
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_ratio": over("n_stop", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "stutter_ratio": over("n_stutter", "n_words"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
    }


def base_failed(q: Column) -> Column:
    return (q["n_words"] < BASE_WORDS) | (100 * q["n_repeat_words"] > BASE_REPEAT_PERCENT * q["n_words"])


def judge(q: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Whether all rules hold, and the names of those that don't."""
    known = ratios(q)
    bad = [(r.measure, F.lit(False) if r.least is None and r.most is None else ~known[r.measure].between(r.least if r.least is not None else float("-inf"), r.most if r.most is not None else float("inf"))) for r in rules]
    failed = F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in bad)))
    kept = F.lit(True)
    for _, x in bad:
        kept &= ~x
    return kept, failed


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """``df`` with a struct column ``out``: the counts, base_failed, kept, failed_rules."""
    step = measures(df, text, out)
    q = F.col(f"`{out}`")
    kept, failed = judge(q, rules)
    base = base_failed(q)
    return step.withColumn(out, F.struct(q["n_words"].alias("n_words"), *(q[x].alias(x) for x in ("word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop", "n_stutter", "n_repeat_words")), base.alias("base_failed"), (~base & kept).alias("kept"), failed.alias("failed_rules")))


def _sql_list(xs) -> str:
    return ", ".join("'" + x + "'" for x in xs)


#: DuckDB: one row per document. Windows are compared as texts.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ws, lambda x: x IN ({_sql_list([*STOP_WORDS, *(s.capitalize() for s in STOP_WORDS)])}))) AS n_stop,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
             coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
             greatest(n_words, 1)::DOUBLE AS nw, greatest(n_lines, 1)::DOUBLE AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 20 AND word_chars / nw BETWEEN 2.0 AND 14.0 AND n_symbols / nw <= 0.1
       AND n_stop / nw >= 0.02 AND n_dup_lines / nl <= 0.4 AND n_stutter / nw <= 0.3 AND n_repeat_words / nw <= 0.3 AS kept
FROM b"""


def op2(spark, sf_dir: str) -> DataFrame:
    """One row per document; see the module for the rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(docs).select("doc_id", *(q[x].alias(x) for x in names))
