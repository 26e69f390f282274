"""Quality rules: a threshold table compiled into Spark projections, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, load

#: Common words of the four languages of the corpus.
STOP_WORDS = "the of and to in a is that for it as with on be la de el que y los en las del un por con der die und den von zu das mit sich des auf le les et des une du qui dans est".split()
#: measure, comparison that fails a document, threshold. The stop-word share counts from 50 words on; shorter texts have 1.
RULES = [
    ("n_words", ">", 100_000),
    ("mean_word_length", "<", 2.0),
    ("mean_word_length", ">", 14.0),
    ("symbol_ratio", ">", 0.25),
    ("stop_ratio", "<", 0.02),
    ("dup_line_ratio", ">", 0.5),
    ("bullet_line_ratio", ">", 0.9),
]


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures and the method's ratios as columns; names of the caller's columns stay free as all new ones
    start from the text alone and are selected by ``quality``."""
    t = F.coalesce(F.col(text), F.lit(""))
    ink = rf"{WORD}"
    df = df.withColumn("__w", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(ink)))
    # hashes of windows of five words; the words' own hashes first, so that each is read once
    df = df.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    n = F.size("__h")
    at = lambda i, k: F.get("__h", i + k)
    df = df.withColumn("__v", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__twice", F.size(F.array_distinct("__v")) < F.size("__v"))
    # windows sorted by hash, then place; one that equals a neighbour occurs twice
    by_hash = F.when(F.col("__twice"), F.array_sort(F.transform("__v", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("__s", by_hash)
    same = lambda s, i, j: F.get("__s", j)["h"] == s["h"]
    repeated = F.filter("__s", lambda s, i: F.coalesce(same(s, i, i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, same(s, i, i - 1)), F.lit(False)))
    df = df.withColumn("__p", F.when(F.col("__twice"), F.array_sort(F.transform(repeated, lambda s: s["i"]))))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("__p", k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *[c for c in df.columns if not c.startswith("__")],
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def verdict(rules: list[tuple[str, str, float]]) -> Column:
    """The rule table as one expression: true if any rule fails."""
    fails = [(F.col(m) < v) if op == "<" else (F.col(m) > v) for m, op, v in rules]
    return reduce(lambda a, b: a | b, fails, F.lit(False))


def quality(df: DataFrame, text: str = "text", id_col: str = "doc_id", rules: list[tuple[str, str, float]] = RULES) -> DataFrame:
    """One row per row of ``df``: base measures, base_failed, the method's ratios and kept.

    Windows are compared by 64-bit hashes. A null text counts as empty: all counts 0, base_failed, not kept. Repeated rows give
    repeated results; an empty table an empty one; other columns of ``df`` are ignored.
    """
    m = measured(df.select(df[id_col].alias(id_col), df[text].alias("text"))).drop("text")
    return judged(m, rules)


def judged(m: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``measured`` rows with ratios and verdicts."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    m = m.withColumns({
        "mean_word_length": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": F.when(F.col("n_words") >= 50, ratio("n_stop_words", "n_words")).otherwise(F.lit(1.0)),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"), "base_failed": base,
    })
    return m.withColumn("kept", ~F.col("base_failed") & ~verdict(rules))


def good_rows(df: DataFrame, text: str = "text", rules: list[tuple[str, str, float]] = RULES) -> DataFrame:
    """The rows of ``df``, all columns, that ``quality`` keeps.

    Rows are let through by ``inline`` of an array of one or none: a filter would be pushed below the projections, and with it
    copies of their expressions into each other's lambda functions.
    """
    m = judged(measured(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"))), rules)
    return m.select(F.inline(F.when(F.col("kept"), F.array("row"))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"))


_W = r"'[^\x20\x09-\x0D]+'"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_W}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_W})) AS l FROM d),
v AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM v),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words >= 50 THEN n_stop_words::DOUBLE / n_words ELSE 1 END AS stop_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_lines > 0 THEN n_bullet_lines::DOUBLE / n_lines ELSE 0 END AS bullet_line_ratio, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({" OR ".join(f"{m} {op} {v}" for m, op, v in RULES)}) AS kept FROM q
"""
