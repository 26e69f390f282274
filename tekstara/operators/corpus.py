"""Corpus steps: joined lines, batches, closures over merges, block alignment, training rows, censuses."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_hyphenated(text: Column) -> Column:
    """Lines that end in a hyphen after a letter, put together with the next line."""
    return F.regexp_replace(text, r"(\p{L})-\n\s*(\p{Ll})", "$1$2")


def batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Indexes in batches, longest first, whose padded size (longest times count) stays within the budget; one too long is alone."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        if out and lengths[out[-1][0]] * (len(out[-1]) + 1) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def merge_closure(pieces: DataFrame, merges: DataFrame, most: int = 64) -> DataFrame:
    """Pieces and all parts they are merged from: merges(left, right, merged) are followed down until nothing is new."""
    held = pieces.select("piece").distinct()
    for _ in range(most):
        parts = merges.join(held, F.col("merged") == F.col("piece"), "left_semi").select(F.explode(F.array("left", "right")).alias("piece")).distinct()
        new = parts.join(held, "piece", "left_anti")
        if new.isEmpty():
            return held
        held = held.union(new).checkpoint(eager=True)
    raise ValueError(f"no end after {most} rounds")


def block_aligned(a: DataFrame, b: DataFrame, key: str, pos: str = "pos", item: str = "item") -> DataFrame:
    """key, pos_a, pos_b of items in the longest matching blocks of two sequences of one key (a document)."""
    kind = dict(a.dtypes)[key]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values(pos), y.sort_values(pos)
        found = difflib.SequenceMatcher(None, x[item].tolist(), y[item].tolist(), autojunk=False).get_matching_blocks()
        pairs = [(m.a + k, m.b + k) for m in found for k in range(m.size)]
        return pd.DataFrame({key: [x[key].iloc[0]] * len(pairs), "pos_a": [x[pos].iloc[i] for i, _ in pairs], "pos_b": [y[pos].iloc[j] for _, j in pairs]})

    return a.groupBy(key).cogroup(b.groupBy(key)).applyInPandas(run, f"{key} {kind}, pos_a int, pos_b int")


def complete_groups(left: DataFrame, right: DataFrame, group: str, on: list[str]) -> DataFrame:
    """Groups of ``left`` all of whose rows have a partner in ``right``."""
    marked = left.join(right.select(*on).distinct().withColumn("__hit", F.lit(True)), on, "left")
    return marked.groupBy(group).agg(F.bool_and(F.col("__hit").isNotNull()).alias("ok")).where("ok").select(group)


def labelled_rows(words: DataFrame) -> DataFrame:
    """word, label, form: the default form with an empty label and one row for each variant and label."""
    default = words.where("default_form is not null").select("word", F.lit("").alias("label"), F.col("default_form").alias("form"))
    each = words.select("word", F.explode("variants").alias("v")).select("word", F.explode("v.mi").alias("label"), F.col("v.form").alias("form"))
    return default.unionByName(each).distinct()


def unmarked_words(words: DataFrame, marked: Column) -> DataFrame:
    """Words none of whose forms bears a mark; ``marked`` tests ``form``."""
    forms = words.select("word", F.explode("variants").alias("v")).select("word", F.col("v.form").alias("form"))
    return forms.groupBy("word").agg(F.bool_or(marked).alias("m")).where(~F.col("m")).select("word")
