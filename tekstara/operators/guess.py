"""Guessers for unknown words: suffix majority tables and prefix-free rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import majority


def suffix_table(words: DataFrame, word: str, value: str, longest: int = 10, least: int = 2) -> DataFrame:
    """suffix, value, votes: the most frequent value of each suffix, seen often enough unless one letter long."""
    n = F.least(F.length(word), F.lit(longest))
    cut = words.where(F.length(word) > 0).select(value, F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.right(F.col(word), k))).alias("suffix"))
    return majority(cut, ["suffix"], value).where((F.col("total") >= least) | (F.length("suffix") == 1))


def by_suffix(words: DataFrame, table: DataFrame, word: str, value: str, longest: int = 10) -> DataFrame:
    """word, value, suffix: the value of the longest suffix in the table; words without one are left out."""
    n = F.least(F.length(word), F.lit(longest))
    cut = words.select(word).where(F.length(word) > 0).distinct().select(word, F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.right(F.col(word), k))).alias("suffix"))
    found = cut.join(table.select("suffix", value), "suffix")
    return found.groupBy(word).agg(F.max_by(F.struct(value, "suffix"), F.length("suffix")).alias("r")).select(word, f"r.{value}", "r.suffix")


def prefix_rules(words: DataFrame, word: str, value: str) -> DataFrame:
    """prefix, value: shortest prefixes (of word and end mark) all of whose words share the value; no rule's prefix begins another's."""
    ended = F.concat(F.col(word), F.lit("#"))
    every = words.select(value, ended.alias("w")).select(value, F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.left(F.col("w"), k))).alias("prefix"))
    # null values are values of their own here
    sure = every.groupBy("prefix").agg(F.min(value).alias(value), F.max(value).alias("__m"), F.count(value).alias("__k"), F.count("*").alias("__n"))
    sure = sure.where(F.col(value).eqNullSafe(F.col("__m")) & ((F.col("__k") == 0) | (F.col("__k") == F.col("__n")))).select("prefix", value)
    # a rule is shortest if its prefix less one letter isn't sure
    shorter = sure.select(F.col("prefix").alias("__p"))
    parent = F.left("prefix", F.length("prefix") - 1)
    return sure.join(shorter, parent == F.col("__p"), "left_anti")


def by_prefix(words: DataFrame, rules: DataFrame, word: str, value: str) -> DataFrame:
    """word, value, prefix of the one rule that applies; others are left out."""
    ended = F.concat(F.col(word), F.lit("#"))
    cut = words.select(word).distinct().select(word, F.explode(F.transform(F.sequence(F.lit(1), F.length(ended)), lambda k: F.left(ended, k))).alias("prefix"))
    return cut.join(rules, "prefix").select(word, value, "prefix")
