"""Votes, best rows, keep-first and keep-last, quotas, splits. The four tie policies of best rows are functions of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: the first by ``order``. Map-side combined, so a hot key is no hot task."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: the last by ``order`` (an upsert's survivor)."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*").select(*df.columns)


def majority(df: DataFrame, keys: list[str], value: str, least: int = 1, share: float = 0.0) -> DataFrame:
    """keys, value, votes, total: each key's most frequent value (ties: the least value) with enough votes and share."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    top = counts.groupBy(*keys).agg(F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), F.col(value))).alias("top"), F.sum("votes").alias("total"))
    out = top.select(*keys, f"top.{value}", "top.votes", "total")
    return out.where((F.col("votes") >= least) & (F.col("votes") >= share * F.col("total")))


def unique_top(df: DataFrame, keys: list[str], value: str, score: str, default: Column | str) -> DataFrame:
    """keys, value, resolved: the value with the strictly highest score of at least two rows, else the default."""
    default = F.col(default) if isinstance(default, str) else default
    # how often each score occurs, then the highest one: no list of a key's rows
    each = df.groupBy(*keys, score).agg(F.max(value).alias("__v"), F.count("*").alias("__c"), F.min(default).alias("__d"))
    a = each.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), F.col("__c").alias("c"), F.col("__v").alias("v"))).alias("top"), F.sum("__c").alias("n"), F.min("__d").alias("d"))
    one = F.coalesce((F.col("top.s").isNotNull()) & (F.col("top.c") == 1) & (F.col("n") > 1), F.lit(False))
    return a.select(*keys, F.when(one, F.col("top.v")).otherwise(F.col("d")).alias(value), one.alias("resolved"))


def first_max(df: DataFrame, keys: list[str], value: str, score: str, order: str) -> DataFrame:
    """keys, value: the first row by ``order`` among the highest scores, only where that is above 0."""
    a = df.groupBy(*keys).agg(F.min_by(F.struct(value, score), F.struct(-F.col(score), F.col(order))).alias("top"))
    return a.where(F.col(f"top.{score}") > 0).select(*keys, f"top.{value}")


def unanimous_top(df: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """keys, value: the value that all rows at the highest score share; keys without one are left out."""
    top = df.groupBy(*keys).agg(F.max(score).alias("__m"))
    best = df.join(top, keys).where(F.col(score) == F.col("__m"))
    return best.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).where(F.col("__a").eqNullSafe(F.col("__b"))).select(*keys, F.col("__a").alias(value))


def running_quota(df: DataFrame, key: str, amount: str, quota: float, order: str, width: int = 4096) -> DataFrame:
    """Rows of each key in order until the amounts reach the quota; the row that crosses it is kept.

    ``order`` is a number without ties, amounts aren't negative. Rows are summed over ranges of ``width`` numbers first; only
    ranges that begin below the quota are looked at row by row, each in a task of its own.
    """
    at = F.floor(F.col(order) / width).cast("long")
    ranges = df.groupBy(key, at.alias("__at")).agg(F.sum(amount).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
    open_ = ranges.withColumn("__before", before).where(F.col("__before") < quota).select(F.col(key).alias("__key"), "__at", "__before")
    rows = df.withColumn("__at", at).join(open_, F.col(key).eqNullSafe(F.col("__key")) & (at == open_["__at"])).drop(open_["__at"])
    w = W.partitionBy(key, "__at").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("__s", F.sum(amount).over(w) + F.col("__before")).where(F.col("__s") - F.col(amount) < quota).select(*df.columns)


def hash_split(df: DataFrame, id_col: str, percent: int, seed: str = "") -> DataFrame:
    """Add ``part``: 'held' for about ``percent`` of the ids, by a hash of the id and a seed, else 'train'."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)).cast("binary")), 1, 6), 16, 10).cast("long") % 100
    return df.withColumn("part", F.when(h < percent, "held").otherwise("train"))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key. Spark cuts partitions to k before it shuffles (WindowGroupLimit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vocabulary(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with gapless numbers in their order. For label sets, which one task can sort."""
    return df.select(value).where(F.col(value).isNotNull()).distinct().withColumn("id", F.row_number().over(W.orderBy(value)) - 1)
