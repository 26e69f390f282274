"""Spelling: fold, deletion and bigram indexes; ranked corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType

from ..functions.lithuanian import osa
from ..functions.text import deletes1, deletes2, fold_ascii, match_case


def bigrams(df: DataFrame, tokens: str = "tokens", vocabulary: DataFrame | None = None, token: str = "token", least: int = 2) -> DataFrame:
    """w1, w2, n of adjacent tokens; a token outside the vocabulary breaks the run.

    ``df`` has a row a text with its ``tokens`` in order. Neighbours are paired in the array, so nothing is shuffled but counts;
    a pair counts if the vocabulary has both its words, which is looked up once for each distinct pair.
    """
    w = F.col(tokens)
    pairs = df.where(F.size(w) > 1).select(F.inline(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("w1"), F.slice(w, F.lit(2), F.size(w) - 1).alias("w2"))))
    counts = pairs.groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    for c in ("w1", "w2") if vocabulary is not None else ():
        counts = counts.join(vocabulary.select(F.col(token).alias(c)).distinct(), c, "left_semi")
    return counts.select("w1", "w2", "n")


def fold_index(words: DataFrame, form: str = "form") -> DataFrame:
    return words.withColumn("fold", fold_ascii(form))


def delete_index(words: DataFrame, form: str = "form", least_freq: int = 5) -> DataFrame:
    """One row per form, at a deletion of up to two characters or as it is; rare forms are no corrections."""
    keys = F.array_distinct(F.concat(F.array(F.col(form)), deletes1(form), deletes2(form)))
    return words.where(F.col("freq") >= least_freq).withColumn("deletion", F.explode(keys))


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)])


def substitutions(a: Column, b: Column) -> Column:
    """Differing characters of equally long strings, at most 3."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.least(F.aggregate(pairs, F.lit(0), lambda s, x: s + x), F.lit(3))


def restored(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of plain-ASCII ``asked`` (qid, low, known, own) with each form that restores them, its freq and distance."""
    marked = fold_index(words).where("form <> fold")
    restore = asked.where(F.col("low").rlike("^[\\x00-\\x7f]+$")).withColumn("fold", F.col("low")).join(marked, "fold").where("form <> low")
    restore = restore.withColumn("distance", substitutions(F.col("low"), F.col("form"))).drop("fold")
    restore = restore.withColumn("most", F.max("freq").over(W.partitionBy("qid")))
    strong = (F.col("most") >= 100) & (F.col("most") >= 8 * F.greatest("own", F.lit(1)))
    return restore.where(~F.col("known") | strong).drop("most").withColumn("kind", F.lit("restore"))


def listed(found: DataFrame, top: int, *key: str) -> DataFrame:
    """The key columns (the first is one), kind, corrections in order and autofix of rows with word, kind, form, freq, distance and context."""
    marked = F.length(F.regexp_replace("form", "[\\x00-\\x7f]", ""))
    restoring = F.col("kind") == "restore"
    keys = [F.when(restoring, -F.col("context")).otherwise(F.col("distance")), F.when(restoring, -F.col("freq")).otherwise(-F.col("context")), F.when(restoring, F.col("distance")).otherwise(-F.col("freq")), marked, F.length("form"), F.collate(F.col("form"), "LT"), F.col("form")]
    w = W.partitionBy(key[0]).orderBy(*keys)
    ranked = found.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("freq").over(w)).where(F.col("rank") <= top)
    return ranked.groupBy(*key).agg(
        F.min("kind").alias("kind"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", match_case("form", "word").alias("form")))), lambda x: x["form"]).alias("corrections"),
        F.max(F.when((F.col("rank") == 1) & (F.col("second").isNull() | ((F.col("freq") > 0) & (F.col("freq") >= F.greatest(8 * F.col("second"), F.col("second") + 1)))), match_case("form", "word"))).alias("autofix"),
    )


def suggest(queries: DataFrame, words: DataFrame, pairs: DataFrame | None = None, top: int = 8) -> DataFrame:
    """kind (ok, restore, typo, unknown), ranked corrections and autofix of each query.

    ``queries``: qid, word, prev, next. A plain-ASCII query is first looked up by its fold: a form with at least 100 uses and
    eight times those of the query itself, or any form if the query is no word, restores it, ranked by context, frequency and
    substitutions. A known word is ok, a capitalised unknown one unknown. Else forms that share a deletion and are within
    distance 2 are typos' corrections, ranked by distance, context and frequency. Then fewer diacritics, length and text decide.
    Autofix: the only correction, or one whose frequency is eight times the next one's. Queries under two letters are ok.
    """
    q = queries.withColumn("low", F.lower("word"))
    own = words.select(F.col("form").alias("low"), F.col("freq").alias("own"))
    q = q.join(own, "low", "left").withColumn("known", F.col("own").isNotNull()).fillna(0, ["own"])
    long = q.where(F.length("low") >= 2)
    restore = restored(long, words)
    first = F.substring("word", 1, 1)
    open_ = long.where(~F.col("known") & (F.upper(first) != first)).join(restore.select("qid").distinct(), "qid", "left_anti")
    # by distinct words, not by queries: deletions of a word are met once, without its contexts
    keys = F.array_distinct(F.concat(F.array(F.col("low")), deletes1("low"), deletes2("low")))
    near = open_.select("low").distinct().withColumn("deletion", F.explode(keys)).join(delete_index(words.select("form", "freq")), "deletion").select("low", "form", "freq").distinct()
    near = near.withColumn("distance", osa_distance("low", "form")).where((F.col("distance") <= 2) & (F.col("form") != F.col("low")))
    typo = open_.join(near, "low").withColumn("kind", F.lit("typo"))
    found = restore.unionByName(typo)
    context = F.lit(0)
    if pairs is not None:
        before, after = (pairs.select(F.col(a).alias(b), F.col(c).alias("form"), F.col("n").alias(n)) for a, b, c, n in (("w1", "prev", "w2", "nb"), ("w2", "next", "w1", "na")))
        found = found.join(before, ["prev", "form"], "left").join(after, ["next", "form"], "left")
        context = F.coalesce("nb", F.lit(0)) + F.coalesce("na", F.lit(0))
    ranked = listed(found.withColumn("context", context), top, "qid")
    kind = F.coalesce("kind", F.when(F.col("known") | (F.length("low") < 2), "ok").otherwise("unknown"))
    return q.join(ranked, "qid", "left").select("qid", "word", kind.alias("kind"), F.coalesce("corrections", F.array().cast("array<string>")).alias("corrections"), "autofix")
