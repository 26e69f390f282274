"""Metrics: distributions, histograms, coverage, agreement patterns and strata, confusion, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import safe_rate


def distribution(df: DataFrame, key: str, amount: str | None = None) -> DataFrame:
    """key, n, share of the total."""
    n = F.count("*") if amount is None else F.sum(amount)
    counts = df.groupBy(key).agg(n.alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def histogram(value: Column, bounds: list[float]) -> Column:
    """Number of the bin whose upper bound (exclusive) is the first above the value; the last bin is open."""
    out = F.when(value < bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(value < b, i)
    return out.otherwise(len(bounds))


def coverage_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_a, n_b, diff over all keys of either side; a missing side counts 0."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("n_a")), b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    both = x.join(y, keys, "full_outer").fillna(0, ["n_a", "n_b"])
    return both.withColumn("diff", F.col("n_a") - F.col("n_b"))


def accuracy(df: DataFrame, keys: list[str], gold: str, predicted: str) -> DataFrame:
    """keys, total, answered, exact, with both shares in use: of all rows and of answered ones."""
    exact = F.count_if(F.col(gold) == F.col(predicted))
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count(predicted).alias("answered"), exact.alias("exact"))
    return out.withColumn("exact_of_all", safe_rate("exact", "total")).withColumn("exact_of_answered", safe_rate("exact", "answered"))


def pattern(layers: list[str]) -> Column:
    """Agreement pattern of layers (columns of forms, null: no answer), named in their order.

    Layers with the same form are one group, names joined by ``+``; groups stand by size, then earliest layer, then form, and
    are joined by `` vs ``. A single layer alone is ``name-only``; no layer gives ``none``.
    """
    rows = F.filter(F.array(*[F.struct(F.col(c).alias("form"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(layers)]), lambda r: r["form"].isNotNull())
    forms = F.array_distinct(F.transform(rows, lambda r: r["form"]))

    def group(form: Column) -> Column:
        own = F.filter(rows, lambda r: r["form"] == form)
        names = F.array_join(F.transform(own, lambda r: r["name"]), "+")
        return F.struct((-F.size(own)).alias("size"), F.get(own, 0)["i"].alias("i"), form.alias("form"), names.alias("names"))

    groups = F.array_sort(F.transform(forms, group))
    joined = F.array_join(F.transform(groups, lambda g: g["names"]), " vs ")
    return F.when(F.size(rows) == 0, "none").when(F.size(rows) == 1, F.concat(joined, F.lit("-only"))).otherwise(joined)


def strata(df: DataFrame, pattern_col: str, correct: Column) -> DataFrame:
    """pattern, count, correct, accuracy, share."""
    out = df.groupBy(pattern_col).agg(F.count("*").alias("count"), F.count_if(correct).alias("correct"))
    return out.withColumn("accuracy", safe_rate("correct", "count")).withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy()))


def accepted(df: DataFrame, table: DataFrame, pattern_col: str, threshold: float) -> DataFrame:
    """``df`` with its stratum's accuracy and whether that reaches the threshold; an unseen pattern isn't accepted."""
    small = table.select(pattern_col, F.col("accuracy").alias("stratum_accuracy"))
    return df.join(small, pattern_col, "left").withColumn("accepted", F.coalesce(F.col("stratum_accuracy") >= threshold, F.lit(False)))


def confusion(a: Column, b: Column) -> Column:
    """both_bare, only_a, only_b, agree or disagree."""
    return F.when(a.isNull() & b.isNull(), "both_bare").when(b.isNull(), "only_a").when(a.isNull(), "only_b").when(a == b, "agree").otherwise("disagree")


def parity(a_forms: Column, a_default: Column, b_forms: Column, b_default: Column, norm_delta: Column) -> Column:
    """Bucket of a reference entry (a) against a generated one (b; null forms: no entry)."""
    same = F.array_sort(a_forms) == F.array_sort(b_forms)
    return (
        F.when(b_forms.isNull(), "UNCOVERED").when(same & a_default.eqNullSafe(b_default), "EXACT").when(a_default == b_default, "DEFAULT-MATCH")
        .when(F.arrays_overlap(a_forms, b_forms), "OVERLAP").when(norm_delta, "NORM-DELTA").otherwise("DISJOINT")
    )


def fixed_domain(counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts over a fixed domain: absent values with 0."""
    domain = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return domain.join(counts, key, "left").fillna(0)


def audited(df: DataFrame, overlay: DataFrame, observed: DataFrame, word: str = "word", gold: str = "gold") -> DataFrame:
    """Gold tokens with the forms that count as right after an audit, and flags.

    Actions by word: replace (the given forms, or gold if none), accept-also (both), accept-any-observed (all forms seen for
    the word), exclude (row dropped), unmarked-ok (``optional``: left out of denominators); others leave gold alone.
    """
    seen = observed.groupBy(word).agg(F.collect_set("form").alias("__seen"))
    both = df.join(overlay.select(word, "action", "accept"), word, "left").join(seen, word, "left")
    own = F.array(F.col(gold))
    given = F.coalesce("accept", F.array().cast("array<string>"))
    forms = F.when((F.col("action") == "replace") & (F.size(given) > 0), given).when(F.col("action") == "accept-also", F.array_union(own, given))
    forms = forms.when(F.col("action") == "accept-any-observed", F.array_union(own, F.coalesce("__seen", own))).otherwise(own)
    out = both.where(F.coalesce(F.col("action") != "exclude", F.lit(True)))
    return out.withColumn("right", F.array_sort(forms)).withColumn("optional", F.coalesce(F.col("action") == "unmarked-ok", F.lit(False))).drop("accept", "__seen")
