"""Choosing among a word's accented variants by a tagged token, and probabilities over readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lithuanian as lt
from ..functions.tags import parse_label, score

# Fixed values: (word, lemma) pairs whose form doesn't follow from tags.
LEMMA_FORMS = {("yra", "būti"): "yrà", ("yra", "irti"): "ỹra"}


def best_label_score(labels: Column, context: Column) -> Column:
    """The highest score of a variant's labels against the context; 0 without labels."""
    return F.coalesce(F.array_max(F.transform(labels, lambda x: score(parse_label(x), context))), F.lit(0))


def pick(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, index, resolved_by: the chosen variant of each token.

    ``df`` has a row a variant: keys, word, lemma, index, form, labels, default_form, context (slots, null without a token). A
    fixed pair of word and lemma decides first ('lemma'); else the score, if it is strictly the highest of at least two
    ('context'); else the default form's variant, or the first.
    """
    pairs = F.create_map(*[F.lit(x) for (w, g), f in LEMMA_FORMS.items() for x in (f"{w}\0{g}", f)])
    wanted = F.try_element_at(pairs, F.concat(F.lower("word"), F.lit("\0"), F.coalesce("lemma", F.lit(""))))
    scored = df.withColumn("__s", F.when(F.col("context").isNotNull(), best_label_score(F.col("labels"), F.col("context")))).withColumn("__w", (F.col("form") == wanted) & F.col("context").isNotNull())
    a = scored.groupBy(*keys).agg(
        F.min(F.when(F.col("__w"), F.col("index"))).alias("__lemma"), F.min(F.when(F.col("form") == F.col("default_form"), F.col("index"))).alias("__default"), F.min("index").alias("__first"),
        F.array_sort(F.collect_list(F.struct((-F.col("__s")).alias("s"), F.col("index").alias("i"))), lambda x, y: F.when(x["s"] < y["s"], -1).when(x["s"] > y["s"], 1).otherwise(x["i"] - y["i"])).alias("__all"),
    )
    top, second = F.get("__all", 0), F.get("__all", 1)
    context = F.when(top["s"] < second["s"], top["i"])
    return a.select(*keys, F.coalesce("__lemma", context, F.col("__default"), F.col("__first")).alias("index"), F.when(F.col("__lemma").isNotNull(), "lemma").when(context.isNotNull(), "context").alias("resolved_by"))


def merged_probabilities(df: DataFrame, keys: list[str], logit: str, label: str, floor: float = 0.1, most: int = 5) -> DataFrame:
    """keys, label, p, ambiguous, resolved: softmax over all rows, rows at or under the floor dropped, equal labels summed, the
    best ``most`` kept. Ambiguous: two or more above the floor; resolved: one at 0.9 or more."""
    top = df.groupBy(*keys).agg(F.max(logit).alias("__m"), F.collect_list(logit).alias("__l"))
    total = top.select(*keys, "__m", F.aggregate("__l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__m"))).alias("__t"))
    p = df.join(total, keys).withColumn("p", F.exp(F.col(logit) - F.col("__m")) / F.col("__t")).where(F.col("p") > floor)
    rows = p.groupBy(*keys, label).agg(F.sum("p").alias("p"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col(label).alias("label"), F.col("p")))), 1, most)
    out = rows.groupBy(*keys).agg(listed.alias("__r"))
    flags = out.withColumn("ambiguous", F.size("__r") >= 2).withColumn("resolved", F.size(F.filter("__r", lambda r: r["p"] >= 0.9)) == 1)
    return flags.select(*keys, F.explode("__r").alias("__x"), "ambiguous", "resolved").select(*keys, F.col("__x.label").alias(label), "__x.p", "ambiguous", "resolved")


def best_labels(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label: of rows (keys, label, s, extra) the label with the highest score, then the fewest spurious slots, then the least
    text; null where no score is above 0."""
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("extra"), F.col("label"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.s") < 0, F.col("b.label")).alias("label"))


def decoded(df: DataFrame, word: str, logits: str, none: Column) -> DataFrame:
    """Add ``letter`` and ``mark``: the likeliest place that the word may bear a mark at, if it is likelier than ``none``.

    ``logits`` is flat, grave, acute and tilde for each letter in turn. Where marks may stand is worked out once a distinct word;
    the choice itself is an expression over arrays. At equal logits the first place counts.
    """

    def places(w: str | None) -> list[int]:
        n = len(lt.clusters(lt.strip_stress(w) or "")) if w else 0
        return [3 * i + k for i in range(n) for k, m in enumerate(lt.MARKS) if lt.may_carry(w, i, m)]

    masked = lt.map_distinct(df, word, places, "__places", "array<int>")
    each = F.transform(F.filter("__places", lambda i: i < F.size(logits)), lambda i: F.struct(F.get(logits, i).cast("double").alias("x"), (-i).alias("i")))
    best = masked.withColumn("__best", F.array_max(each)).withColumn("__at", F.when(F.col("__best.x") > none.cast("double"), -F.col("__best.i")))
    out = best.withColumn("letter", F.floor(F.col("__at") / 3).cast("int")).withColumn("mark", F.get(F.array(*[F.lit(m) for m in lt.MARKS]), F.col("__at") % 3))
    return out.drop("__places", "__best", "__at")
