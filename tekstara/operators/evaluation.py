"""Evaluation: verdicts on predicted forms, families of accuracies, layers, thresholds, guards, disagreements, span scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import stress
from ..functions.text import safe_rate


def exact(gold: Column, said: Column) -> Column:
    return F.coalesce(gold == said, F.lit(False))


def exact_any(options: Column, said: Column) -> Column:
    return F.coalesce(F.array_contains(options, said), F.lit(False))


def position(gold: Column, said: Column) -> Column:
    """Whether both are stressed on the same letter, or neither is."""
    return F.coalesce(said.isNotNull() & stress.place(gold).eqNullSafe(stress.place(said)), F.lit(False))


def position_any(options: Column, said: Column) -> Column:
    return F.coalesce(said.isNotNull() & F.exists(options, lambda o: stress.place(o).eqNullSafe(stress.place(said))), F.lit(False))


def unmarked(said: Column) -> Column:
    """An abstention or an answer without a mark."""
    return said.isNull() | (stress.marks(said) == 0)


def guarded(word: Column, said: Column) -> Column:
    """An answer that reduces to the word; else none."""
    return F.when(F.lower(stress.bare(said)) == F.lower(word), said)


def one_mark(word: Column, said: Column) -> Column:
    """An engine's answer if it has exactly one mark and is the word otherwise; else it abstains."""
    return F.when((stress.marks(said) == 1) & (stress.bare(said) == word), said)


def confident(said: Column, p: Column, least: float) -> Column:
    return F.when(p >= least, said)


def option_forms(word: Column, options: Column) -> Column:
    """Forms of (index, mark) pairs of a word: the mark goes on the letter of that index, out of range is left out."""
    put = lambda o: F.concat(F.left(word, o["index"]), stress.marked(F.substring(word, o["index"] + 1, F.lit(1)), o["mark"]), F.substring(word, o["index"] + 2, F.length(word)))
    return F.transform(F.filter(options, lambda o: (o["index"] >= 0) & (o["index"] < F.length(word))), put)


def families(df: DataFrame, keys: list[str], gold: str = "gold", said: str = "said") -> DataFrame:
    """keys, total, answered, exact, position, with shares of all and of answered rows."""
    g, s = F.col(gold), F.col(said)
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count(s).alias("answered"), F.count_if(exact(g, s)).alias("exact"), F.count_if(position(g, s)).alias("position"))
    return out.withColumns({"exact_of_all": safe_rate("exact", "total"), "exact_of_answered": safe_rate("exact", "answered"), "position_of_answered": safe_rate("position", "answered")})


def first_of_type(df: DataFrame, types: list[str], order: str) -> DataFrame:
    """The first row of each type, for figures that count a type once."""
    others = [c for c in df.columns if c not in types]
    return df.groupBy(*types).agg(F.min_by(F.struct(*others), order).alias("__r")).select(*types, "__r.*").select(*df.columns)


def default_system(tokens: DataFrame, words: DataFrame, key: str = "key") -> DataFrame:
    """Each token with its word's default form, or the first variant's form; looked up once for each distinct word."""
    form = F.coalesce("default_form", F.get("variants", 0)["form"])
    found = tokens.select(key).distinct().join(words, key).select(key, form.alias("said"))
    return tokens.join(found, key, "left")


def by_distinct(df: DataFrame, columns: list[str], predict) -> DataFrame:
    """``predict`` (a DataFrame of the distinct columns to the same with ``said``) joined back to all rows, nulls too."""
    named = {c: f"__{c}" for c in columns}
    answers = predict(df.select(*columns).distinct()).select(*[F.col(c).alias(n) for c, n in named.items()], "said")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()])
    return df.join(answers, on, "left").drop(*named.values())


def joined_layers(base: DataFrame, layers: dict[str, DataFrame], index: str = "global_index", form: str = "form") -> DataFrame:
    """``base`` with a column for each layer, met by index and never by place in a list."""
    for name, layer in layers.items():
        base = base.join(layer.select(index, F.col(form).alias(name)), index, "left")
    return base


def layer_counts(df: DataFrame, layers: list[str]) -> DataFrame:
    """layer, present: how many rows have each layer, in one pass."""
    sums = df.agg(*[F.count(c).alias(c) for c in layers])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("present")) for c in layers])))


def coverage_and_purity(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """kind, coverage, purity: share of accepted rows and the mean accuracy of their strata; of all kinds together the product.

    ``rows`` has accepted_<kind> and accuracy_<kind>.
    """
    every = reduce(lambda a, b: a & b, [F.col(f"accepted_{k}") for k in kinds])
    product = reduce(lambda a, b: a * b, [F.col(f"accuracy_{k}") for k in kinds])
    tests = [*((k, F.col(f"accepted_{k}"), F.col(f"accuracy_{k}")) for k in kinds), ("all", every, product)]
    sums = rows.agg(*[F.avg(ok.cast("double")).alias(f"c_{k}") for k, ok, _ in tests], *[F.avg(F.when(ok, a)).alias(f"p_{k}") for k, ok, a in tests])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"c_{k}").alias("coverage"), F.col(f"p_{k}").alias("purity")) for k, _, _ in tests])))


def disagreements(df: DataFrame, keys: list[str], order: str, most: int, gold: str = "gold", said: str = "said") -> DataFrame:
    """The first ``most`` distinct (keys, gold, said) that differ, by the place of their first occurrence."""
    wrong = df.where(F.col(said).isNotNull() & ~exact(F.col(gold), F.col(said)))
    return wrong.groupBy(*keys, gold, said).agg(F.min(order).alias(order)).orderBy(order).limit(most)


def label_parts(label: Column) -> tuple[Column, Column]:
    """UPOS and features of a combined label; a missing one is ``_|_``."""
    x = F.coalesce(label, F.lit("_|_"))
    upos = F.substring_index(x, "|", 1)
    feats = F.substring(x, F.length(upos) + 2, F.length(x))
    return upos, F.when(feats == "", "_").otherwise(feats)


def combined(upos: Column, feats: Column) -> Column:
    return F.concat(upos, F.lit("|"), F.coalesce(F.nullif(feats, F.lit("")), F.lit("_")))


def tag_metrics(gold: DataFrame, said: DataFrame, on: list[str]) -> DataFrame:
    """total, label, upos, feats, aux_verb_total, aux_verb: correct shares' counts; a token without a prediction scores as ``_|_``."""
    both = gold.join(said.select(*on, F.col("label").alias("__said")), on, "left")
    (gu, gf), (su, sf) = label_parts(F.col("label")), label_parts(F.col("__said"))
    verbs = gu.isin("AUX", "VERB")
    same = F.coalesce(F.col("__said"), F.lit("_|_")) == F.col("label")
    return both.agg(F.count("*").alias("total"), F.count_if(same).alias("label"), F.count_if(gu == su).alias("upos"), F.count_if(gf == sf).alias("feats"), F.count_if(verbs).alias("aux_verb_total"), F.count_if(verbs & same).alias("aux_verb"))


def fill_counts(before: DataFrame, after: DataFrame, on: list[str], column: str) -> DataFrame:
    """filled, kept, changed, empty: what a filling step did to a column."""
    a, b = F.col(column), F.col("__after")
    both = before.join(after.select(*on, F.col(column).alias("__after")), on, "left")
    return both.agg(F.count_if(a.isNull() & b.isNotNull()).alias("filled"), F.count_if(a.isNotNull() & b.eqNullSafe(a)).alias("kept"), F.count_if(a.isNotNull() & ~b.eqNullSafe(a)).alias("changed"), F.count_if(a.isNull() & b.isNull()).alias("empty"))


def completed(cache: DataFrame, wanted: DataFrame, fetch, key: str) -> DataFrame:
    """The wanted rows of a cache, with what ``fetch`` gives for those that it lacks."""
    ids = wanted.select(key).distinct()
    return cache.join(ids, key, "left_semi").unionByName(fetch(ids.join(cache.select(key), key, "left_anti")))


def span_scores(gold: DataFrame, system: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """metric, gold, system, correct, precision, recall, f1: spans (keys) that both have, and of these the equal labels."""
    both = gold.join(system.select(*keys, *[F.col(c).alias(f"__{c}") for c in labels]), keys)
    sums = both.agg(F.count("*").alias("spans"), *[F.count_if(F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in labels])
    sums = sums.crossJoin(gold.agg(F.count("*").alias("g"))).crossJoin(system.agg(F.count("*").alias("s")))  # one row each
    rows = sums.select("g", "s", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("correct")) for c in ("spans", *labels)])))
    out = rows.select("metric", F.col("g").alias("gold"), F.col("s").alias("system"), "correct", safe_rate("correct", "s").alias("precision"), safe_rate("correct", "g").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def argmax(logits: Column) -> Column:
    """Index of the first highest of an array."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def constrained(scores: DataFrame, keys: list[str], feature: str, margin: float) -> DataFrame:
    """keys, value, lead: the best value of a feature among labels consistent with what is known, if it leads by ``margin``.

    ``scores`` has a row a label: known and feats (maps), p. A label counts if it has all known features; a value's score is its
    best label's; labels without the feature are a value of their own (null).
    """
    fits = scores.where(F.forall(F.map_entries("known"), lambda e: F.try_element_at("feats", e["key"]).eqNullSafe(e["value"])))
    best = fits.groupBy(*keys, F.try_element_at("feats", F.lit(feature)).alias("value")).agg(F.max("p").alias("p"))
    w = W.partitionBy(*keys).orderBy(F.desc("p"), F.col("value"))
    top = best.withColumn("__r", F.row_number().over(w)).withColumn("lead", F.col("p") - F.coalesce(F.lead("p").over(w), F.lit(0.0))).where("__r = 1")
    return top.where((F.col("lead") >= margin) & F.col("value").isNotNull()).select(*keys, "value", "lead")
