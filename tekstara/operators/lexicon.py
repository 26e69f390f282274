"""The word store, lexicon tables and generators over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import keep_last, majority

WORDS_SCHEMA = (
    "word string, variants array<struct<form:string,info:string,mi:array<string>>>, fetched_at timestamp, negative_until timestamp, default_form string, "
    "accent_type string, default_form_title string, accent_type_title string"
)
NOMINALS_SCHEMA = "lemma string, pos string, accented_lemma string, stress_class string, plural_accented string, gender string, source string"
VERBS_SCHEMA = "lemma string, accented_infinitive string, present_3 string, past_3 string, source string"
FORMS_SCHEMA = "stripped string, accented string, lemma string, pos string, tags array<string>"
CLOSED_SCHEMA = "lemma string, upos string, accented_head string, frequency int, verified int"
VARIANT = "array<struct<form:string,info:string,mi:array<string>>>"


def variants(json: Column) -> Column:
    """Decoded variants; null if the text isn't JSON or any element lacks its form."""
    v = F.from_json(json, VARIANT)
    return F.when(F.forall(v, lambda x: x.isNotNull() & x["form"].isNotNull()), v)


def accent_type(forms: Column) -> Column:
    n = F.size(F.array_distinct(forms))
    return F.when(n == 0, "NONE").when(n == 1, "ONE").otherwise("MULTIPLE_VARIANT")


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the schema's columns in its order; absent ones are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def upsert(store: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The store after the rows: for each word its newest row, new rows before old at equal times. A row without variants and
    default forms is negative for 30 days."""
    empty = (F.coalesce(F.size("variants"), F.lit(0)) <= 0) & F.col("default_form").isNull() & F.col("default_form_title").isNull()
    fresh = evolve(rows, WORDS_SCHEMA).withColumn("fetched_at", now).withColumn("negative_until", F.when(empty, now + F.expr("interval 30 days"))).withColumn("__o", F.lit(1))
    old = evolve(store, WORDS_SCHEMA).withColumn("__o", F.lit(0))
    return keep_last(old.unionByName(fresh), ["word"], "fetched_at", "__o").drop("__o")


def class_table(forms: DataFrame, keys: list[str], shape: str, least: int = 5, share: float = 0.75) -> DataFrame:
    """Induced table: each cell's majority shape, with enough evidence and share."""
    return majority(forms, keys, shape, least, share)


def paradigms(forms: DataFrame, keys: list[str], shape: str, example: str, top: int = 8, examples: int = 5) -> DataFrame:
    """keys, count, majority, alternatives (top shapes with counts and first examples), conflict."""
    shown = forms.select(*keys, shape, example).distinct()
    shown = shown.withColumn("__r", F.row_number().over(W.partitionBy(*keys, shape).orderBy(example))).where(F.col("__r") <= examples)
    shown = shown.groupBy(*keys, shape).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    counts = forms.groupBy(*keys, shape).agg(F.count("*").alias("__n"))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("count"), F.count("*").alias("k"))
    best = counts.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__n"), shape))).where(F.col("__r") <= top).join(shown, [*keys, shape])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(shape).alias("shape"), F.col("__n").alias("n"), "examples"))), lambda x: F.struct(x["shape"].alias("shape"), x["n"].alias("n"), x["examples"].alias("examples")))
    out = best.groupBy(*keys).agg(listed.alias("alternatives")).join(total, keys)
    return out.select(*keys, "count", F.get("alternatives", 0)["shape"].alias("majority"), "alternatives", (F.col("k") > 1).alias("conflict"))


def prefixed(bases: DataFrame, prefixes: list[str], attested: DataFrame, parts: list[str], key: str = "lemma", word: str = "word") -> DataFrame:
    """key, prefix of base and prefix pairs of which any principal part, with the prefix, is attested. Prefixes are a short fixed list."""
    each = bases.select(key, F.explode(F.array(*[F.lit(p) for p in prefixes])).alias("prefix"), F.array(*parts).alias("__parts"))
    tried = each.select(key, "prefix", F.explode("__parts").alias("__part")).where("__part is not null").select(key, "prefix", F.concat("prefix", "__part").alias(word))
    return tried.join(attested.select(word).distinct(), word, "left_semi").select(key, "prefix").distinct()


def endings(words: DataFrame, rules: DataFrame, word: str = "word") -> DataFrame:
    """word, stem and the rule of the longest matching ending: suffixes of words meet rules in an equi-join."""
    cut = words.select(word).distinct().select(word, F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.right(F.col(word), k))).alias("ending"))
    hit = cut.join(rules, "ending")
    best = hit.groupBy(word).agg(F.max_by(F.struct(*rules.columns), F.length("ending")).alias("r"))
    return best.select(word, "r.*").withColumn("stem", F.left(F.col(word), F.length(word) - F.length("ending")))


def gathered(rows: DataFrame, order: str) -> DataFrame:
    """word, variants, provenance from rows (word, form, label, provenance): the last row of a (word, form, label) counts."""
    last = keep_last(rows, ["word", "form", "label"], order)
    v = F.array_sort(F.collect_list(F.struct("form", "label")))
    return last.groupBy("word").agg(v.alias("variants"), F.array_join(F.array_sort(F.collect_set("provenance")), ";").alias("provenance"))


def vetoed(df: DataFrame, lemmas: DataFrame, lemma: str = "lemma") -> DataFrame:
    """``df`` without lemmas that equal a veto or end in one: a lemma's endings meet the vetoes in an equi-join."""
    cut = df.select(lemma).distinct().select(lemma, F.explode(F.transform(F.sequence(F.lit(1), F.length(lemma)), lambda k: F.right(F.col(lemma), k))).alias("__e"))
    bad = cut.join(lemmas.select(F.col("lemma").alias("__e")), "__e").select(lemma).distinct()
    return df.join(bad, lemma, "left_anti")
