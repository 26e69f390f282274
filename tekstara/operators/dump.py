"""Lexicon tables from a dictionary dump: heads, genders, plurals, stress classes, templates, principal parts, form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lithuanian as lt

ENTRY_SCHEMA = (
    "word string, pos string, lang_code string, forms array<struct<form:string,tags:array<string>,source:string>>, "
    "head_templates array<struct<name:string,args:map<string,string>,expansion:string>>, inflection_templates array<struct<name:string,args:map<string,string>>>"
)
# Stress classes, and tags that mark rows of a form list as no forms.
STRESS_CLASSES = ["1", "2", "3", "3a", "3b", "4"]
NO_FORMS = ["inflection-template", "table-tags", "class", "romanization"]


def entries(dump: DataFrame) -> DataFrame:
    """Entries of the language with a number; forms come normalized, each distinct spelling once."""
    own = dump.where("lang_code = 'lt'").withColumn("entry", F.xxhash64(F.to_json(F.struct(*dump.columns))))
    rows = own.select("entry", F.posexplode_outer("forms").alias("n", "f"))
    norm = lt.map_distinct(rows.withColumn("raw", F.col("f.form")), "raw", lt.normalize, "form", "string")
    norm = lt.map_distinct(norm, "raw", lambda x: bool(lt.stresses(x)), "stressed", "boolean")
    one = F.struct("n", F.col("form"), F.coalesce("f.tags", F.array().cast("array<string>")).alias("tags"), F.col("f.source").alias("source"), F.col("stressed"))
    back = norm.groupBy("entry").agg(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), one))).alias("forms"))
    return own.drop("forms").join(back, "entry").dropDuplicates(["entry"])


def has(f: Column, *tags: str) -> Column:
    out = F.array_contains(f["tags"], tags[0])
    for t in tags[1:]:
        out = out & F.array_contains(f["tags"], t)
    return out


def usable(f: Column) -> Column:
    """A form's text if it is one: no dash, no table note, no braces, no bare template name."""
    t = f["form"]
    bad = t.isNull() | (t == "") | (t == "-") | t.startswith("no-table") | t.contains("{") | t.contains("}") | (t.startswith("lt-") & ~f["stressed"])
    return F.when(~bad, t)


def first(forms: Column) -> Column:
    return F.get(forms, 0)["form"]


def template_head() -> Column:
    """The head argument of the first template by preference."""
    name = lambda n: F.filter("head_templates", lambda t: (t["name"] == n) & F.coalesce(F.try_element_at(t["args"], F.lit("head")), F.try_element_at(t["args"], F.lit("head1"))).isNotNull())
    arg = lambda n: F.coalesce(F.try_element_at(F.get(name(n), 0)["args"], F.lit("head")), F.try_element_at(F.get(name(n), 0)["args"], F.lit("head1")))
    return F.trim(F.get(F.split(F.coalesce(*[arg(n) for n in ("lt-noun", "lt-proper noun", "lt-adj", "lt-verb", "head")]), "[,/]"), 0))


def nominals(e: DataFrame) -> DataFrame:
    """lemma, pos, accented_lemma, gender, plural_accented, template of each entry."""
    forms = F.col("forms")
    canonical = F.filter(forms, lambda f: has(f, "canonical") & ~f["form"].contains(" ") & ~f["form"].contains("\n"))
    head = F.coalesce(template_head(), first(canonical), F.col("word"))
    letter = F.coalesce(*[F.try_element_at(F.get(F.col("head_templates"), 0)["args"], F.lit(k)) for k in ("g", "1")])
    tagged = [F.when(F.array_contains(F.flatten(F.transform(forms, lambda f: f["tags"])), g), g) for g in ("masculine", "feminine", "neuter")]
    gender = F.coalesce(*[F.when(letter.isin(s, g), g) for s, g in (("m", "masculine"), ("f", "feminine"), ("n", "neuter"))], *tagged)
    plural = F.filter(forms, lambda f: has(f, "plural") & f["stressed"] & ~f["form"].startswith("no-table"))
    exact = F.filter(plural, lambda f: has(f, "nominative") & (f["source"] == "declension"))
    markers = F.filter(forms, lambda f: has(f, "inflection-template") & f["source"].isin("declension", "inflection"))
    known = F.filter(markers, lambda f: f["form"].rlike("^(?:lt-noun|lt-proper|lt-adj|lt-3rd|l|small)"))
    return e.select("entry", F.col("word").alias("lemma"), "pos", head.alias("accented_lemma"), gender.alias("gender"), F.coalesce(first(exact), first(plural)).alias("plural_accented"), F.coalesce(first(known), first(markers)).alias("template"))


def stress_classes(e: DataFrame) -> DataFrame:
    """entry, stress_class: valid classes named by tags or template arguments, each once."""
    tags = F.flatten(F.transform("forms", lambda f: F.filter(f["tags"], lambda t: t.startswith("stress-pattern-"))))
    args = F.flatten(F.transform("head_templates", lambda t: F.filter(F.array(*[F.try_element_at(t["args"], F.lit(k)) for k in ("2", "3", "4", "stress", "accent", "ap")]), lambda x: x.isNotNull())))
    raw = F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(args, F.array().cast("array<string>")))
    clean = F.regexp_replace(F.translate(F.replace(F.lower(F.trim("r")), F.lit("stress-pattern-"), F.lit("")), "ᵃᵇ", "ab"), r"[^0-9ab/\-]+", "")
    parts = e.select("entry", F.explode(raw).alias("r")).select("entry", F.explode(F.split(clean, "[-/]+")).alias("stress_class"))
    return parts.where(F.col("stress_class").isin(STRESS_CLASSES)).distinct()


def form_rows(e: DataFrame) -> DataFrame:
    """stripped, accented, lemma, pos, tags of every stressed table form, each once."""
    rows = e.select(F.col("word").alias("lemma"), "pos", F.explode("forms").alias("f"))
    rows = rows.where(F.coalesce(F.col("f.source"), F.lit("")).isin("", "declension", "conjugation", "inflection") & ~F.arrays_overlap("f.tags", F.array(*[F.lit(t) for t in NO_FORMS])))
    tags = F.array_sort(F.filter("f.tags", lambda t: ~t.startswith("stress-pattern-") & (t != "error-unrecognized-form")))
    kept = rows.select(usable(F.col("f")).alias("accented"), "lemma", "pos", tags.alias("tags"), F.col("f.stressed").alias("s")).where(F.col("s") & F.col("accented").isNotNull() & (F.size("tags") > 0)).drop("s")
    return lt.map_distinct(kept, "accented", lt.word_key, "stripped", "string").select("stripped", "accented", "lemma", "pos", "tags").distinct()


def verbs(e: DataFrame) -> DataFrame:
    """lemma, accented_infinitive, present_3, past_3 of verbs with all three stressed; table forms go before template arguments."""
    forms = F.col("forms")
    last = lambda *tags: F.element_at(F.filter(forms, lambda f: has(f, *tags) & f["stressed"] & usable(f).isNotNull()), -1)["form"]
    pick = lambda *tags: F.when(F.exists(forms, lambda f: has(f, *tags) & f["stressed"] & usable(f).isNotNull()), last(*tags))
    arg = lambda k: F.try_element_at(F.get(F.filter("head_templates", lambda t: t["name"] == "lt-verb"), 0)["args"], F.lit(k))
    out = e.where("pos = 'verb'").select(F.col("word").alias("lemma"), F.coalesce(pick("canonical"), template_head()).alias("accented_infinitive"), F.coalesce(pick("present", "third-person"), arg("1")).alias("present_3"), F.coalesce(pick("past", "third-person"), arg("2")).alias("past_3"))
    return out.dropna()
