"""Joins over the lexicon's tables: lemmas with their forms and notes, cells, exclusions, base stems, disputed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import keep_first

# Tags that make a form one of a case, of a finite verb or of a non-finite head form.
CASES = "nominative genitive dative accusative instrumental locative vocative".split()
FINITE = "present past frequentative future conditional imperative infinitive".split()
NONFINITE = "participle adverbial active passive necessitative".split()
#: Order of tags in a cell's key; other tags follow by text.
TAG_ORDER = [*"definite masculine feminine neuter singular plural".split(), *CASES, *FINITE, *"first-person second-person third-person".split()]


def tag_rank(tag: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TAG_ORDER]), tag), F.lit(0)), F.lit(1000))


def sorted_tags(tags: Column) -> Column:
    """Distinct non-empty tags in the order of TAG_ORDER, then by text."""
    ranked = F.transform(F.filter(F.array_distinct(tags), lambda t: t.isNotNull() & (t != "")), lambda t: F.struct(tag_rank(t).alias("r"), t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda x: x["t"])


def parse_tags(raw: Column) -> Column:
    """Tags of a JSON array or of text with bars, commas or spaces between them."""
    listed = F.from_json(raw, "array<string>")
    return sorted_tags(F.when(F.ltrim(raw).startswith("["), listed).otherwise(F.split(F.trim(raw), r"[|,\s]+")))


def cell_key(tags: Column) -> Column:
    return F.array_join(sorted_tags(tags), "|")


def label(pos: Column, tags: Column, pos_names: dict[str, str], tag_names: dict[str, str]) -> Column:
    """A reading's label: the part of speech's and the tags' names in order, each once; a tag without a name stays as it is."""
    named = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
    parts = F.transform(F.filter(sorted_tags(tags), lambda t: t != "error-unrecognized-form"), lambda t: named(tag_names, t))
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(named(pos_names, pos)), parts), lambda x: x.isNotNull())), ", ")


def answered(words: DataFrame) -> DataFrame:
    """Words with a type other than NONE and with variants, in order of the word."""
    return words.where(F.col("accent_type").isNotNull() & (F.col("accent_type") != "NONE") & (F.size("variants") > 0)).orderBy("word")


def forms_of(nominals: DataFrame, forms: DataFrame, pos: list[str], tags: list[str] | None = None) -> DataFrame:
    """Nominals of the given parts of speech with their forms (of which one tag at least is in ``tags``), by lemma and pos."""
    own = forms if tags is None else forms.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return nominals.where(F.col("pos").isin(pos)).join(own, ["lemma", "pos"])


def with_notes(lemmas: DataFrame, notes: DataFrame, on: list[str]) -> DataFrame:
    """Distinct lemmas with their notes' columns, null where there are none."""
    return lemmas.join(notes, on, "left").distinct()


def forms_by_lemma(forms: DataFrame) -> DataFrame:
    """lemma, pos, forms: every lemma's rows as (tags, accented) in that order, in one aggregate instead of a query a lemma."""
    return forms.groupBy("lemma", "pos").agg(F.array_sort(F.collect_list(F.struct("tags", "accented"))).alias("forms"))


def generation_cell(pos: Column, tags: Column) -> Column:
    """Whether a form's cell is one that paradigms are made from."""
    some = lambda names: F.arrays_overlap(tags, F.array(*[F.lit(t) for t in names]))
    return F.when(pos == "verb", some(FINITE + NONFINITE)).otherwise(some(CASES) | ((pos == "adj") & F.array_contains(tags, "neuter")))


def cells_vetoed(forms: DataFrame, vetoes: DataFrame) -> DataFrame:
    """``forms`` (lemma, tags, ...) without those whose lemma ends in a veto's ``suffix`` and that have one of its ``tenses``."""
    lemma = forms.select("lemma").distinct()
    ends = lemma.select("lemma", F.explode(F.transform(F.sequence(F.lit(1), F.length("lemma")), lambda k: F.right("lemma", k))).alias("suffix"))
    bad = ends.join(vetoes, "suffix").groupBy("lemma").agg(F.array_distinct(F.flatten(F.collect_list("tenses"))).alias("__t"))
    return forms.join(bad, "lemma", "left").where(~F.coalesce(F.arrays_overlap("tags", "__t"), F.lit(False))).drop("__t")


def without(combos: DataFrame, *known: DataFrame, on: str = "lemma") -> DataFrame:
    """Combinations that none of the tables of existing or vetoed lemmas holds."""
    for k in known:
        combos = combos.join(k.select(on).distinct(), on, "left_anti")
    return combos


def cells(stems: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Every stem with every cell of its table row (``on``): plain stem and accented ending, or accented stem and plain ending."""
    return stems.join(table, on).withColumn("form", F.when(F.col("accented_ending").isNotNull(), F.concat("stem", "accented_ending")).otherwise(F.concat("accented_stem", "ending")))


def base_stems(rows: DataFrame, order: str) -> DataFrame:
    """stem, accented_stem: of rows (stem, accented_stem, place) whose stress lies in the stem the first by ``order`` of each stem."""
    inside = rows.where((F.length("stem") >= 2) & F.col("place").isNotNull() & (F.col("place") < F.length("stem")))
    return keep_first(inside.select("stem", "accented_stem", order), ["stem"], order).select("stem", "accented_stem")


def undisputed(names: DataFrame, letters: DataFrame, plain: str = "plain", form: str = "form") -> DataFrame:
    """Names none of whose namesakes in the letter pages has another form."""
    other = letters.select(F.col(plain).alias("__p"), F.col(form).alias("__f")).distinct()
    return names.join(other, (F.col(plain) == F.col("__p")) & (F.col(form) != F.col("__f")), "left_anti")


def closed_class(counts: DataFrame, kinds: list[str], least: int = 50) -> DataFrame:
    """lemma, upos, frequency: total count and most frequent part of speech, of closed ones and of ``least`` uses."""
    by = counts.groupBy("lemma", "upos").agg(F.sum("n").alias("n"))
    top = by.groupBy("lemma").agg(F.sum("n").alias("frequency"), F.min_by("upos", F.struct(-F.col("n"), F.col("upos"))).alias("upos"))
    return top.where((F.col("frequency") >= least) & F.col("upos").isin(kinds))


def labels_and_targets(words: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels that occur in any variant, and the wanted words' entries."""
    every = words.select(F.explode("variants").alias("v")).select(F.explode("v.mi").alias("label")).distinct()
    return every, words.join(wanted.select("word").distinct(), "word", "left_semi")


def chosen_label(chosen: DataFrame, words: DataFrame) -> DataFrame:
    """word, form, label of chosen forms: the least label of the variant with that form; null where no variant has it."""
    v = words.select("word", F.explode("variants").alias("v")).select("word", F.col("v.form").alias("form"), F.explode("v.mi").alias("label"))
    found = v.groupBy("word", "form").agg(F.min("label").alias("label"))
    return chosen.join(found, ["word", "form"], "left")


def by_cell(wanted: DataFrame, observed: DataFrame, induced: DataFrame, key: list[str]) -> DataFrame:
    """The form of each wanted cell (key, cell): an observed one (the least), else an induced one; ``source`` tells which."""
    o = observed.groupBy(*key, "cell").agg(F.min("form").alias("__o"))
    i = induced.groupBy(*key, "cell").agg(F.min("form").alias("__i"))
    both = wanted.join(o, [*key, "cell"], "left").join(i, [*key, "cell"], "left")
    return both.withColumn("form", F.coalesce("__o", "__i")).withColumn("source", F.when(F.col("__o").isNotNull(), "observed").when(F.col("__i").isNotNull(), "induced")).drop("__o", "__i")


def page(df: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """One page of an ordered export."""
    return df.orderBy(order).offset(offset).limit(limit)


def numbered_cells() -> list[tuple[int, list[str]]]:
    """Numbers and tags of the 35 cells of a finite verb: four blocks of six, then conditional and imperative."""
    persons = [["first-person", "singular"], ["second-person", "singular"], ["third-person"], ["first-person", "plural"], ["second-person", "plural"], ["third-person", "plural"]]
    blocks = [["present"], ["past"], ["past", "frequentative"], ["future"], ["conditional"]]
    rows = [block + person for block in blocks for person in persons]
    rows += [["imperative", *persons[k]] for k in (1, 2, 3, 4, 5)]
    return list(enumerate(rows, 1))


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key; ties in ``order`` are the caller's to break."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")
