"""Queries of the lexicon's joins over tables made of the documents' words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon_joins as lj
from .registry import TOKENS, WORDS, doc_tokens, query, table, word_table

_ACUTE = "translate(substr(word, k, 1), 'aeiou', 'áéíóú')"
#: A lexicon in which each common word of small letters is a stem: nominals in -as, verbs in -yti, forms of four cells.
LEX = rf"""{WORDS}, b AS (SELECT word, freq, length(word) AS n, length(regexp_extract(word, '^[^aeiou]*[aeiou]')) AS k FROM w WHERE freq >= 3 AND regexp_matches(word, '^[a-z][a-z][a-z][a-z]+$') AND regexp_matches(word, '[aeiou]')),
a AS MATERIALIZED (SELECT word, freq, n, k, left(word, k - 1) || {_ACUTE} || substr(word, k + 1) AS acc, CASE n % 3 WHEN 0 THEN 'adj' WHEN 1 THEN 'noun' ELSE 'name' END AS pos, (1 + n % 4)::VARCHAR AS stress_class FROM b),
nominals AS (SELECT word || 'as' AS lemma, pos, acc || 'as' AS accented_lemma, stress_class FROM a WHERE n % 5 <> 0),
notes AS (SELECT word || 'as' AS lemma, pos, stress_class, 't' || n::VARCHAR AS template FROM a WHERE n % 2 = 0),
cell(ending, tags) AS (VALUES ('as', ['nominative', 'singular']), ('o', ['genitive', 'singular']), ('ą', ['accusative', 'singular']), ('esnis', ['comparative', 'nominative', 'singular'])),
forms AS (SELECT word || 'as' AS lemma, pos, acc || ending AS accented, tags FROM a, cell),
verbs AS (SELECT word || 'yti' AS lemma, acc || 'yti' AS accented_infinitive, acc || 'o' AS present_3, acc || 'ė' AS past_3 FROM a WHERE n % 2 = 1),
verb_notes AS (SELECT word || 'yti' AS lemma, 'c' || n::VARCHAR AS template FROM a WHERE n % 3 = 0)"""


def lex(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    w = word_table(spark, sf_dir).where((F.col("freq") >= 3) & F.col("word").rlike("^[a-z]{4,}$") & F.col("word").rlike("[aeiou]"))
    b = w.select("word", "freq", F.length("word").alias("n"), F.length(F.regexp_extract("word", "^[^aeiou]*[aeiou]", 0)).alias("k"))
    n, k = F.col("n"), F.col("k")
    acc = F.concat(F.left("word", k - 1), F.translate(F.substring("word", k, F.lit(1)), "aeiou", "áéíóú"), F.substring("word", k + 1, n))
    a = b.select("*", acc.alias("acc"), F.when(n % 3 == 0, "adj").when(n % 3 == 1, "noun").otherwise("name").alias("pos"), (1 + n % 4).cast("string").alias("stress_class"))
    lemma = F.concat("word", F.lit("as")).alias("lemma")
    verb = F.concat("word", F.lit("yti")).alias("lemma")
    end = lambda x: F.concat("acc", F.lit(x))
    cells = [("as", ["nominative", "singular"]), ("o", ["genitive", "singular"]), ("ą", ["accusative", "singular"]), ("esnis", ["comparative", "nominative", "singular"])]
    rows = F.explode(F.array(*[F.struct(end(x).alias("accented"), F.array(*[F.lit(t) for t in tags]).alias("tags")) for x, tags in cells]))
    return {
        "a": a,
        "nominals": a.where("n % 5 <> 0").select(lemma, "pos", end("as").alias("accented_lemma"), "stress_class"),
        "notes": a.where("n % 2 = 0").select(lemma, "pos", "stress_class", F.concat(F.lit("t"), n.cast("string")).alias("template")),
        "forms": a.select(lemma, "pos", rows.alias("f")).select("lemma", "pos", "f.accented", "f.tags"),
        "verbs": a.where("n % 2 = 1").select(verb, end("yti").alias("accented_infinitive"), end("o").alias("present_3"), end("ė").alias("past_3")),
        "verb_notes": a.where("n % 3 = 0").select(verb, F.concat(F.lit("c"), n.cast("string")).alias("template")),
    }


_WORDS_STORE = """ws AS (SELECT word, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 'NONE' ELSE 'ONE' END AS accent_type, n % 5 AS v FROM a)"""


def words_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, accent_type, variants: as many variants as the length leaves over five; labels by their number."""
    a = lex(spark, sf_dir)["a"]
    kind = F.when(F.col("n") % 4 == 0, F.lit(None).cast("string")).when(F.col("n") % 4 == 1, "NONE").otherwise("ONE")
    one = lambda i: F.struct(F.concat("acc", i.cast("string")).alias("form"), F.array(F.concat(F.lit("m"), (i + F.col("k")).cast("string")), F.concat(F.lit("q"), i.cast("string"))).alias("mi"))
    v = F.when(F.col("n") % 5 > 0, F.transform(F.sequence(F.lit(1), F.col("n") % 5), one)).otherwise(F.array().cast("array<struct<form:string,mi:array<string>>>"))
    return a.select("word", kind.alias("accent_type"), v.alias("variants"))


@query(f"WITH {LEX}, {_WORDS_STORE} SELECT word, v::INTEGER AS n_variants FROM ws WHERE accent_type IS NOT NULL AND accent_type <> 'NONE' AND v > 0 ORDER BY word")
def answered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lj.answered(words_store(spark, sf_dir)).select("word", F.size("variants").alias("n_variants"))


@query(f"WITH {LEX} SELECT lemma, pos, accented_lemma, accented, array_to_string(tags, '|') AS tags FROM nominals JOIN forms USING (lemma, pos) WHERE pos IN ('noun', 'adj')")
def nominal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lex(spark, sf_dir)
    return lj.forms_of(x["nominals"], x["forms"], ["noun", "adj"]).select("lemma", "pos", "accented_lemma", "accented", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {LEX} SELECT lemma, accented FROM nominals JOIN forms USING (lemma, pos) WHERE pos = 'adj' AND (list_contains(tags, 'comparative') OR list_contains(tags, 'superlative'))")
def degree_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lex(spark, sf_dir)
    return lj.forms_of(x["nominals"], x["forms"], ["adj"], ["comparative", "superlative"]).select("lemma", "accented")


@query(f"WITH {LEX} SELECT lemma, pos, accented FROM nominals JOIN forms USING (lemma, pos) WHERE pos IN ('noun', 'name') AND list_has_any(tags, ['accusative', 'nominative'])")
def case_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lex(spark, sf_dir)
    return lj.forms_of(x["nominals"], x["forms"], ["noun", "name"], ["accusative", "nominative"]).select("lemma", "pos", "accented")


@query(f"WITH {LEX} SELECT DISTINCT n.lemma, n.pos, n.accented_lemma, n.stress_class, m.template FROM nominals n LEFT JOIN notes m ON m.lemma = n.lemma AND m.pos = n.pos AND m.stress_class = n.stress_class")
def nominals_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lex(spark, sf_dir)
    return lj.with_notes(x["nominals"], x["notes"], ["lemma", "pos", "stress_class"])


@query(f"WITH {LEX} SELECT DISTINCT v.*, m.template FROM verbs v LEFT JOIN verb_notes m USING (lemma)")
def verbs_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lex(spark, sf_dir)
    return lj.with_notes(x["verbs"], x["verb_notes"], ["lemma"])


@query(f"WITH {LEX} SELECT lemma, pos, count(*)::INTEGER AS n, string_agg(array_to_string(tags, '|') || ':' || accented, ';' ORDER BY array_to_string(tags, '|'), accented) AS forms FROM forms GROUP BY lemma, pos")
def forms_by_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lj.forms_by_lemma(lex(spark, sf_dir)["forms"])
    return f.select("lemma", "pos", F.size("forms").alias("n"), F.array_join(F.transform("forms", lambda x: F.concat(F.array_join(x["tags"], "|"), F.lit(":"), x["accented"])), ";").alias("forms"))


@query(f"WITH {LEX} SELECT lemma, accented FROM forms WHERE pos = 'adj' AND (list_has_any(tags, ['nominative', 'genitive', 'accusative']) OR list_contains(tags, 'neuter'))")
def generation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex(spark, sf_dir)["forms"].where((F.col("pos") == "adj") & lj.generation_cell(F.col("pos"), F.col("tags"))).select("lemma", "accented")


@query(f"WITH {LEX}, v(suffix, tenses) AS (VALUES ('ingas', ['genitive']), ('as', ['accusative']), ('thereas', ['nominative', 'comparative'])) SELECT lemma, accented FROM forms WHERE NOT EXISTS (SELECT 1 FROM v WHERE ends_with(lemma, v.suffix) AND list_has_any(tags, v.tenses))")
def cell_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vetoes = spark.createDataFrame([("ingas", ["genitive"]), ("as", ["accusative"]), ("thereas", ["nominative", "comparative"])], "suffix string, tenses array<string>")
    return lj.cells_vetoed(lex(spark, sf_dir)["forms"], vetoes).select("lemma", "accented")


@query(f"WITH {LEX} SELECT p || word AS lemma FROM a, (SELECT unnest(['an', 'in', 're']) AS p) WHERE freq >= 10 AND NOT EXISTS (SELECT 1 FROM w WHERE w.word = p || a.word) AND NOT ends_with(p || a.word, 'e')")
def new_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir).select(F.col("word").alias("lemma"), "freq", "docs")
    combos = lex(spark, sf_dir)["a"].where("freq >= 10").select(F.explode(F.array(*[F.concat(F.lit(p), "word") for p in ("an", "in", "re")])).alias("lemma"))
    return lj.without(combos, words, combos.where("lemma like '%e'"))


_CLASSES = "t(stress_class, cell, ending, accented_ending) AS (VALUES ('1', 'genitive', 'o', NULL), ('1', 'dative', 'ui', NULL), ('2', 'genitive', 'o', NULL), ('2', 'locative', 'e', 'è'), ('3', 'locative', 'e', 'è'))"


@query(f"WITH {LEX}, {_CLASSES} SELECT word, cell, CASE WHEN accented_ending IS NOT NULL THEN word || accented_ending ELSE acc || ending END AS form FROM a JOIN t USING (stress_class)")
def paradigm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("1", "genitive", "o", None), ("1", "dative", "ui", None), ("2", "genitive", "o", None), ("2", "locative", "e", "è"), ("3", "locative", "e", "è")], "stress_class string, cell string, ending string, accented_ending string")
    stems = lex(spark, sf_dir)["a"].select("word", "stress_class", F.col("word").alias("stem"), F.col("acc").alias("accented_stem"))
    return lj.cells(stems, t, ["stress_class"]).select("word", "cell", "form")


@query(f"WITH {LEX}, s AS (SELECT left(word, 4) AS stem, left(acc, 4) AS accented_stem, k - 1 AS place, row_number() OVER (PARTITION BY left(word, 4) ORDER BY word) AS r FROM a WHERE k <= 4) SELECT stem, accented_stem FROM s WHERE r = 1")
def base_stem_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lex(spark, sf_dir)["a"].select("word", F.left("word", F.lit(4)).alias("stem"), F.left("acc", F.lit(4)).alias("accented_stem"), (F.col("k") - 1).alias("place"))
    return lj.base_stems(a, "word")


@query(f"WITH {LEX}, l AS (SELECT word AS plain, CASE WHEN n % 2 = 0 THEN acc ELSE word END AS form FROM a WHERE n % 3 = 0) SELECT word AS plain, acc AS form FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.plain = a.word AND l.form <> a.acc)")
def undisputed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lex(spark, sf_dir)["a"]
    letters = a.where("n % 3 = 0").select(F.col("word").alias("plain"), F.when(F.col("n") % 2 == 0, F.col("acc")).otherwise(F.col("word")).alias("form"))
    return lj.undisputed(a.select(F.col("word").alias("plain"), F.col("acc").alias("form")), letters)


@query(f"WITH {TOKENS}, c AS (SELECT token, lang, count(*) AS n FROM tok WHERE lang IS NOT NULL GROUP BY ALL), t AS (SELECT token, lang, sum(n) OVER (PARTITION BY token) AS frequency, row_number() OVER (PARTITION BY token ORDER BY n DESC, lang) AS r FROM c) SELECT token AS lemma, lang AS upos, frequency::BIGINT AS frequency FROM t WHERE r = 1 AND frequency >= 50 AND lang IN ('de', 'fr')")
def closed_class_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = doc_tokens(spark, sf_dir).where("lang is not null").groupBy(F.col("token").alias("lemma"), F.col("lang").alias("upos")).agg(F.count("*").alias("n"))
    return lj.closed_class(counts, ["de", "fr"])


@query(f"WITH {LEX}, {_WORDS_STORE}, i AS (SELECT word, unnest(range(1, v + 1)) AS i, k FROM ws JOIN a USING (word)) SELECT label, count(*)::BIGINT AS words FROM (SELECT DISTINCT label, word FROM (SELECT 'm' || (i + k)::VARCHAR AS label, word FROM i UNION ALL SELECT 'q' || i::VARCHAR, word FROM i)) WHERE word LIKE 'th%' GROUP BY label")
def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = words_store(spark, sf_dir)
    labels, entries = lj.labels_and_targets(store, store.where("word like 'th%'"))
    own = entries.select("word", F.explode("variants").alias("v")).select("word", F.explode("v.mi").alias("label")).distinct()
    return own.join(labels, "label").groupBy("label").agg(F.count("*").alias("words"))


@query(f"WITH {LEX}, {_WORDS_STORE} SELECT word, acc || '2' AS form, CASE WHEN v >= 2 THEN least('m' || (2 + k)::VARCHAR, 'q2') END AS label FROM ws JOIN a USING (word)")
def chosen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = lex(spark, sf_dir)["a"].select("word", F.concat("acc", F.lit("2")).alias("form"))
    return lj.chosen_label(chosen, words_store(spark, sf_dir))


@query(f"""WITH {LEX}, c(cell, ending) AS (VALUES ('genitive', 'o'), ('dative', 'ui')) SELECT word, cell, CASE WHEN cell = 'genitive' AND n % 2 = 0 THEN acc || 'o' WHEN n % 3 = 0 THEN word || ending END AS form,
CASE WHEN cell = 'genitive' AND n % 2 = 0 THEN 'observed' WHEN n % 3 = 0 THEN 'induced' END AS source FROM a, c""")
def cell_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lex(spark, sf_dir)["a"]
    wanted = a.select("word", F.explode(F.array(F.lit("genitive"), F.lit("dative"))).alias("cell"))
    observed = a.where("n % 2 = 0").select("word", F.lit("genitive").alias("cell"), F.concat("acc", F.lit("o")).alias("form"))
    ending = F.when(F.col("cell") == "genitive", "o").otherwise("ui")
    induced = wanted.join(a.where("n % 3 = 0").select("word"), "word", "left_semi").withColumn("form", F.concat("word", ending))
    return lj.by_cell(wanted, observed, induced, ["word"])


@query("""WITH e AS (SELECT event_id, ['singular', 'nominative', '', 'zz'][1 + event_id % 4] AS a, ['masculine', 'plural', 'zz'][1 + event_id % 3] AS b, ['accusative', 'masculine'][1 + event_id % 2] AS c FROM events),
o AS (SELECT unnest(['masculine', 'singular', 'plural', 'nominative', 'accusative']) AS t, unnest([1, 2, 3, 4, 5]) AS r), u AS (SELECT DISTINCT event_id, t FROM (SELECT event_id, unnest([a, b, c]) AS t FROM e) WHERE t <> '')
SELECT event_id, string_agg(u.t, '|' ORDER BY coalesce(r, 1000), u.t) AS cell, 'dkt., ' || string_agg(CASE u.t WHEN 'masculine' THEN 'vyr. g.' WHEN 'singular' THEN 'vns.' ELSE u.t END, ', ' ORDER BY coalesce(r, 1000), u.t) AS label FROM u LEFT JOIN o USING (t) GROUP BY event_id""")
def cell_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (e % len(xs)).cast("int"))
    raw = F.concat_ws(", ", pick(["singular", "nominative", "", "zz"]), pick(["masculine", "plural", "zz"]), pick(["accusative", "masculine"]))
    tags = table(spark, sf_dir, "events").select("event_id", lj.parse_tags(raw).alias("tags"))
    return tags.select("event_id", lj.cell_key(F.col("tags")).alias("cell"), lj.label(F.lit("noun"), F.col("tags"), {"noun": "dkt."}, {"masculine": "vyr. g.", "singular": "vns."}).alias("label"))


@query(f"WITH {WORDS} SELECT word, freq FROM w ORDER BY word LIMIT 500 OFFSET 1000")
def paged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lj.page(word_table(spark, sf_dir).select("word", "freq"), "word", 500, 1000)


@query("""WITH p(i, person) AS (VALUES (1, 'first-person|singular'), (2, 'second-person|singular'), (3, 'third-person'), (4, 'first-person|plural'), (5, 'second-person|plural'), (6, 'third-person|plural')), b(j, block) AS (VALUES (0, 'present'), (1, 'past'), (2, 'past|frequentative'), (3, 'future'), (4, 'conditional'))
SELECT (6 * j + i)::INTEGER AS number, block || '|' || person AS tags FROM b, p UNION ALL SELECT (29 + i)::INTEGER, 'imperative|' || person FROM p WHERE i > 1""")
def finite_verb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, "|".join(t)) for i, t in lj.numbered_cells()], "number int, tags string")
