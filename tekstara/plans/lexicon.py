"""Queries over a dictionary made of the documents' words: lookups, tiers, votes, guessers, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lithuanian as lt
from ..functions.text import common_prefix, lemma_script
from ..operators import guess
from ..operators.corrections import corpus_suggestions
from ..operators.joins import agreeing, cascade, choose_side, listed_or_orphans, live, misses, tiered
from ..operators.lexicon import class_table, endings, gathered, paradigms, prefixed, upsert, variants, vetoed
from ..operators.ranking import majority
from ..operators.spelling import fold_index
from .registry import TOKENS, WORDS, doc_tokens, doc_words, query, table, word_table

#: A word store derived from the words: some incomplete, some negative and expired, some known by their title side only.
STORE = f"""{WORDS}, store AS (SELECT word AS key, freq, CASE WHEN length(word) % 5 <> 0 THEN word || '1' END AS default_form, CASE WHEN length(word) % 5 <> 0 THEN 'ONE' ELSE 'NONE' END AS accent_type,
CASE WHEN length(word) % 3 <> 0 THEN upper(substr(word, 1, 1)) || substr(word, 2) || '2' END AS default_form_title, CASE WHEN length(word) % 7 <> 0 THEN 'ONE' END AS accent_type_title,
CASE WHEN length(word) % 4 = 0 THEN '2020-01-01 00:00:00' WHEN length(word) % 4 = 1 THEN '2999-01-01 00:00:00' END AS negative_until FROM w WHERE freq >= 3)"""
LIVE = f"{STORE}, live AS MATERIALIZED (SELECT * FROM store WHERE accent_type_title IS NOT NULL AND NOT (negative_until IS NOT NULL AND negative_until < '2024-01-01'))"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("word")
    w = word_table(spark, sf_dir).where("freq >= 3")
    return w.select(
        F.col("word").alias("key"), "freq", F.when(n % 5 != 0, F.concat("word", F.lit("1"))).alias("default_form"), F.when(n % 5 != 0, "ONE").otherwise("NONE").alias("accent_type"),
        F.when(n % 3 != 0, F.concat(F.upper(F.substring("word", 1, 1)), F.substring("word", F.lit(2), n), F.lit("2"))).alias("default_form_title"), F.when(n % 7 != 0, "ONE").alias("accent_type_title"),
        F.when(n % 4 == 0, "2020-01-01 00:00:00").when(n % 4 == 1, "2999-01-01 00:00:00").alias("negative_until"),
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(store(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))


@query(rf"""WITH {LIVE}, c AS (SELECT doc_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+') AS t FROM documents)),
f AS (SELECT c.doc_id, c.token, CASE WHEN l.key IS NULL THEN NULL WHEN upper(substr(token, 1, 1)) = substr(token, 1, 1) AND lower(substr(token, 1, 1)) <> substr(token, 1, 1) THEN l.default_form_title ELSE l.default_form END AS form,
l.key IS NOT NULL AS hit FROM c LEFT JOIN live l ON l.key = lower(c.token))
SELECT doc_id, count(*)::BIGINT AS words, count(form)::BIGINT AS formed, coalesce(sum(length(form)), 0)::BIGINT AS form_chars FROM f GROUP BY doc_id""")
def dict_lookup_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}]+)"), 1)).alias("pos", "token")).withColumn("key", F.lower("token"))
    found = choose_side(docs, known(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("form").alias("formed"), F.coalesce(F.sum(F.length("form")), F.lit(0)).alias("form_chars"))


@query(f"WITH {LIVE} SELECT word AS key FROM w WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.key = w.word)")
def dict_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misses(word_table(spark, sf_dir).select(F.col("word").alias("key")), known(spark, sf_dir))


@query(f"""WITH {LIVE}, k AS (SELECT word AS key, freq FROM w), t AS (SELECT k.key, k.freq, CASE WHEN l.default_form IS NOT NULL THEN 'dict' WHEN length(k.key) % 6 = 0 THEN 'guess' WHEN k.key LIKE 'th%' THEN 'live' ELSE 'unanswered' END AS tier FROM k LEFT JOIN live l USING (key))
SELECT tier, count(*)::BIGINT AS types, sum(freq)::BIGINT AS tokens FROM t GROUP BY tier""")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each branch needs the words with their counts, so the plan reads and counts them once
    words = word_table(spark, sf_dir).select(F.col("word").alias("key"), "freq")
    counted = words.where("freq > 0")
    tiers = [("dict", known(spark, sf_dir).select("key", F.col("default_form").alias("form"))), ("guess", counted.where(F.length("key") % 6 == 0).select("key", F.col("key").alias("form"))), ("live", counted.where("key like 'th%'").select("key", F.col("key").alias("form")))]
    return tiered(words, tiers).groupBy("tier").agg(F.count("*").alias("types"), F.sum("freq").alias("tokens"))


@query(f"""WITH {WORDS}, ab AS MATERIALIZED (SELECT word AS key, CASE WHEN length(word) % 2 = 0 THEN 'x' || length(word)::VARCHAR END AS a, CASE WHEN length(word) % 3 = 0 THEN 'x' || length(word)::VARCHAR ELSE 'y' END AS b FROM w)
SELECT key, coalesce(a, b) AS form, CASE WHEN a IS NOT NULL THEN 0 ELSE 1 END::INTEGER AS level, (a IS NOT NULL AND a = b) AS agreed FROM ab""")
def cascade_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir).select(F.col("word").alias("key"))
    x = F.concat(F.lit("x"), F.length("key").cast("string"))
    a = words.select("key", F.when(F.length("key") % 2 == 0, x).alias("form"))
    b = words.select("key", F.when(F.length("key") % 3 == 0, x).otherwise("y").alias("form"))
    both = agreeing(a, b).select("key", F.lit(True).alias("agreed"))
    return cascade(words, [a, b]).join(both, "key", "left").fillna(False, ["agreed"])


@query("""WITH old AS (SELECT user_id::VARCHAR AS word, min(event_type) AS f FROM events WHERE user_id % 4 <> 0 GROUP BY 1), new AS (SELECT user_id::VARCHAR AS word, CASE WHEN user_id % 10 <> 4 THEN max(event_type) END AS f FROM events WHERE user_id % 2 = 0 GROUP BY user_id)
SELECT word, CASE WHEN new.word IS NOT NULL THEN new.f ELSE old.f END AS default_form, CASE WHEN new.word IS NOT NULL THEN 2024 ELSE 2020 END::INTEGER AS fetched, CASE WHEN new.word IS NOT NULL AND new.f IS NULL THEN '2024-01-31' END AS negative_until FROM old FULL JOIN new USING (word)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null").withColumn("word", F.col("user_id").cast("string"))
    old = e.where("user_id % 4 <> 0").groupBy("word").agg(F.min("event_type").alias("default_form"), F.to_timestamp(F.lit("2020-01-01")).alias("fetched_at"))
    new = e.where("user_id % 2 = 0").groupBy("word").agg(F.when(F.max("user_id") % 10 != 4, F.max("event_type")).alias("default_form"))
    out = upsert(old, new, F.to_timestamp(F.lit("2024-01-01")))
    return out.select("word", "default_form", F.year("fetched_at").alias("fetched"), F.date_format("negative_until", "yyyy-MM-dd").alias("negative_until"))


@query("""SELECT user_id, event_type, votes, total FROM (SELECT user_id, event_type, count(*)::BIGINT AS votes, (sum(count(*)) OVER (PARTITION BY user_id))::BIGINT AS total, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
FROM events GROUP BY user_id, event_type) WHERE r = 1 AND votes >= 5 AND votes >= 0.3 * total""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", 5, 0.3)


_WORD_LANG = f"{TOKENS}, wl AS (SELECT token AS word, lang, count(*) AS c FROM tok WHERE lang IS NOT NULL GROUP BY ALL), m AS (SELECT word, lang FROM (SELECT word, lang, row_number() OVER (PARTITION BY word ORDER BY c DESC, lang) AS k FROM wl) WHERE k = 1)"


def word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = doc_tokens(spark, sf_dir).where("lang is not null").select(F.col("token").alias("word"), "lang")
    return majority(t, ["word"], "lang").select("word", "lang")


@query(f"""WITH {_WORD_LANG}, s AS (SELECT substr(word, length(word) - k + 1) AS suffix, lang, count(*) AS votes FROM (SELECT word, lang, unnest(range(1, least(length(word), 4) + 1)) AS k FROM m) GROUP BY ALL),
t AS (SELECT suffix, lang, votes, sum(votes) OVER (PARTITION BY suffix) AS total, row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, lang) AS r FROM s)
SELECT suffix, lang, votes::BIGINT AS votes, total::BIGINT AS total FROM t WHERE r = 1 AND (total >= 2 OR length(suffix) = 1)""")
def suffix_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess.suffix_table(word_language(spark, sf_dir), "word", "lang", longest=4)


@query(f"""WITH {_WORD_LANG}, s AS (SELECT substr(word, length(word) - k + 1) AS suffix, lang, count(*) AS votes FROM (SELECT word, lang, unnest(range(1, least(length(word), 4) + 1)) AS k FROM m WHERE ascii(word) % 5 <> 0) GROUP BY ALL),
t AS (SELECT suffix, lang, votes, sum(votes) OVER (PARTITION BY suffix) AS total, row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, lang) AS r FROM s),
u AS (SELECT suffix, lang FROM t WHERE r = 1 AND (total >= 2 OR length(suffix) = 1)),
p AS (SELECT h.word, u.suffix, u.lang, row_number() OVER (PARTITION BY h.word ORDER BY length(u.suffix) DESC) AS r FROM (SELECT word FROM m WHERE ascii(word) % 5 = 0) h JOIN u ON right(h.word, length(u.suffix)) = u.suffix)
SELECT word, lang, suffix FROM p WHERE r = 1""")
def suffix_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_language(spark, sf_dir)
    held = F.ascii("word") % 5 == 0
    return guess.by_suffix(words.where(held), guess.suffix_table(words.where(~held), "word", "lang", longest=4), "word", "lang", longest=4)


@query(f"""WITH {_WORD_LANG}, e AS (SELECT lang, substr(x, 1, k) AS prefix FROM (SELECT lang, word || '#' AS x, unnest(range(1, length(word) + 2)) AS k FROM m)),
s AS MATERIALIZED (SELECT prefix, min(lang) AS lang FROM e GROUP BY prefix HAVING min(lang) = max(lang))
SELECT prefix, lang FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS shorter WHERE shorter.prefix = left(s.prefix, length(s.prefix) - 1))""")
def prefix_free_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess.prefix_rules(word_language(spark, sf_dir), "word", "lang")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, form, info FROM (SELECT event_id, unnest([event_type, event_type || '2'][:1 + event_id % 2]) AS form, 'v' || (user_id % 3)::VARCHAR AS info FROM events WHERE event_id % 5 <> 0)")
def variants_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda form: F.struct(form.alias("form"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("info"), F.array().cast("array<string>").alias("mi"))
    both = F.when(F.col("event_id") % 2 == 1, F.array(one(F.col("event_type")), one(F.concat("event_type", F.lit("2"))))).otherwise(F.array(one(F.col("event_type"))))
    # every fifth row has a text that is no JSON and so no variants
    text = F.when(F.col("event_id") % 5 == 0, F.lit("[{bad")).otherwise(F.to_json(both))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("j")).select("event_id", variants(F.col("j")).alias("v"))
    return rows.select("event_id", F.explode("v").alias("x")).select("event_id", "x.form", "x.info")


_PREFIXES = "an be en er in on re th".split()


@query(f"""WITH {WORDS}, b AS (SELECT word FROM w WHERE freq >= 5) SELECT DISTINCT b.word AS lemma, p.prefix FROM b, (SELECT unnest({_PREFIXES}) AS prefix) p WHERE p.prefix || b.word IN (SELECT word FROM w) OR p.prefix || b.word || 'ed' IN (SELECT word FROM w)""")
def prefix_cross_attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir)
    bases = words.where("freq >= 5").select(F.col("word").alias("lemma"), F.col("word").alias("a"), F.concat("word", F.lit("ed")).alias("b"))
    return prefixed(bases, _PREFIXES, words, ["a", "b"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return listed_or_orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, ["c_custkey"], F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@query(f"""WITH {_WORD_LANG}, f AS (SELECT lang, length(word) AS n, right(word, 2) AS ending, count(*) AS votes FROM m WHERE length(word) >= 3 GROUP BY ALL),
t AS (SELECT *, sum(votes) OVER (PARTITION BY lang, n) AS total, row_number() OVER (PARTITION BY lang, n ORDER BY votes DESC, ending) AS r FROM f)
SELECT lang, n::INTEGER AS n, ending, votes::BIGINT AS votes, total::BIGINT AS total FROM t WHERE r = 1 AND votes >= 5 AND votes >= 0.1 * total""")
def class_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_language(spark, sf_dir).where(F.length("word") >= 3).select("lang", F.length("word").alias("n"), F.right("word", F.lit(2)).alias("ending"))
    return class_table(rows, ["lang", "n"], "ending", 5, 0.1)


@query(f"""WITH {_WORD_LANG}, f AS (SELECT lang, length(word) AS n, right(word, 1) AS shape, count(*) AS c FROM m GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY c DESC, shape) AS r FROM f)
SELECT lang, n::INTEGER AS n, sum(c)::BIGINT AS count, max(CASE WHEN r = 1 THEN shape END) AS majority, count(*) > 1 AS conflict, least(count(*), 8)::INTEGER AS alternatives FROM t GROUP BY lang, n""")
def paradigm_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_language(spark, sf_dir).select("lang", F.length("word").alias("n"), F.right("word", F.lit(1)).alias("shape"), "word")
    return paradigms(rows, ["lang", "n"], "shape", "word").select("lang", "n", "count", "majority", "conflict", F.size("alternatives").alias("alternatives"))


@query(f"""WITH {WORDS}, r AS (SELECT unnest(['tion', 'ing', 'ed', 'n', 'e']) AS ending), h AS (SELECT word, ending, row_number() OVER (PARTITION BY word ORDER BY length(ending) DESC) AS k FROM w JOIN r ON right(word, length(ending)) = ending)
SELECT word, ending, left(word, length(word) - length(ending)) AS stem FROM h WHERE k = 1""")
def longest_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(x,) for x in ("tion", "ing", "ed", "n", "e")], "ending string")
    return endings(word_table(spark, sf_dir), rules)


@query(f"WITH {WORDS} SELECT word AS lemma FROM w WHERE NOT (right(word, 3) = 'the' OR right(word, 3) = 'ing' OR right(word, 4) = 'tion')")
def suffix_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemmas = spark.createDataFrame([("the",), ("ing",), ("tion",)], "lemma string")
    return vetoed(word_table(spark, sf_dir).select(F.col("word").alias("lemma")), lemmas)


@query("""WITH r AS (SELECT user_id::VARCHAR AS word, event_type AS form, (event_id % 3)::VARCHAR AS label, 'p' || (event_id % 4)::VARCHAR AS provenance, event_id FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, form, label ORDER BY event_id DESC) AS k FROM r) WHERE k = 1)
SELECT word, count(*)::INTEGER AS variants, array_to_string(list_sort(list_distinct(list(provenance))), ';') AS provenance FROM l GROUP BY word""")
def gathered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("word"), F.col("event_type").alias("form"), (F.col("event_id") % 3).cast("string").alias("label"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("provenance"), "event_id")
    return gathered(rows, "event_id").select("word", F.size("variants").alias("variants"), "provenance")


#: The documents' accented letters stand for the nine that fold.
_ACCENTED, _FOLDING = "éèêíóúñäö", "ėęęįųūčąž"


@query(f"""WITH {WORDS}, l AS MATERIALIZED (SELECT translate(word, '{_ACCENTED}', '{_FOLDING}') AS form, sum(freq)::BIGINT AS freq FROM w GROUP BY 1), f AS MATERIALIZED (SELECT translate(form, 'ąčęėįšųūž', 'aceeisuuz') AS fold, form, freq FROM l WHERE form <> translate(form, 'ąčęėįšųūž', 'aceeisuuz'))
SELECT l.form AS query, f.form, f.freq FROM l JOIN f ON f.fold = l.form""")
def fold_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir).groupBy(F.translate("word", _ACCENTED, _FOLDING).alias("form")).agg(F.sum("freq").alias("freq"))
    marked = fold_index(words).where("form <> fold").withColumnRenamed("fold", "query")
    return words.select(F.col("form").alias("query")).join(marked, "query").select("query", "form", "freq")


@query()
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # queries: every word with each pair of neighbours it has, against words seen twice or more (the reference's least count)
    found = corpus_suggestions(doc_words(spark, sf_dir))
    return found.select("qid", "word", "kind", F.array_join("corrections", ",").alias("corrections"), "autofix")


@query(f"""WITH {WORDS}, l AS (SELECT word, regexp_replace(word, '(?:ed|ing|s)$', '') AS lemma FROM w WHERE freq >= 5) SELECT word, lemma, 'R|0|' || (length(word) - length(lemma))::VARCHAR || '|' AS script FROM l WHERE lemma <> ''""")
def lemma_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_table(spark, sf_dir).where("freq >= 5").select("word", F.regexp_replace("word", "(?:ed|ing|s)$", "").alias("lemma"))
    return words.where("lemma <> ''").withColumn("script", lemma_script("word", "lemma"))


@query(f"WITH {WORDS} SELECT word, (CASE WHEN starts_with(word, 'the') THEN 3 WHEN starts_with(word, 'th') THEN 2 WHEN starts_with(word, 't') THEN 1 ELSE 0 END)::INTEGER AS k FROM w")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table(spark, sf_dir).select("word", common_prefix("word", F.lit("the")).alias("k"))


@query(f"WITH {WORDS} SELECT word, replace(strip_accents(word), 'ß', 'ss') AS ascii FROM w")
def ascii_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lt.map_distinct(word_table(spark, sf_dir).select("word"), "word", lt.ascii_key, "ascii", "string")
