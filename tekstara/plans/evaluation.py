"""Queries of evaluation over the words' accented forms and the documents' languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stress
from ..operators import evaluation as ev
from .lexicon_joins import LEX, lex
from .metrics import PRED, predictions
from .registry import TOKENS, doc_tokens, query, table

#: Gold forms and what a system says: right, marked elsewhere, unmarked or nothing, by the word's length.
SAID = f"""{LEX}, said AS (SELECT word, freq, pos, n, k, acc AS gold, CASE n % 5 WHEN 0 THEN acc WHEN 1 THEN translate(acc, 'áéíóú', 'àèìòù') WHEN 2 THEN word WHEN 3 THEN acc || 'é' END AS said FROM a)"""
_PLACE = "length(regexp_extract({0}, '^[^áéíóúàèìòù]*[áéíóúàèìòù]')) - 1"


def place_sql(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '[áéíóúàèìòù]') THEN {_PLACE.format(c)} END)"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, acc = F.col("n") % 5, F.col("acc")
    s = F.when(n == 0, acc).when(n == 1, F.translate(acc, "áéíóú", "àèìòù")).when(n == 2, F.col("word")).when(n == 3, F.concat(acc, F.lit("é")))
    return lex(spark, sf_dir)["a"].select("word", "freq", "pos", "n", "k", acc.alias("gold"), s.alias("said"))


@query(f"WITH {SAID} SELECT word, coalesce(gold = said, false) AS exact, (said IS NOT NULL AND {place_sql('gold')} IS NOT DISTINCT FROM {place_sql('said')}) AS position, (said IS NULL OR NOT regexp_matches(said, '[áéíóúàèìòù]')) AS unmarked, {place_sql('gold')}::INTEGER AS place, 'acute' AS mark, strip_accents(gold) AS bare FROM said")
def token_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = F.col("gold"), F.col("said")
    return said(spark, sf_dir).select("word", ev.exact(g, s).alias("exact"), ev.position(g, s).alias("position"), ev.unmarked(s).alias("unmarked"), stress.place(g).alias("place"), stress.mark(g).alias("mark"), stress.bare(g).alias("bare"))


@query(f"WITH {SAID}, o AS (SELECT word, said, [gold, word || 'à'] AS options FROM said) SELECT word, coalesce(list_contains(options, said), false) AS exact, (said IS NOT NULL AND ({place_sql('options[1]')} IS NOT DISTINCT FROM {place_sql('said')} OR {place_sql('options[2]')} IS NOT DISTINCT FROM {place_sql('said')})) AS position FROM o")
def any_of_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = said(spark, sf_dir).select("word", "said", F.array("gold", F.concat("word", F.lit("à"))).alias("options"))
    return o.select("word", ev.exact_any(F.col("options"), F.col("said")).alias("exact"), ev.position_any(F.col("options"), F.col("said")).alias("position"))


@query(f"WITH {SAID}, v AS (SELECT pos, said IS NOT NULL AS ans, coalesce(gold = said, false) AS ex, (said IS NOT NULL AND {place_sql('gold')} IS NOT DISTINCT FROM {place_sql('said')}) AS po FROM said), c AS (SELECT pos, count(*)::BIGINT AS total, count(*) FILTER (WHERE ans)::BIGINT AS answered, count(*) FILTER (WHERE ex)::BIGINT AS exact, count(*) FILTER (WHERE po)::BIGINT AS position FROM v GROUP BY pos) SELECT *, exact::DOUBLE / total AS exact_of_all, coalesce(exact::DOUBLE / nullif(answered, 0), 0) AS exact_of_answered, coalesce(position::DOUBLE / nullif(answered, 0), 0) AS position_of_answered FROM c")
def accuracy_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.families(said(spark, sf_dir), ["pos"])


@query(f"WITH {TOKENS} SELECT lang, token, arg_min(pos, doc_id * 1000000 + pos)::INTEGER AS pos, arg_min(source, doc_id * 1000000 + pos) AS source FROM tok WHERE lang IS NOT NULL GROUP BY lang, token")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = doc_tokens(spark, sf_dir).where("lang is not null").withColumn("at", F.col("doc_id") * 1000000 + F.col("pos"))
    return ev.first_of_type(t.select("lang", "token", "pos", "source", "at"), ["lang", "token"], "at").select("lang", "token", "pos", "source")


@query(f"WITH {LEX}, d AS (SELECT word AS key, CASE WHEN n % 3 = 0 THEN acc WHEN n % 3 = 1 THEN word || '1' END AS said FROM a) SELECT doc_id, count(*)::BIGINT AS tokens, count(said)::BIGINT AS answered, coalesce(sum(length(said)), 0)::BIGINT AS chars FROM tok LEFT JOIN d ON d.key = tok.token GROUP BY doc_id")
def default_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array(F.struct(F.when(F.col("n") % 3 == 1, F.concat("word", F.lit("1"))).alias("form")))
    words = lex(spark, sf_dir)["a"].select(F.col("word").alias("key"), F.when(F.col("n") % 3 == 0, F.col("acc")).alias("default_form"), first.alias("variants"))
    t = ev.default_system(doc_tokens(spark, sf_dir).select("doc_id", F.col("token").alias("key")), words)
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count("said").alias("answered"), F.coalesce(F.sum(F.length("said")), F.lit(0)).alias("chars"))


@query("SELECT event_id, event_type || ':' || (user_id % 3)::VARCHAR AS said FROM events")
def distinct_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("m"))
    return ev.by_distinct(e, ["event_type", "m"], lambda d: d.withColumn("said", F.concat("event_type", F.lit(":"), F.col("m").cast("string")))).select("event_id", "said")


@query(f"WITH {PRED} SELECT layer, present FROM (SELECT count(a)::BIGINT AS a, count(b)::BIGINT AS b, count(c)::BIGINT AS c FROM pred) UNPIVOT (present FOR layer IN (a, b, c))")
def layer_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.layer_counts(predictions(spark, sf_dir), ["a", "b", "c"])


@query(f"WITH {PRED} SELECT doc_id AS global_index, gold, CASE WHEN a IS NOT NULL THEN a END AS x, CASE WHEN doc_id % 2 = 0 THEN b END AS y FROM pred")
def layers_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumnRenamed("doc_id", "global_index")
    layers = {"x": p.where("a is not null").select("global_index", F.col("a").alias("form")), "y": p.where("global_index % 2 = 0").select("global_index", F.col("b").alias("form"))}
    return ev.joined_layers(p.select("global_index", "gold"), layers)


@query(f"""WITH {PRED}, s AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.5 END AS accuracy_x, doc_id % 4 <> 0 AS accepted_x, CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE ELSE 0.75 END AS accuracy_y, doc_id % 3 <> 0 AS accepted_y FROM pred)
SELECT 'x' AS kind, avg(accepted_x::INTEGER)::DOUBLE AS coverage, avg(accuracy_x) FILTER (WHERE accepted_x) AS purity FROM s UNION ALL SELECT 'y', avg(accepted_y::INTEGER)::DOUBLE, avg(accuracy_y) FILTER (WHERE accepted_y) FROM s
UNION ALL SELECT 'all', avg((accepted_x AND accepted_y)::INTEGER)::DOUBLE, avg(accuracy_x * accuracy_y) FILTER (WHERE accepted_x AND accepted_y) FROM s""")
def coverage_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = predictions(spark, sf_dir), F.col("doc_id")
    p = p.select("doc_id", F.when(d % 4 != 0, 1.0).otherwise(0.5).alias("accuracy_x"), (d % 4 != 0).alias("accepted_x"), F.when(d % 3 == 0, 0.25).otherwise(0.75).alias("accuracy_y"), (d % 3 != 0).alias("accepted_y"))
    return ev.coverage_and_purity(p, ["x", "y"])


@query(f"WITH {PRED} SELECT source, gold, b AS said, min(doc_id) AS doc_id FROM pred WHERE b IS NOT NULL AND NOT coalesce(gold = b, false) GROUP BY ALL ORDER BY doc_id LIMIT 20")
def first_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.disagreements(predictions(spark, sf_dir).select("doc_id", "source", "gold", F.col("b").alias("said")), ["source"], "doc_id", 20)


_LABEL = "CASE event_id % 4 WHEN 0 THEN 'NOUN|Case=Nom' WHEN 1 THEN 'VERB|_' WHEN 2 THEN 'AUX|Tense=Past' ELSE 'NOUN|Case=Gen' END"
_SAID_LABEL = "CASE event_id % 6 WHEN 0 THEN 'NOUN|Case=Nom' WHEN 1 THEN 'VERB|_' WHEN 2 THEN 'VERB|Tense=Past' ELSE 'NOUN|Case=Nom' END"


@query(f"""WITH b AS (SELECT {_LABEL} AS g, CASE WHEN event_id % 7 <> 0 THEN {_SAID_LABEL} ELSE '_|_' END AS s FROM events), p AS (SELECT g, s, split_part(g, '|', 1) AS gu, split_part(s, '|', 1) AS su, split_part(g, '|', 2) AS gf, split_part(s, '|', 2) AS sf FROM b)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE g = s)::BIGINT AS label, count(*) FILTER (WHERE gu = su)::BIGINT AS upos, count(*) FILTER (WHERE gf = sf)::BIGINT AS feats, count(*) FILTER (WHERE gu IN ('AUX', 'VERB'))::BIGINT AS aux_verb_total, count(*) FILTER (WHERE gu IN ('AUX', 'VERB') AND g = s)::BIGINT AS aux_verb FROM p""")
def tag_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ev.tag_metrics(e.select("event_id", F.expr(_LABEL).alias("label")), e.where("event_id % 7 <> 0").select("event_id", F.expr(_SAID_LABEL).alias("label")), ["event_id"])


@query(f"SELECT event_id, split_part(l, '|', 1) AS upos, split_part(l, '|', 2) AS feats, l AS label FROM (SELECT event_id, {_LABEL} AS l FROM events)")
def label_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    upos, feats = ev.label_parts(F.col("l"))
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_LABEL).alias("l")).select("event_id", upos.alias("upos"), feats.alias("feats"))
    return e.withColumn("label", ev.combined(F.col("upos"), F.col("feats")))


@query("WITH b AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS a, CASE WHEN event_id % 5 = 0 THEN 'new' WHEN event_id % 6 <> 0 THEN event_type END AS b FROM events) SELECT count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL)::BIGINT AS filled, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT DISTINCT FROM a)::BIGINT AS kept, count(*) FILTER (WHERE a IS NOT NULL AND b IS DISTINCT FROM a)::BIGINT AS changed, count(*) FILTER (WHERE a IS NULL AND b IS NULL)::BIGINT AS empty FROM b")
def fill_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    before = e.select("event_id", F.when(i % 3 != 0, F.col("event_type")).alias("x"))
    return ev.fill_counts(before, e.select("event_id", F.when(i % 5 == 0, "new").when(i % 6 != 0, F.col("event_type")).alias("x")), ["event_id"], "x")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'fetched' ELSE event_type END AS row FROM events WHERE event_id % 3 = 0")
def cache_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cache = e.where("event_id % 4 <> 0").select("event_id", F.col("event_type").alias("row"))
    return ev.completed(cache, e.where("event_id % 3 = 0"), lambda ids: ids.withColumn("row", F.lit("fetched")), "event_id")


@query("""WITH g AS (SELECT event_id, event_type AS l FROM events WHERE event_id % 4 <> 0), s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE event_type END AS l FROM events WHERE event_id % 3 <> 0),
c AS (SELECT count(*) AS spans, count(*) FILTER (WHERE g.l IS NOT DISTINCT FROM s.l) AS label FROM g JOIN s USING (event_id)), n AS (SELECT (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM s) AS s),
r AS (SELECT 'spans' AS metric, spans AS correct FROM c UNION ALL SELECT 'label', label FROM c), p AS (SELECT metric, g::BIGINT AS gold, s::BIGINT AS system, correct::BIGINT AS correct, correct::DOUBLE / s AS precision, correct::DOUBLE / g AS recall FROM r, n)
SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p""")
def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = e.where("event_id % 4 <> 0").select("event_id", F.col("event_type").alias("label"))
    s = e.where("event_id % 3 <> 0").select("event_id", F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("event_type")).alias("label"))
    return ev.span_scores(g, s, ["event_id"], ["label"])


@query(f"WITH {SAID} SELECT word, CASE WHEN strip_accents(said) = word THEN said END AS guarded, CASE WHEN strip_accents(said) = word AND said <> word THEN said END AS one, CASE WHEN n % 10 / 10.0 >= 0.5 THEN said END AS sure FROM said")
def answer_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, s = F.col("word"), F.col("said")
    return said(spark, sf_dir).select("word", ev.guarded(w, s).alias("guarded"), ev.one_mark(w, s).alias("one"), ev.confident(s, (F.col("n") % 10) / 10.0, 0.5).alias("sure"))


@query(f"WITH {SAID} SELECT word, gold IN (left(word, k - 1) || translate(substr(word, k, 1), 'aeiou', 'áéíóú') || substr(word, k + 1)) AND n % 2 = 0 AS reachable, (CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS options FROM said")
def reachable_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("n") % 2 == 0, F.col("k") - 1).otherwise(99)
    forms = ev.option_forms(F.col("word"), F.array(F.struct(at.alias("index"), F.lit("acute").alias("mark"))))
    return said(spark, sf_dir).select("word", F.array_contains(forms, F.col("gold")).alias("reachable"), F.size(forms).alias("options"))


@query("SELECT vec_id, (list_position(embedding[1:16], list_max(embedding[1:16])) - 1)::INTEGER AS label, (list_position(embedding[17:32], list_max(embedding[17:32])) - 1)::INTEGER AS script FROM embeddings")
def factored_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", ev.argmax(F.slice("embedding", 1, 16)).alias("label"), ev.argmax(F.slice("embedding", 17, 16)).alias("script"))


@query("""WITH l(i, num, cas) AS (VALUES (1, 'Sing', 'Nom'), (2, 'Sing', 'Gen'), (3, 'Plur', 'Nom'), (4, 'Plur', 'Gen'), (5, NULL, 'Nom')), s AS (SELECT vec_id, num, cas, embedding[i]::DOUBLE AS p FROM embeddings, l WHERE CASE WHEN vec_id % 2 = 0 THEN cas = 'Nom' ELSE cas = 'Gen' END),
m AS (SELECT vec_id, num AS value, max(p) AS p FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, value) AS r, p - coalesce(lead(p) OVER (PARTITION BY vec_id ORDER BY p DESC, value), 0) AS lead FROM m)
SELECT vec_id, value, round(lead, 6) AS lead FROM r WHERE r = 1 AND lead >= 0.05 AND value IS NOT NULL""")
def constrained_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = [("Sing", "Nom"), ("Sing", "Gen"), ("Plur", "Nom"), ("Plur", "Gen"), (None, "Nom")]
    maps = F.array(*[F.create_map(*[F.lit(x) for kv in (("Number", n), ("Case", c)) if kv[1] for x in kv]) for n, c in labels])
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.create_map(F.lit("Case"), F.when(F.col("vec_id") % 2 == 0, "Nom").otherwise("Gen")).alias("known"), F.explode(F.arrays_zip(maps.alias("feats"), F.slice("embedding", 1, 5).alias("p"))).alias("x"))
    out = ev.constrained(e.select("vec_id", "known", "x.feats", F.col("x.p").cast("double").alias("p")), ["vec_id"], "Number", 0.05)
    return out.select("vec_id", "value", F.round("lead", 6).alias("lead"))
