"""Queries of metrics: coverage, accuracy, agreement, confusion, parity, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.tags import canonical_feats, parse_feats, parse_label, score, spurious, token_slots
from ..operators.disambiguation import best_labels, decoded
from ..operators.measures import accepted, accuracy, audited, confusion, coverage_diff, fixed_domain, parity, pattern, strata
from ..operators.ranking import first_max, unanimous_top, unique_top
from .registry import TOKENS, WORDS, doc_tokens, query, table, word_table

#: Heuristic predictions of a document's language, and its gold label.
PRED = r"""pred AS (SELECT doc_id, source, lang AS gold, CASE WHEN len(regexp_extract_all(text, '[äöüß]')) > 3 THEN 'de' WHEN len(regexp_extract_all(text, '[ñí]')) > 3 THEN 'es' WHEN len(regexp_extract_all(text, '[éèê]')) > 3 THEN 'fr' WHEN length(text) > 200 THEN 'en' END AS a,
CASE WHEN regexp_matches(text, '(^| )(der|die|und) ') THEN 'de' WHEN regexp_matches(text, '(^| )(los|las|que) ') THEN 'es' WHEN regexp_matches(text, '(^| )(les|des|une) ') THEN 'fr' WHEN regexp_matches(text, '(^| )(the|of|and) ') THEN 'en' END AS b,
CASE WHEN text LIKE '%ción%' THEN 'es' WHEN text LIKE '%ung%' THEN 'de' WHEN text LIKE '%tion%' THEN 'en' END AS c FROM documents)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    many = lambda p: F.regexp_count("text", F.lit(p)) > 3
    word = lambda p: F.col("text").rlike(f"(^| )({p}) ")
    a = F.when(many("[äöüß]"), "de").when(many("[ñí]"), "es").when(many("[éèê]"), "fr").when(F.length("text") > 200, "en")
    b = F.when(word("der|die|und"), "de").when(word("los|las|que"), "es").when(word("les|des|une"), "fr").when(word("the|of|and"), "en")
    c = F.when(F.col("text").contains("ción"), "es").when(F.col("text").contains("ung"), "de").when(F.col("text").contains("tion"), "en")
    return d.select("doc_id", "source", F.col("lang").alias("gold"), a.alias("a"), b.alias("b"), c.alias("c"))


@query(f"""WITH {PRED} SELECT gold, count(*)::BIGINT AS total, count(a)::BIGINT AS answered, count(*) FILTER (WHERE a = gold)::BIGINT AS exact,
coalesce((count(*) FILTER (WHERE a = gold))::DOUBLE / nullif(count(*), 0), 0) AS exact_of_all, coalesce((count(*) FILTER (WHERE a = gold))::DOUBLE / nullif(count(a), 0), 0) AS exact_of_answered FROM pred GROUP BY gold""")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(predictions(spark, sf_dir), ["gold"], "gold", "a")


@query(f"WITH {PRED}, s AS (SELECT source, bool_and(coalesce(a = gold, false)) AS ok FROM pred GROUP BY source) SELECT ok, count(*)::BIGINT AS n FROM s GROUP BY ok")
def sentence_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = predictions(spark, sf_dir).groupBy("source").agg(F.bool_and(F.coalesce(F.col("a") == F.col("gold"), F.lit(False))).alias("ok"))
    return ok.groupBy("ok").agg(F.count("*").alias("n"))


_PATTERN = """CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'none' WHEN b IS NULL AND c IS NULL THEN 'a-only' WHEN a IS NULL AND c IS NULL THEN 'b-only' WHEN a IS NULL AND b IS NULL THEN 'c-only'
WHEN a IS NULL THEN CASE WHEN b = c THEN 'b+c' ELSE 'b vs c' END WHEN b IS NULL THEN CASE WHEN a = c THEN 'a+c' ELSE 'a vs c' END WHEN c IS NULL THEN CASE WHEN a = b THEN 'a+b' ELSE 'a vs b' END
WHEN a = b AND b = c THEN 'a+b+c' WHEN a = b THEN 'a+b vs c' WHEN a = c THEN 'a+c vs b' WHEN b = c THEN 'b+c vs a' ELSE 'a vs b vs c' END"""
_STRATA = f"""{PRED}, pat AS (SELECT *, {_PATTERN} AS pattern, CASE WHEN a IS NOT NULL AND NOT coalesce(b = c AND a <> b, false) THEN a ELSE coalesce(b, c) END AS said FROM pred),
st AS (SELECT pattern, count(*)::BIGINT AS count, count(*) FILTER (WHERE said = gold)::BIGINT AS correct, coalesce((count(*) FILTER (WHERE said = gold))::DOUBLE / count(*), 0) AS accuracy, count(*)::DOUBLE / (SELECT count(*) FROM pat) AS share FROM pat GROUP BY pattern)"""


def patterned(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.coalesce((F.col("b") == F.col("c")) & (F.col("a") != F.col("b")), F.lit(False))
    said = F.when(F.col("a").isNotNull() & ~two, F.col("a")).otherwise(F.coalesce("b", "c"))
    return predictions(spark, sf_dir).withColumn("pattern", pattern(["a", "b", "c"])).withColumn("said", said)


@query(f"WITH {_STRATA} SELECT * FROM st")
def agreement_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata(patterned(spark, sf_dir), "pattern", F.col("said") == F.col("gold"))


@query(f"WITH {_STRATA} SELECT doc_id, pattern, accuracy AS stratum_accuracy, accuracy >= 0.95 AS accepted FROM pat JOIN st USING (pattern)")
def strata_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterned(spark, sf_dir)
    return accepted(rows, strata(rows, "pattern", F.col("said") == F.col("gold")), "pattern", 0.95).select("doc_id", "pattern", "stratum_accuracy", "accepted")


@query(f"""WITH {PRED} SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'both_bare' WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' WHEN a = b THEN 'agree' ELSE 'disagree' END AS bucket, count(*)::BIGINT AS n FROM pred GROUP BY 1""")
def confusion_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy(confusion(F.col("a"), F.col("b")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {PRED} SELECT avg((a = b)::INTEGER)::DOUBLE AS ab, avg((b = c)::INTEGER)::DOUBLE AS bc, avg((a = c)::INTEGER)::DOUBLE AS ac FROM pred")
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda x, y: F.avg((F.col(x) == F.col(y)).cast("int")).alias(x + y)
    return predictions(spark, sf_dir).agg(rate("a", "b"), rate("b", "c"), rate("a", "c"))


@query(f"""WITH {TOKENS}, x AS (SELECT right(token, 2) AS ending, count(*) AS n FROM tok WHERE lang = 'de' GROUP BY 1), y AS (SELECT right(token, 2) AS ending, count(*) AS n FROM tok WHERE lang = 'en' GROUP BY 1)
SELECT ending, coalesce(x.n, 0)::BIGINT AS n_a, coalesce(y.n, 0)::BIGINT AS n_b, (coalesce(x.n, 0) - coalesce(y.n, 0))::BIGINT AS diff FROM x FULL JOIN y USING (ending)""")
def coverage_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = doc_tokens(spark, sf_dir).select("lang", F.right("token", F.lit(2)).alias("ending"))
    return coverage_diff(t.where("lang = 'de'"), t.where("lang = 'en'"), ["ending"])


@query(f"""WITH {TOKENS}, tr AS (SELECT DISTINCT token FROM tok WHERE doc_id % 5 <> 0), te AS (SELECT token, count(*) AS n FROM tok WHERE doc_id % 5 = 0 GROUP BY token)
SELECT count(*)::BIGINT AS types, (count(*) FILTER (WHERE token NOT IN (SELECT token FROM tr)))::DOUBLE / count(*) AS oov_types, (sum(n) FILTER (WHERE token NOT IN (SELECT token FROM tr)))::DOUBLE / sum(n) AS oov_tokens FROM te""")
def oov_label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = doc_tokens(spark, sf_dir)
    train = t.where("doc_id % 5 <> 0").select("token").distinct().withColumn("seen", F.lit(True))
    test = t.where("doc_id % 5 = 0").groupBy("token").agg(F.count("*").alias("n")).join(train, "token", "left")
    new = F.col("seen").isNull()
    return test.agg(F.count("*").alias("types"), (F.count_if(new) / F.count("*")).alias("oov_types"), (F.sum(F.when(new, F.col("n"))) / F.sum("n")).alias("oov_tokens"))


_PARITY = f"""{WORDS}, pa AS (SELECT word, list_distinct([left(word, 3), right(word, 3)]) AS fa, left(word, 3) AS da FROM w), pb AS (SELECT word, CASE length(word) % 5 WHEN 0 THEN [left(word, 3), right(word, 3)] WHEN 1 THEN [left(word, 3)] WHEN 2 THEN [right(word, 3)] WHEN 3 THEN ['zzz'] END AS fb, CASE length(word) % 5 WHEN 0 THEN left(word, 3) WHEN 1 THEN left(word, 3) ELSE 'q' END AS db FROM w),
bk AS (SELECT CASE WHEN fb IS NULL THEN 'UNCOVERED' WHEN list_sort(fa) = list_sort(list_distinct(fb)) AND da = db THEN 'EXACT' WHEN da = db THEN 'DEFAULT-MATCH' WHEN list_has_any(fa, fb) THEN 'OVERLAP' WHEN length(pa.word) > 8 THEN 'NORM-DELTA' ELSE 'DISJOINT' END AS bucket FROM pa JOIN pb USING (word))"""


@query(f"WITH {_PARITY} SELECT b.bucket, count(bk.bucket)::BIGINT AS n FROM (SELECT unnest(['EXACT', 'DEFAULT-MATCH', 'OVERLAP', 'NORM-DELTA', 'DISJOINT', 'UNCOVERED', 'EXTRA']) AS bucket) b LEFT JOIN bk USING (bucket) GROUP BY b.bucket")
def parity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l3, r3, n = F.left("word", F.lit(3)), F.right("word", F.lit(3)), F.length("word") % 5
    fb = F.when(n == 0, F.array_distinct(F.array(l3, r3))).when(n == 1, F.array(l3)).when(n == 2, F.array(r3)).when(n == 3, F.array(F.lit("zzz")))
    rows = word_table(spark, sf_dir).select(parity(F.array_distinct(F.array(l3, r3)), l3, fb, F.when(n <= 1, l3).otherwise("q"), F.length("word") > 8).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    return fixed_domain(counts, "bucket", ["EXACT", "DEFAULT-MATCH", "OVERLAP", "NORM-DELTA", "DISJOINT", "UNCOVERED", "EXTRA"])


@query("""WITH o AS (SELECT * FROM (VALUES ('click', 'replace', ['tap', 'press']), ('view', 'accept-also', ['look']), ('error', 'exclude', NULL), ('purchase', 'unmarked-ok', NULL), ('signup', 'accept-any-observed', NULL)) t(word, action, accept)),
s AS (SELECT event_type AS word, array_agg(DISTINCT event_type || (user_id % 3)::VARCHAR) AS seen FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT event_id, event_type AS word, CASE WHEN action = 'replace' THEN 'press,tap' WHEN action = 'accept-also' THEN 'look,view' WHEN action = 'accept-any-observed' THEN array_to_string(list_sort(list_distinct(list_append(seen, event_type))), ',') ELSE event_type END AS accepted,
coalesce(action = 'unmarked-ok', false) AS optional FROM events LEFT JOIN o ON o.word = event_type LEFT JOIN s ON s.word = event_type WHERE coalesce(action <> 'exclude', true)""")
def audit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlay = spark.createDataFrame([("click", "replace", ["tap", "press"]), ("view", "accept-also", ["look"]), ("error", "exclude", None), ("purchase", "unmarked-ok", None), ("signup", "accept-any-observed", None)], "word string, action string, accept array<string>")
    events = table(spark, sf_dir, "events")
    gold = events.select("event_id", F.col("event_type").alias("word"), F.col("event_type").alias("gold"))
    seen = events.where("user_id is not null").select(F.col("event_type").alias("word"), F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("form"))
    return audited(gold, overlay, seen).select("event_id", "word", F.array_join("right", ",").alias("accepted"), "optional")


@query("SELECT conv_id, CASE WHEN count(*) FILTER (WHERE length(text) = m) = 1 AND count(*) > 1 THEN arg_max(turn, length(text)) ELSE min(turn) END AS turn, (count(*) FILTER (WHERE length(text) = m) = 1 AND count(*) > 1) AS resolved FROM (SELECT *, max(length(text)) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def unique_top_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.col("turn").alias("d"))
    return unique_top(turns, ["conv_id"], "turn", "n", "d")


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1 AND value > 0")
def first_max_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", "value", "event_id")
    return first_max(e, ["user_id"], "event_type", "value", "event_id")


@query("""WITH e AS (SELECT user_id, event_type, floor(value / 10) AS s FROM events WHERE value IS NOT NULL), m AS (SELECT user_id, max(s) AS s FROM e GROUP BY user_id)
SELECT user_id, min(event_type) AS event_type FROM e JOIN m USING (user_id, s) GROUP BY user_id HAVING min(event_type) = max(event_type)""")
def unanimous_top_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type", F.floor(F.col("value") / 10).alias("s"))
    return unanimous_top(e, ["user_id"], "event_type", "s")


_FEATS = "CASE event_id % 4 WHEN 0 THEN '_' WHEN 1 THEN 'Number=Sing|Case=Nom|Gender=Masc' WHEN 2 THEN 'VerbForm=Part|Tense=Past|Case=Gen' ELSE 'Degree=Pos|Case=Acc|bad' END"


def feats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_FEATS).alias("feats"))


@query(f"SELECT event_id, CASE WHEN len(f) = 0 THEN '_' ELSE array_to_string(list_sort(f), '|') END AS feats, len(f)::INTEGER AS n FROM (SELECT event_id, list_filter(string_split({_FEATS}, '|'), lambda x: instr(x, '=') > 1) AS f FROM events)")
def feats_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = feats_rows(spark, sf_dir)
    return r.select("event_id", canonical_feats(F.col("feats")).alias("feats"), F.size(parse_feats(F.col("feats"))).alias("n"))


#: Labels with the slots they fill, and the slots of the four contexts of ``feats_rows``, as the SQL has them.
LABELS = ["dkt., vyr. g., vns. vard.", "dkt., vyr. g., dgs. kilm.", "bdv., mot. g., vns. gal.", "vksm., es. l., 3 asm.", "dlv., būt. l., kilm.", "dkt., vyr. g.", "prv., aukšt. l."]
_NAMES = "pos, gender, number, case_, tense, person, voice, degree"
_SLOTS = f"""l(label, {_NAMES}) AS (VALUES ('dkt., vyr. g., vns. vard.', 'NOUN', 'Masc', 'Sing', 'Nom', NULL, NULL, NULL, NULL), ('dkt., vyr. g., dgs. kilm.', 'NOUN', 'Masc', 'Plur', 'Gen', NULL, NULL, NULL, NULL), ('bdv., mot. g., vns. gal.', 'ADJ', 'Fem', 'Sing', 'Acc', NULL, NULL, NULL, NULL),
('vksm., es. l., 3 asm.', 'VERB', NULL, NULL, NULL, 'Pres', '3', NULL, NULL), ('dlv., būt. l., kilm.', 'PART_VERB', NULL, NULL, 'Gen', 'Past', NULL, NULL, NULL), ('dkt., vyr. g.', 'NOUN', 'Masc', NULL, NULL, NULL, NULL, NULL, NULL), ('prv., aukšt. l.', 'ADV', NULL, NULL, NULL, NULL, NULL, NULL, 'Cmp')),
c(k, upos, feats, {_NAMES}) AS (VALUES (0, 'NOUN', '_', 'NOUN', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (1, 'NOUN', 'Number=Sing|Case=Nom|Gender=Masc', 'NOUN', 'Masc', 'Sing', 'Nom', NULL, NULL, NULL, NULL), (2, 'VERB', 'VerbForm=Part|Tense=Past|Case=Gen', 'PART_VERB', NULL, NULL, 'Gen', 'Past', NULL, NULL, NULL), (3, 'NOUN', 'Degree=Pos|Case=Acc|bad', 'NOUN', NULL, NULL, 'Acc', NULL, NULL, NULL, NULL)),
s AS (SELECT c.k, c.upos, c.feats, l.label, (CASE WHEN l.pos IS NULL OR c.pos IS NULL THEN 0 WHEN l.pos = c.pos THEN 4 ELSE -3 END + {" + ".join(f"CASE WHEN l.{x} IS NULL OR c.{x} IS NULL THEN 0 WHEN l.{x} = c.{x} THEN 2 ELSE -2 END" for x in _NAMES.split(", ")[1:])})::INTEGER AS s,
{" + ".join(f"(l.{x} IS NOT NULL AND c.{x} IS NULL)::INTEGER" for x in _NAMES.split(", "))} AS extra FROM c, l)"""


def scored(df: DataFrame, extra: list[str]) -> DataFrame:
    """Each context (upos, feats) with each label, its score and its spurious slots."""
    context = df.withColumn("slots", token_slots(F.col("upos"), parse_feats(F.col("feats"))))
    tried = context.select(*extra, "upos", "feats", "slots", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label")).withColumn("reading", parse_label(F.col("label")))
    return tried.select(*extra, "upos", "feats", "label", score(F.col("reading"), F.col("slots")).cast("int").alias("s"), spurious(F.col("reading"), F.col("slots")).alias("extra"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feats_rows(spark, sf_dir).withColumn("upos", F.when(F.col("event_id") % 4 == 2, "VERB").otherwise("NOUN"))


@query(f"WITH {_SLOTS} SELECT event_id, label, s FROM events JOIN s ON s.k = event_id % 4")
def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(contexts(spark, sf_dir), ["event_id"]).select("event_id", "label", "s")


@query(f"WITH {_SLOTS} SELECT upos, feats, CASE WHEN s > 0 THEN label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, extra, label) AS r FROM s) WHERE r = 1")
def label_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct context's best label: highest score, then fewest spurious slots, then text; none at 0 or less."""
    return best_labels(scored(contexts(spark, sf_dir).select("upos", "feats").distinct(), []), ["upos", "feats"])


@query("""WITH d AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, max(x) AS m FROM d GROUP BY vec_id),
p AS (SELECT vec_id, i % 4 AS label, exp(x - m) AS e FROM d JOIN m USING (vec_id)), s AS (SELECT vec_id, label, sum(e) / sum(sum(e)) OVER (PARTITION BY vec_id) AS prob FROM p GROUP BY vec_id, label)
SELECT vec_id, label::INTEGER AS label, round(prob, 9) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, label) AS r FROM s) WHERE r <= 2""")
def softmax_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array_max(F.transform("embedding", lambda x: x.cast("double"))).alias("m"), F.posexplode("embedding").alias("i", "x"))
    merged = e.groupBy("vec_id", (F.col("i") % 4).alias("label")).agg(F.sum(F.exp(F.col("x").cast("double") - F.col("m"))).alias("e"))
    prob = merged.withColumn("prob", F.col("e") / F.sum("e").over(W.partitionBy("vec_id")))
    w = W.partitionBy("vec_id").orderBy(F.desc("prob"), "label")
    return prob.withColumn("r", F.row_number().over(w)).where("r <= 2").select("vec_id", "label", F.round("prob", 9).alias("prob"))


_WORDS5 = ["vyras", "namas", "pirko", "slėnio", "abatija"]
# places (letter * 3 + mark; marks: grave, acute, tilde) that the five words may bear a mark at, written down by hand
_PLACES = {"vyras": [4, 5, 8, 9, 10, 11], "namas": [3, 4, 5, 8, 9, 10, 11], "pirko": [3, 8, 12, 13, 14], "slėnio": [7, 8, 11, 12, 13, 14, 15, 16, 17], "abatija": [0, 1, 2, 6, 7, 8, 12, 18, 19, 20]}


@query(f"""WITH p AS (SELECT unnest([{", ".join(f"'{w}'" for w in _WORDS5)}]) AS word, unnest([{", ".join(map(str, _PLACES.values()))}]) AS places), e AS (SELECT vec_id, [{", ".join(f"'{w}'" for w in _WORDS5)}][1 + vec_id % 5] AS word, embedding FROM embeddings),
c AS (SELECT vec_id, word, embedding[64] AS none, i, embedding[i + 1] AS x FROM (SELECT e.*, unnest(places) AS i FROM e JOIN p USING (word))), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM c)
SELECT vec_id, word, CASE WHEN x > none THEN i // 3 END::INTEGER AS letter, CASE WHEN x > none THEN ['grave', 'acute', 'tilde'][1 + i % 3] END AS mark FROM t WHERE r = 1""")
def masked_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("word", F.get(F.array(*[F.lit(w) for w in _WORDS5]), (F.col("vec_id") % 5).cast("int")))
    return decoded(e, "word", "embedding", F.get("embedding", 63)).select("vec_id", "word", "letter", "mark")
