"""Queries of corpus steps: summaries, censuses, complete documents, homographs, alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.corpus import block_aligned, complete_groups, join_hyphenated
from ..operators.disambiguation import merged_probabilities
from .registry import TOKENS, WORDS, doc_tokens, query, table, word_table


@query(f"WITH {WORDS} SELECT doc_id FROM tok LEFT JOIN (SELECT word FROM w WHERE docs >= 2) k ON k.word = tok.token GROUP BY doc_id HAVING bool_and(k.word IS NOT NULL)")
def complete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = word_table(spark, sf_dir).where("docs >= 2").select(F.col("word").alias("token"))
    return complete_groups(doc_tokens(spark, sf_dir).select("doc_id", "token"), known, "doc_id", ["token"])


@query(f"WITH {TOKENS} SELECT lang, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS tokens, count(*) FILTER (WHERE length(token) > 3)::BIGINT AS long_tokens, count(DISTINCT token)::BIGINT AS types FROM tok GROUP BY lang")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = doc_tokens(spark, sf_dir).groupBy("lang", "token", "doc_id").agg(F.count("*").alias("n"))
    return by_type.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.length("token") > 3, F.col("n"))), F.lit(0)).alias("long_tokens"), F.countDistinct("token").alias("types"))


@query(r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS a, len(list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda x: x <> '')) AS b FROM documents)
SELECT source, count(*)::BIGINT AS docs, count(*) FILTER (WHERE a = b)::BIGINT AS identical, max(abs(a - b))::INTEGER AS worst FROM s GROUP BY source""")
def segmentation_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.size(tokens("text")), F.size(F.filter(F.split("text", r"[ \n\t]+"), lambda x: x != ""))
    s = table(spark, sf_dir, "documents").select("source", a.alias("a"), b.alias("b"))
    return s.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"))


@query(f"""WITH {TOKENS}, g AS (SELECT token, lang, count(*) AS n FROM tok WHERE lang IS NOT NULL GROUP BY ALL), h AS (SELECT token, count(*) AS k, max(n) AS top, sum(n) AS total FROM g GROUP BY token HAVING count(*) > 1)
SELECT token, k::BIGINT AS languages, total::BIGINT AS rows, (top = total) AS word_exact, top::BIGINT AS rows_exact FROM h""")
def homograph_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = doc_tokens(spark, sf_dir).where("lang is not null").groupBy("token", "lang").agg(F.count("*").alias("n"))
    h = g.groupBy("token").agg(F.count("*").alias("languages"), F.max("n").alias("rows_exact"), F.sum("n").alias("rows")).where("languages > 1")
    return h.select("token", "languages", "rows", (F.col("rows_exact") == F.col("rows")).alias("word_exact"), "rows_exact")


@query(r"SELECT doc_id, length(regexp_replace(replace(text, ' th', '-' || chr(10) || 'th'), '(\p{L})-\n\s*(\p{Ll})', '\1\2', 'g'))::INTEGER AS n FROM documents")
def hyphen_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace("text", F.lit(" th"), F.lit("-\nth"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(join_hyphenated(broken)).alias("n"))


@query("""WITH d AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, 10 * unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT vec_id, i % 5 AS label, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM d WINDOW w AS (PARTITION BY vec_id)),
m AS (SELECT vec_id, label, sum(p) AS p FROM p WHERE p > 0.1 GROUP BY ALL), k AS (SELECT vec_id, count(*) >= 2 AS ambiguous, count(*) FILTER (WHERE p >= 0.9) = 1 AS resolved FROM m GROUP BY vec_id)
SELECT vec_id, label::INTEGER AS label, round(p, 6) AS p, ambiguous, resolved FROM m JOIN k USING (vec_id)""")
def reading_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (F.col("i") % 5).alias("label"), (10 * F.col("x").cast("double")).alias("x"))
    return merged_probabilities(e, ["vec_id"], "x", "label").select("vec_id", "label", F.round("p", 6).alias("p"), "ambiguous", "resolved")


@query()
def align_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tokens(F.lower("text"))).alias("p", "item"))
    t = t.withColumn("pos", (F.col("turn") * 10000 + F.col("p")).cast("int")).select("conv_id", "pos", "item")
    return block_aligned(t, t.where("pos % 7 <> 2"), "conv_id")
