"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB's form of the token table: doc_id, lang, pos, token.
TOKENS = r"""tok AS (SELECT doc_id, lang, source, unnest(range(0, len(t))) AS pos, unnest(t) AS token
FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{M}]+') AS t FROM documents))"""
#: word, freq, docs of every distinct token.
WORDS = f"{TOKENS}, w AS MATERIALIZED (SELECT token AS word, count(*)::BIGINT AS freq, count(DISTINCT doc_id)::BIGINT AS docs FROM tok GROUP BY token)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL for the same rows where SQL can express them."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and all tokens of a document in order, as an array."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens(F.lower("text")).alias("tokens"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pos, token of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(tokens(F.lower("text"))).alias("pos", "token"))


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, freq, docs: two steps, so that a common word's occurrences are summed before they are shuffled."""
    by_doc = doc_tokens(spark, sf_dir).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy(F.col("token").alias("word")).agg(F.sum("n").alias("freq"), F.count("*").alias("docs"))
