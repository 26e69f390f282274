"""A corpus pipeline of five stages: quality rules, language ID, near duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tekstara.llm import decontam, langid, neardup, packing, quality
from tekstara.llm.common import load, settle, tidy

#: Least calibrated probability of a document's language.
SURE = 0.5
#: The quality rules without the longest length: no text leaves for its length alone.
RULES = [r for r in quality.RULES if r[:2] != ("n_words", ">")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts don't; repeated rows are judged alike; an empty table stays so."""
    return quality.good_rows(docs, rules=RULES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language by a model learned from these documents, with a probability of SURE at least.

    Texts without a letter and null ones go; where no row has a text and a language to learn from, all go. Repeated rows are
    judged alike; other columns may have any names.
    """
    free = lambda name: next(x for x in (f"__{name}{'_' * i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    lang, score = free("lang"), free("score")
    named = langid.predict(docs, langid.fitted(docs), keep=tuple(docs.columns), names=(lang, score))
    return named.where((F.col(lang) != "und") & (F.col(score) >= SURE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group linked by five-word shingles at a similarity of 0.8.

    Rows that share an id are documents of their own. Rows without an id are compared with each other alone.
    """
    named, unnamed = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        # those to leave are far fewer than those to keep, so that texts are seldom shuffled to meet them
        left = neardup.near_duplicates(named, k=5).where("not kept").select("doc_id")
        one = named.join(left, "doc_id", "left_anti").select(*docs.columns)
    else:
        one = by_row(named)
    return one if unnamed.isEmpty() else one.unionByName(by_row(unnamed))


def by_row(docs: DataFrame) -> DataFrame:
    """The row of the least id of each group, by a row key instead of the id; rows without words are grouped by id."""
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = neardup.near_duplicates(rows, id_col="__row", k=5).join(rows.select("__row", "doc_id"), "__row")
    empty = F.col("n_shingles") == 0
    first = found.groupBy(F.when(~empty, F.col("component_id")).alias("c"), F.when(empty, F.col("doc_id")).alias("d")).agg(F.min(F.struct("doc_id", "__row"))["__row"].alias("__row"))
    return rows.join(first.select("__row"), "__row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts stay, as do repeated rows; with no items all stay."""
    return decontam.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of the documents left, a row a document. Null and empty texts have length 0;
    repeated rows are packed one by one; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: SQL can't express the models and the dynamic programme; the tests hold the stages against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over what the one before wrote. Folders of all but the result are removed."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tidy(stage)(spark, docs, sf_dir)
    return docs
