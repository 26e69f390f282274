"""Queries that keep all tokens, on rows that the narrower ones leave out."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry


def documents(spark, tmp_path, texts):
    spark.createDataFrame([(i, t, "lt", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_all_tokens_are_classed(spark, tmp_path):
    sf = documents(spark, tmp_path, ["Dr. Jonas ir dr Ona, pvz. XIV a. kt", "gen.", "страна. a b.", None, ""])
    got = {r["class"]: r["n"] for r in entry.queries()["word_classes"](spark, sf).collect()}
    # Dr. pvz. a. gen. b. | XIV | Jonas ir dr Ona kt a | страна
    assert got == {"ABBREVIATION": 5, "NUMERAL": 1, "WORD": 6, "FOREIGN": 1}


def test_bigrams_up_to_the_reference_bound(spark, tmp_path):
    words = ["".join(chr(97 + (i // 26**j) % 26) for j in range(4)) for i in range(25_001)]
    sf = documents(spark, tmp_path, [" ".join(words)] * 2)
    got = entry.queries()["bigram_counts_topk"](spark, sf)
    assert got.count() == 25_000 and got.where("n <> 2").count() == 0


def test_all_words_are_spelling_queries(spark, tmp_path):
    texts = ["naujas žodis eina"] * 100 + ["naujas zodis eina"] * 2 + ["vienas namas", "vienas namss"] + ["vienas namas"] * 5
    sf = documents(spark, tmp_path, texts)
    got = {r["qid"]: (r["kind"], r["corrections"], r["autofix"]) for r in entry.queries()["spelling_suggestions"](spark, sf).collect()}
    assert got["naujas zodis eina"] == ("restore", "žodis", "žodis")  # a known word that another one dominates
    assert got["naujas žodis eina"][0] == got["^ naujas žodis"][0] == "ok"
    assert got["vienas namss ^"][:2] == ("typo", "namas")
    assert len(got) == 10


def test_intervals_at_half_seconds_and_without_an_end(spark, tmp_path):
    at = ["00:00:00.500000", "00:00:01.500000", "01:00:02.500000", "02:00:00.000000", "02:00:00.000000"]
    rows = [(1, 0, f"2024-01-01 {at[0]}"), (2, 1, f"2024-01-01 {at[1]}"), (3, 2, f"2024-01-01 {at[2]}"), (4, None, f"2024-01-01 {at[3]}"), (4, 3, f"2024-01-01 {at[4]}")]
    spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = db.sql(entry.oracle_sql()["interval_merge"]).fetchall()
    got = entry.queries()["interval_merge"](spark, str(tmp_path)).select("user_id", "a", "b", "n")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 4
