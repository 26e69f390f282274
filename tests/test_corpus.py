from pyspark.sql import functions as F

from tekstara.functions.tags import SLOT_TYPE
from tekstara.operators import corpus, disambiguation


def test_batches():
    assert corpus.batches([4, 13, 4], 8) == [[1], [0, 2]]
    assert corpus.batches([], 8) == []


def test_closure(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    merges = spark.createDataFrame([("a", "b", "ab"), ("ab", "c", "abc"), ("x", "y", "xy")], "left string, right string, merged string")
    got = corpus.merge_closure(spark.createDataFrame([("abc",)], "piece string"), merges)
    assert {r["piece"] for r in got.collect()} == {"abc", "ab", "c", "a", "b"}


def test_pick(spark):
    slots = "named_struct('pos','VERB','gender',cast(null as string),'number',cast(null as string),'case',cast(null as string),'tense','Pres','person','3','voice',cast(null as string),'degree',cast(null as string))"
    rows = [(1, "yra", "būti", 0, "ỹra", ["vksm., es. l., 3 asm."], None), (1, "yra", "būti", 1, "yrà", ["vksm., es. l., 3 asm."], None), (2, "yra", "x", 0, "ỹra", ["vksm."], "yrà"), (2, "yra", "x", 1, "yrà", ["vksm."], "yrà"),
            (3, "w", "l", 0, "a", ["dkt."], "a"), (3, "w", "l", 1, "b", ["vksm., es. l."], "a"), (4, "w", "l", 0, "a", ["vksm."], None)]
    df = spark.createDataFrame(rows, "k int, word string, lemma string, index int, form string, labels array<string>, default_form string").withColumn("context", F.expr(slots).cast(SLOT_TYPE))
    got = {r["k"]: (r["index"], r["resolved_by"]) for r in disambiguation.pick(df, ["k"]).collect()}
    assert got == {1: (1, "lemma"), 2: (1, None), 3: (1, "context"), 4: (0, None)}
    bare = df.withColumn("context", F.lit(None).cast(SLOT_TYPE))
    assert {r["k"]: r["index"] for r in disambiguation.pick(bare, ["k"]).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_training_rows(spark):
    schema = "word string, default_form string, variants array<struct<form:string,mi:array<string>>>"
    words = spark.createDataFrame([("a", "á", [("á", ["x", "y"]), ("à", ["x"])]), ("b", None, [("b", ["z"])])], schema)
    assert sorted(tuple(r) for r in corpus.labelled_rows(words).collect()) == [("a", "", "á"), ("a", "x", "à"), ("a", "x", "á"), ("a", "y", "á"), ("b", "z", "b")]
    assert [r["word"] for r in corpus.unmarked_words(words, F.col("form").rlike("[^a-z]")).collect()] == ["b"]


def test_blocks(spark):
    a = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcde")], "k int, pos int, item string")
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate("xbcye")], "k int, pos int, item string")
    assert sorted(tuple(r) for r in corpus.block_aligned(a, b, "k").collect()) == [(1, 1, 1), (1, 2, 2), (1, 4, 4)]
