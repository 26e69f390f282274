"""Spelling over a whole corpus against the operator for given queries."""

import random

import pytest
from pyspark.sql import functions as F

from tekstara.functions.lithuanian import osa
from tekstara.operators import corrections, spelling
from tekstara.operators.sequences import neighbours


def test_distances_are_those_one_by_one():
    random.seed(3)
    a = ["".join(random.choices("abė", k=random.randint(0, 7))) for _ in range(3000)] + ["a" * 70, "ab" * 40]
    b = ["".join(random.choices("abė", k=random.randint(0, 7))) for _ in range(3000)] + ["a" * 69 + "b", "ba" * 40]
    assert list(corrections.distances(a, b)) == [osa(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("codes", [corrections.CODES, 5])
def test_a_corpus_is_corrected_as_its_queries_are(spark, monkeypatch, codes):
    monkeypatch.setattr(corrections, "CODES", codes)
    monkeypatch.setattr(corrections, "STEP", 50)
    random.seed(5)
    known = ["".join(random.choices("abcdžš", k=random.randint(1, 6))) for _ in range(60)]
    typos = ["".join(random.choices("abcdz", k=random.randint(1, 7))) for _ in range(60)]
    lines = [random.choices(known, k=random.randint(0, 12)) for _ in range(150)]
    for i, w in enumerate(typos):
        lines[i] = [*lines[i], w, *random.choices(known, k=2)]
    lines += [["žodis", "eina"]] * 100 + [["zodis", "eina"], ["ab", "zodis"]] * 2 + [None]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, tokens array<string>")
    words = texts.select(F.explode("tokens").alias("form")).groupBy("form").agg(F.count("*").alias("freq")).where("freq >= 2")
    asked = neighbours(texts, "doc_id", "tokens").select(F.col("prev_word").alias("prev"), F.col("token").alias("word"), F.col("next_word").alias("next")).distinct()
    asked = asked.withColumn("qid", F.concat_ws(" ", *[F.coalesce(c, F.lit("^")) for c in ("prev", "word", "next")]))
    want = sorted(map(tuple, spelling.suggest(asked, words, spelling.bigrams(texts)).collect()), key=str)
    got = sorted(map(tuple, corrections.corpus_suggestions(texts).select("qid", "word", "kind", "corrections", "autofix").collect()), key=str)
    assert got == want and {"ok", "typo", "restore"} <= {x[2] for x in want} and max(len(x[3]) for x in want) > 2
