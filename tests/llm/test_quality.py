import re

from tekstara.llm.quality import good_rows, quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    v = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(v) if v.count(x) > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one two three four", "a b c d e a b c d e", "a a a a a a a a a a", "x y z u v\nx y z u v\n\nx y z u v q", "häß|ich ##& <b> 😀 😀😀", "the of and " * 40,
    "a b c d e f a b c d e f g h i j k l m n o p", " ".join(f"w{i % 997}" for i in range(3000)),
]


def test_measures_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as n_words", "true as kept")
    got = {r["doc_id"]: r for r in quality(df).collect()}
    for i, t in enumerate(TEXTS):
        r, b = got[i], brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b, t
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r["base_failed"] and r["kept"])


def test_good_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat and it was a good day for all of us", 5), (2, "no", 6), (None, None, 7)], "doc_id long, text string, kept int")
    assert [tuple(r) for r in good_rows(df).collect()] == [tuple(df.first())]
    assert good_rows(df).columns == df.columns


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert quality(df).count() == 2 and quality(df.limit(0)).count() == 0
