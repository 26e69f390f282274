import numpy as np

from tekstara.llm.langid import fit, fitted, predict, temperature

WORDS = {"en": "the of and to in is that was for with this", "de": "der die und den von zu das mit nicht ein für", "fr": "le la les des une et dans pour qui été ça", "es": "el los las que por una con para niño está y"}


def corpus(n=60):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[c].split(), 40)), c) for i, c in enumerate(sorted(WORDS) * n)]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? …", "de"), (1003, "Ж" * 200_000, None), (1004, "the of", None), (1004, "the of", None), (None, "und der die", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred", "2 as score")
    got = predict(df, fitted(df)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    right = [by[i]["lang_pred"] == c for i, _, c in rows[:240] if i % 7 == 0]
    assert np.mean(right) > 0.97
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] in WORDS
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_reads_only_the_text(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = fit(df.select("text", "lang"))
    a = {r["doc_id"]: r["lang_pred"] for r in predict(df, model).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in predict(df.selectExpr("doc_id", "text", "'xx' as lang"), model).collect()}
    assert a == b


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in predict(df, fitted(df)).collect()] == ["und"]
    assert predict(df.limit(0), fitted(df)).count() == 0


def test_temperature_cools_overconfident_scores():
    rng = np.random.default_rng(2)
    ys = rng.integers(0, 3, 500)
    scores = rng.normal(size=(500, 3)) * 8
    scores[np.arange(500), ys] += 6
    assert temperature(scores, ys) > 1


def test_language_of_copies_is_learned(spark):
    rows = [(i, t, c) for i, t, c in corpus(50) if c == "en"] + [(1000 + i, "zyx wvu tsr qpo zyx nml", "xx") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = fitted(df)
    assert model.langs == ["en", "xx"]
    got = {(r["doc_id"] >= 1000, r["lang_pred"]) for r in predict(df, model).collect()}
    assert got == {(False, "en"), (True, "xx")}


def test_predictions_against_brute_force(spark):
    """The batch prediction equals one gram after another by hand, for the learned table."""
    import unicodedata

    from tekstara.llm.langid import BITS

    rows = [*corpus(20), (2000, "É" + "a b" * 50, None), (2001, "x", None), (2002, "ß 9 Ü", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fitted(df)
    got = {r["doc_id"]: r for r in predict(df, model).collect()}
    for i, t, _ in rows:
        low = [ord(ch.lower()) if unicodedata.category(ch)[0] == "L" else 0 for ch in t] + [0]
        z, n = model.bias.astype(float).copy(), 0
        for j, c in enumerate(low):
            b1, b2 = (low[j - 1] if j else 0), (low[j - 2] if j > 1 else 0)
            for h in (c, c * 40503 + b1 * 2246822519 + 17, c * 40503 + b1 * 2246822519 + b2 * 3266489917 + 91):
                n += 1
                z += model.table[(h * 2654435761 % (1 << 32)) >> (32 - BITS)] / (3 * len(low))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert n == 3 * len(low) and abs(p.max() - got[i]["score"]) < 1e-4 and (p.max() - np.sort(p)[-2] < 1e-4 or model.langs[p.argmax()] == got[i]["lang_pred"])
