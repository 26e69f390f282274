from pyspark.sql import functions as F

from tekstara.functions.positional import decode, kept, lacks, pron_type, repaired


def test_codes(spark):
    want = {
        "Agpmsgn": {"Degree": "Pos", "Gender": "Masc", "Number": "Sing", "Case": "Gen", "Definite": "Ind"},
        "Pgmsin": {"Gender": "Masc", "Number": "Sing", "Case": "Ins", "Definite": "Ind", "PronType": "Dem"},
        "Vgmp3---y--ni-": {"VerbForm": "Fin", "Tense": "Pres", "Person": "3", "Polarity": "Neg", "Mood": "Ind"},
        "Vgpq--m": {"VerbForm": "Part", "Tense": "Past", "Aspect": "Iter", "Gender": "Masc"},
        "Ya": {"Abbr": "Yes"}, "Xf": {"Foreign": "Yes"}, "Rgc": {"Degree": "Cmp"}, "": {}, "Q": {},
    }
    df = spark.createDataFrame([(k, "šis") for k in want], "code string, lemma string")
    assert {r["code"]: r["f"] for r in df.select("code", decode(F.col("code"), F.col("lemma")).alias("f")).collect()} == want


def test_pronouns(spark):
    df = spark.createDataFrame([("tas",), ("Nė  vienas",), ("bet kada",), ("niekur",), ("namas",), ("",)], "l string")
    assert [r[0] for r in df.select(pron_type(F.col("l"))).collect()] == ["Dem", "Neg", "Ind", "Neg", None, None]


def test_repair(spark):
    m = lambda x: F.expr(x)
    row = spark.range(1).select(repaired(m("map('a','1')"), m("map('a','2','b','3')")).alias("r"), kept(m("map('a','1','c','2')"), ["c"]).alias("k"), lacks(F.lit("VERB"), m("map('Person','3')")).alias("g")).first()
    assert row["r"] == {"a": "1", "b": "3"} and row["k"] == {"c": "2"} and row["g"]
