from pyspark.sql import functions as F

from tekstara.functions import text as tx
from tekstara.functions.tags import canonical_feats, parse_feats, parse_label, score, token_slots


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, tx.fold_ascii("a"), a="ĄČĘĖĮŠŲŪŽ") == "aceeisuuz"
    assert one(spark, tx.deletes1("a"), a="aab") == ["ab", "aa"]
    assert one(spark, tx.deletes1("a"), a="") == []
    assert one(spark, tx.common_prefix("a", "b"), a="namai", b="namas") == 4
    assert one(spark, tx.common_prefix("a", "b"), a="", b="x") == 0
    assert one(spark, tx.distinct_readings("a"), a="prl.; prl.; prl.; x") == "prl.; x"
    assert [one(spark, tx.match_case("a", "b"), a="vìlnius", b=b) for b in ("vilnius", "Vilnius", "VILNIUS")] == ["vìlnius", "Vìlnius", "VÌLNIUS"]
    assert one(spark, tx.sentences("a"), a="Pirmas sakinys. Antras sakinys!  Trečias") == ["Pirmas sakinys.", "Antras sakinys!", "Trečias"]
    assert one(spark, tx.strip_markup("a"), a="'''A''' [[b|c]] {{x{{y}}z}} <i>d</i><ref>e</ref>") == "A c  d"


def test_word_classes(spark):
    rows = spark.createDataFrame([("pers", "."), ("XIV", " "), ("žodis", " "), ("word", "."), ("слово", " "), ("a", ".")], "w string, after string")
    assert [r[0] for r in rows.select(tx.word_class("w", "after")).collect()] == ["ABBREVIATION", "NUMERAL", "WORD", "WORD", "FOREIGN", "ABBREVIATION"]


def test_lemma_scripts_round_trip(spark):
    pairs = spark.createDataFrame([("namai", "namas"), ("yra", "būti"), ("Vilniaus", "Vilnius"), ("Namai", "namas"), ("x", "x")], "f string, g string")
    got = pairs.withColumn("s", tx.lemma_script("f", "g")).withColumn("back", tx.apply_script("f", "s")).collect()
    assert all(r["back"] == r["g"] for r in got)
    assert got[1]["s"] == "W|būti" and got[0]["s"] == "R|0|1|s"


def test_tags(spark):
    feats = parse_feats(F.col("f"))
    assert one(spark, feats, f="Mood=Ind|Person=3|_|bad|Person=2") == {"Mood": "Ind", "Person": "2"}
    assert one(spark, feats, f="_") == {}
    assert one(spark, canonical_feats(F.col("f")), f="b=1|a=2") == "a=2|b=1"
    label = one(spark, parse_label(F.col("a")), a="vksm., būt. d. l., 3 asm.")
    assert (label["pos"], label["tense"], label["person"]) == ("VERB", "PastIter", "3")

    def scored(mi, upos, f):
        return one(spark, score(parse_label(F.lit(mi)), token_slots(F.lit(upos), parse_feats(F.lit(f)))))

    adj = "Gender=Masc|Number=Sing|Case=Nom"
    assert scored("bdv., vyr. g., vns. vard.", "ADJ", adj) == 10
    assert scored("bdv., mot. g., vns. gal.", "ADJ", adj) == 2
    assert scored("įv.", "DET", "_") == 4
    assert scored("jstk., pagr.", "INTJ", "_") == 4 and scored("vksm., dgs., es. l., 1 asm.", "INTJ", "_") == -3
