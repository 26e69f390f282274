from pyspark.sql import functions as F

from tekstara.functions import lines as ln
from tekstara.functions import lithuanian as lt
from tekstara.functions import stress


def one(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_stress_columns_say_what_the_functions_say(spark):
    words = ["ãusys", "Vìlnius", "mė́nuo", "gir̃dite", "kõl", "namas", "žmogùs", "ū́kis", "pãieškai", "Ñ", "", "ą́", "a b́c", "ýla"]
    assert one(spark, stress.bare, words) == [lt.strip_stress(w) for w in words]
    assert one(spark, stress.marks, words) == [len(lt.stresses(w)) for w in words]
    assert one(spark, stress.place, words) == [(lt.first_stress(w) or (None,))[0] for w in words]
    assert one(spark, stress.mark, words) == [(lt.first_stress(w) or (0, None))[1] for w in words]
    assert one(spark, lambda c: F.concat(stress.head(c, F.lit(2)), F.lit("|"), stress.tail(c, F.lit(2))), ["mė́nuo", "gir̃dite", "a", ""]) == ["mė́|nuo", "gi|r̃dite", "a|", "|"]


def test_line_tests(spark):
    assert one(spark, ln.keep_title, ["Vilnius", "Vilnius (reikšmės)", "Upių sąrašas", "Vikipedija:Apie"]) == [True, False, False, False]
    assert one(spark, ln.section_header, ["Istorija:", "Šaltiniai ir literatūra", "Trumpa eilutė", "Ši eilutė baigiasi tašku."]) == [True, True, True, False]
    assert one(spark, ln.editorial, ["Redagavo Jonas Jonaitis", "ISBN 123", "Vilnius, 1912 m. spaudė", "Namas stovi prie upės"]) == [True, True, True, False]
    assert one(spark, ln.page_number, ["12", " - 12 -", "12345", "x 1"]) == [True, True, False, False]
    assert one(spark, ln.noise, ["", "17", "3) punktas", "***", "Žõdis", "trumpa", "VISOS DIDŽIOSIOS", "ilga " * 20]) == [True, True, True, True, False, True, True, False]
    assert one(spark, ln.fragment, ["1990 m. kovo 11 d.", "kovo mėn.", "Jis atėjo kovo 11 dieną namo."]) == [True, True, False]
    assert one(spark, ln.keep_sentence, ["Tai yrà namas", "Tai yra namas", "yrà"]) == [True, False, False]
    assert one(spark, ln.foreign_letters, ["namas", "quiz", "wow", "žąsis", "страна", "12"]) == [False, True, True, False, True, False]


def test_splitters(spark):
    text = "Jis gyveno su prof. Jonu ilgai. Ji dirbo labai gerai! „Taip, – tarė jis.” O paskui išėjo namo?"
    assert one(spark, ln.prose_sentences, [text])[0] == ["Jis gyveno su prof. Jonu ilgai.", "Ji dirbo labai gerai!", "„Taip, – tarė jis.”", "O paskui išėjo namo?"]
    assert one(spark, ln.paragraph_sentences, ["Vienas. du! trys\nketuri"])[0] == ["Vienas.", "du!", "trys", "keturi"]
    assert one(spark, ln.gap_sentences, ["Vienas, du. Trys-keturi\npenki"])[0] == ["Vienas du", "Trys-keturi", "penki"]
    many = " . ".join(f"a{'b' * (i % 7)}" for i in range(60))  # a piece's number is no set of characters to trim
    assert len(one(spark, ln.gap_sentences, [many.replace(" . ", ". . ")])[0]) == 60


def test_surface_tokens(spark):
    got = one(spark, ln.surface, ["1990-aisiais Jono, namas."])[0]
    assert [(x["text"], x["is_word"], x["suffix"]) for x in got] == [("1990-aisiais", True, "aisiais"), ("Jono", True, None), (",", False, None), ("namas", True, None), (".", False, None)]


def test_extract(spark):
    text = "Istorija\n* punktas vienas\nKoordinatės: 1 2\nVilnius yra sostinė [1] ir miestas. Jis didelis yra labai.\n↑ 2"
    assert one(spark, ln.extract_sentences, [text])[0] == ["Vilnius yra sostinė ir miestas.", "Jis didelis yra labai."]
    assert one(spark, ln.edits1, ["ab"])[0].count("b") == 1
