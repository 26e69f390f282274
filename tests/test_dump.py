import unicodedata

from tekstara.operators import dump


def entry(word, pos, forms, heads=(), lang="lt"):
    return (word, pos, lang, [tuple(f) for f in forms], [tuple(h) for h in heads], [])


def test_tables(spark):
    rows = [
        entry("namas", "noun", [("nãmas", ["canonical"], None), ("namaĩ", ["nominative", "plural"], "declension"), ("namè", ["locative", "singular", "stress-pattern-4"], "declension"), ("lt-noun-m-as", ["inflection-template"], "declension"), ("-", ["dative"], "declension"), ("namo", ["genitive"], "declension")], [("lt-noun", {"g": "m", "2": "4"}, "")]),
        entry("eiti", "verb", [("eĩti", ["canonical"], None), ("eĩna", ["present", "third-person"], None), ("ė̃jo", ["past", "third-person"], None)]),
        entry("home", "noun", [], lang="en"),
        entry("tuščias", "adj", []),
    ]
    df = spark.createDataFrame(rows, dump.ENTRY_SCHEMA)
    e = dump.entries(df.union(df)).cache()
    assert e.count() == 3
    n = {r["lemma"]: r for r in dump.nominals(e).collect()}
    nfc = lambda x: unicodedata.normalize("NFC", x)
    assert n["namas"]["accented_lemma"] == nfc("nãmas") and n["namas"]["gender"] == "masculine" and n["namas"]["plural_accented"] == nfc("namaĩ") and n["namas"]["template"] == "lt-noun-m-as"
    assert n["tuščias"]["accented_lemma"] == "tuščias" and n["tuščias"]["gender"] is None
    assert [r["stress_class"] for r in dump.stress_classes(e).collect()] == ["4"]
    f = {(r["stripped"], tuple(r["tags"])) for r in dump.form_rows(e).where("pos = 'noun'").collect()}
    assert f == {("namas", ("canonical",)), ("namai", ("nominative", "plural")), ("name", ("locative", "singular"))}
    v = dump.verbs(e).collect()
    assert [(r["lemma"], r["present_3"]) for r in v] == [("eiti", nfc("eĩna"))]
