import unicodedata

from tekstara.functions import lithuanian as lt


def test_keys():
    assert lt.strip_stress("mė́nuo") == "mėnuo"
    assert lt.word_key("Alytà") == "alyta"
    assert lt.fold_key("STRAẼSSE") == "straesse"
    assert lt.ascii_key("ĄČĘĖĮŠŲŪŽ") == "aceeisuuz"
    assert lt.normalize("i̇̃lgas") == unicodedata.normalize("NFC", "ĩlgas")
    assert lt.normalize("a&amp;b") == "a&b"
    assert lt.strip_stress(None) is None


def test_stress():
    assert lt.put_stress("mėnuo", 1, "tilde") == unicodedata.normalize("NFC", "mė̃nuo")
    assert lt.first_stress("vìlnius") == (1, "grave")
    assert lt.stresses("abc") == []
    assert lt.last_stress("àbà") == (2, "grave")
    assert lt.put_stress("abc", 9, "grave") == "abc"
    assert lt.default_form(["vìlniùs", "vilnìus", "vil̃nius"]) == "vìlniùs"
    assert lt.default_form([]) is None


def test_where_stress_may_stand():
    assert lt.may_carry("abatija", 4, "grave") and not lt.may_carry("slėnio", 2, "grave")
    assert lt.may_carry("vyras", 1, "acute") and not lt.may_carry("vyras", 1, "grave")
    assert lt.may_carry("pirko", 2, "tilde") and not lt.may_carry("pirko", 2, "grave")
    assert lt.may_carry("pirko", 1, "grave") and not lt.may_carry("pirko", 1, "tilde")


def test_decode_prefers_no_stress():
    assert lt.decode_stress([[-10, -10, -10], [-10, -10, -10]], 1, "ma") is None
    assert lt.decode_stress([[0, 9, 0], [0, 0, 3]], 1, "ma") == (1, "tilde")


def test_distance():
    assert [lt.osa(a, b) for a, b in (("deina", "diena"), ("ca", "abc"), ("abc", "abc"), ("", "ab"), ("kitten", "sitting"))] == [1, 3, 0, 2, 3]


def test_apocope():
    assert lt.apocope("eiti") == "eit" and lt.apocope("namas") is None


def test_notation():
    nfc = lambda x: unicodedata.normalize("NFC", x)
    for a, b in (("ãusys", "aũsys"), ("ĩlgas", "il̃gas"), ("giŕdite", "gir̃dite"), ("pãieškai", "pãieškai"), ("kõl", "kõl"), ("mẽnas", "mẽnas"), ("", "")):
        assert lt.standard_notation(nfc(a)) == nfc(b), a
