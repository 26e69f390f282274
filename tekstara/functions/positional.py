"""Positional morphology codes and dotted tag strings as feature maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What letters mean, feature by feature.
VALUES = {
    "Gender": {"m": "Masc", "f": "Fem", "n": "Neut", "c": "Com"},
    "Number": {"s": "Sing", "p": "Plur", "d": "Dual"},
    "Case": {"n": "Nom", "g": "Gen", "d": "Dat", "a": "Acc", "i": "Ins", "l": "Loc", "v": "Voc", "x": "Ill"},
    "Degree": {"p": "Pos", "c": "Cmp", "s": "Sup", "d": "Dim"},
    "Definite": {"n": "Ind", "y": "Def"},
    "NumType": {"c": "Card", "o": "Ord", "m": "Mult", "l": "Sets"},
    "NumForm": {"d": "Digit", "r": "Roman", "l": "Word", "m": "Word"},
    "VerbForm": {"m": "Fin", "i": "Inf", "p": "Part", "a": "Ger", "h": "Conv", "b": "Vadv"},
    "Tense": {"p": "Pres", "a": "Past", "s": "Past", "q": "Past", "f": "Fut"},
    "Aspect": {"q": "Iter"},
    "Person": {"1": "1", "2": "2", "3": "3"},
    "Mood": {"i": "Ind", "m": "Imp", "s": "Sub", "o": "Opt"},
    "Voice": {"a": "Act", "p": "Pass", "n": "Nec"},
    "Polarity": {"y": "Neg", "n": "Pos"},
    "Reflex": {"y": "Yes"},
    "NameType": {"g": "Geo", "f": "Giv", "s": "Sur"},
    "Foreign": {"f": "Yes"},
    "Abbr": {"r": "Yes"},
    "Short": {"a": "Yes", "s": "Yes"},
}
# Which feature stands at which position (from 1) of a category's code.
LAYOUT = {
    "N": {3: "Gender", 4: "Number", 5: "Case", 6: "Reflex", 7: "NameType"},
    "A": {3: "Degree", 4: "Gender", 5: "Number", 6: "Case", 7: "Definite"},
    "P": {3: "Gender", 4: "Number", 5: "Case", 6: "Definite"},
    "M": {2: "NumType", 3: "Gender", 4: "Number", 5: "Case", 6: "NumForm", 7: "Definite"},
    "V": {3: "VerbForm", 4: "Tense", 5: "Person", 6: "Number", 7: "Gender", 8: "Voice", 9: "Polarity", 10: "Definite", 11: "Case", 12: "Reflex", 13: "Mood", 14: "Degree"},
    "R": {3: "Degree"},
    "S": {3: "Case"},
    "X": {2: "Foreign"},
    "Y": {2: "Short"},
}
# Pronoun types by lemma.
PRON_TYPES = {
    "Dem": "tas šis šitas anas toks šitoks šioks anoks tiek šitiek".split(),
    "Emp": ["pats"],
    "Ind": ["vienas", "kitas", "kitoks", "kažkas", "kažkuris", "kažkoks", "kažin kas", "bet kas", "bet kuris", "bet koks", "keletas", "keli"],
    "Int,Rel": "kas kuris koks katras kelintas kiek keliese".split(),
    "Neg": ["niekas", "joks", "nė vienas", "nė koks", "nė kuris"],
    "Prs": "aš tu jis ji mes jūs savęs savas tavas".split(),
    "Tot": "visas kiekvienas abu abudu abi abidvi abeji".split(),
}


def lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def pron_type(lemma: Column) -> Column:
    """A pronoun's type by its lemma; indefinite and negative ones also by how they begin."""
    low = F.trim(F.regexp_replace(F.lower(lemma), r"\s+", " "))
    named = lookup({x: kind for kind, xs in PRON_TYPES.items() for x in xs}, low)
    return F.coalesce(named, F.when(low.startswith("kaž") | low.startswith("bet "), "Ind").when(low.startswith("nie"), "Neg"))


def decode(code: Column, lemma: Column | None = None) -> Column:
    """A positional code as a map of features; ``-``, unknown letters and missing positions give none."""
    category = F.substring(code, 1, 1)
    found: dict[str, Column] = {}

    def put(feature: str, value: Column) -> None:
        found[feature] = F.coalesce(found[feature], value) if feature in found else value

    for letter, places in LAYOUT.items():
        for at, feature in places.items():
            name = "Abbr" if feature == "Short" else feature
            put(name, F.when(category == letter, lookup(VALUES[feature], F.substring(code, at, 1))))
    put("Aspect", F.when(category == "V", lookup(VALUES["Aspect"], F.substring(code, 4, 1))))
    put("Abbr", F.when(category == "X", lookup(VALUES["Abbr"], F.substring(code, 2, 1))))
    if lemma is not None:
        put("PronType", F.when(category == "P", pron_type(lemma)))
    rows = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in sorted(found.items())]), lambda x: x["v"].isNotNull())
    return F.map_from_entries(rows)


def repaired(feats: Column, extra: Column) -> Column:
    """``feats`` with keys of ``extra`` that it lacks."""
    return F.map_concat(feats, F.map_filter(extra, lambda k, _: ~F.map_contains_key(feats, k)))


def kept(feats: Column, keys: list[str]) -> Column:
    return F.map_filter(feats, lambda k, _: k.isin(keys))


def lacks(upos: Column, feats: Column) -> Column:
    """Whether a token is a gap to fill: a verb without Number, a pronoun without Person or Reflex."""
    no = lambda k: ~F.map_contains_key(feats, F.lit(k))
    return (upos.isin("VERB", "AUX") & no("Number")) | ((upos == "PRON") & (no("Person") | no("Reflex")))
