"""Morphology: FEATS maps, eight tag slots, label abbreviations, scores of readings against context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = ["pos", "gender", "number", "case", "tense", "person", "voice", "degree"]
SLOT_TYPE = "struct<" + ",".join(f"{s}:string" for s in SLOTS) + ">"

# Label abbreviations and the slots they fill.
ABBREVIATIONS = {
    "dkt.": ("pos", "NOUN"), "bdv.": ("pos", "ADJ"), "vksm.": ("pos", "VERB"), "dlv.": ("pos", "PART_VERB"), "psdlv.": ("pos", "PART_VERB"),
    "padlv.": ("pos", "PART_VERB"), "prv.": ("pos", "ADV"), "įv.": ("pos", "PRON"), "sktv.": ("pos", "NUM"), "jng.": ("pos", "CCONJ"),
    "prl.": ("pos", "ADP"), "dll.": ("pos", "PART"), "jstk.": ("pos", "INTJ"), "jst.": ("pos", "INTJ"),
    "vyr. g.": ("gender", "Masc"), "mot. g.": ("gender", "Fem"), "bev. g.": ("gender", "Neut"), "vns.": ("number", "Sing"), "dgs.": ("number", "Plur"),
    "vard.": ("case", "Nom"), "kilm.": ("case", "Gen"), "naud.": ("case", "Dat"), "gal.": ("case", "Acc"), "įnag.": ("case", "Ins"), "viet.": ("case", "Loc"), "šauksm.": ("case", "Voc"),
    "es. l.": ("tense", "Pres"), "būt. l.": ("tense", "Past"), "būt. k. l.": ("tense", "Past"), "būt. d. l.": ("tense", "PastIter"), "būs. l.": ("tense", "Fut"),
    "1 asm.": ("person", "1"), "2 asm.": ("person", "2"), "3 asm.": ("person", "3"), "veik. r.": ("voice", "Act"), "neveik. r.": ("voice", "Pass"),
    "aukšt. l.": ("degree", "Cmp"), "aukšč. l.": ("degree", "Sup"),
}


def parse_feats(raw: Column) -> Column:
    """``Key=Value|...`` as a map; ``_``, empty parts and parts without a key are left out; the last of equal keys counts."""
    parts = F.filter(F.split(raw, r"\|"), lambda x: F.instr(x, "=") > 1)
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    # an earlier value of the same key is taken out before the later one goes in
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def canonical_feats(raw: Column) -> Column:
    """Features sorted by text; ``_`` if there are none."""
    parts = F.array_sort(F.filter(F.split(raw, r"\|"), lambda x: F.instr(x, "=") > 1))
    return F.when(F.size(parts) > 0, F.array_join(parts, "|")).otherwise(F.lit("_"))


def token_slots(upos: Column, feats: Column) -> Column:
    """Slots of a tagged token; determiners count as pronouns, proper nouns as nouns, positive degree as none."""
    at = lambda k: F.try_element_at(feats, F.lit(k))
    pos = (
        F.when(upos.isin("VERB", "AUX"), F.when(at("VerbForm") == "Part", "PART_VERB").otherwise("VERB"))
        .when(upos.isin("NOUN", "PROPN"), "NOUN").when(upos == "DET", "PRON").when(upos.isin("CCONJ", "SCONJ"), "CCONJ").otherwise(upos)
    )
    other = [at(s.capitalize()).alias(s) for s in SLOTS[1:7]]
    return F.struct(pos.alias("pos"), *other, F.when(at("Degree") != "Pos", at("Degree")).alias("degree"))


def parse_label(label: Column) -> Column:
    """Slots of a label such as ``dkt., vyr. g., vns. vard.``. Longer abbreviations match first and a space takes their place; a
    slot keeps its first value in that order."""
    rest = F.trim(label)
    found: dict[str, Column] = {}
    for abbreviation in sorted(ABBREVIATIONS, key=lambda x: -len(x)):
        slot, value = ABBREVIATIONS[abbreviation]
        hit = F.when(F.contains(rest, F.lit(abbreviation)), F.lit(value))
        found[slot] = F.coalesce(found[slot], hit) if slot in found else hit
        rest = F.replace(rest, F.lit(abbreviation), F.lit(" "))
    return F.struct(*[found[s].alias(s) for s in SLOTS])


def score(reading: Column, context: Column) -> Column:
    """Part of speech: 4 if equal, -3 if not; each other slot 2 or -2; 0 where either has none."""

    def one(slot: str, plus: int, minus: int) -> Column:
        a, b = reading[slot], context[slot]
        return F.when(a.isNull() | b.isNull(), 0).when(a == b, plus).otherwise(minus)

    return reduce(lambda x, y: x + y, [one(s, 2, -2) for s in SLOTS[1:]], one("pos", 4, -3))


def spurious(reading: Column, context: Column) -> Column:
    """How many slots the reading fills and the context doesn't."""
    return reduce(lambda x, y: x + y, [(reading[s].isNotNull() & context[s].isNull()).cast("int") for s in SLOTS])


def filled(slots: Column) -> Column:
    return reduce(lambda x, y: x + y, [slots[s].isNotNull().cast("int") for s in SLOTS])
