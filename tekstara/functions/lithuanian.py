"""Accent marks and letters: pure functions, and Arrow functions over distinct values."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stress marks (combining grave, acute and tilde) and the dot above, which belongs to ė.
GRAVE, ACUTE, TILDE, DOT = "̀", "́", "̃", "̇"
MARKS = {"grave": GRAVE, "acute": ACUTE, "tilde": TILDE}
NAMES = {v: k for k, v in MARKS.items()}
VOWELS = set("aąeęėiįyouųū")
SONORANTS = set("lmnr")
LONG = set("ąęėįųūy")


def nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


def clusters(text: str) -> list[str]:
    """Base characters with their combining marks, decomposed."""
    out: list[str] = []
    for ch in unicodedata.normalize("NFD", text):
        if out and unicodedata.combining(ch):
            out[-1] += ch
        else:
            out.append(ch)
    return out


def normalize(text: str | None) -> str | None:
    """Character references decoded, composed, and the dot that keeps i and j dotted under a stress mark dropped."""
    if text is None:
        return None
    kept = [c.replace(DOT, "") if c[0] in "ijIJ" else c for c in clusters(html.unescape(text))]
    return unicodedata.normalize("NFC", "".join(kept))


def strip_stress(text: str | None) -> str | None:
    """``normalize`` without the three stress marks; letters such as ė, š and ū stay."""
    if text is None:
        return None
    kept = ["".join(ch for ch in c if ch not in NAMES) for c in clusters(normalize(text) or "")]
    return unicodedata.normalize("NFC", "".join(kept))


def word_key(text: str | None) -> str | None:
    return None if text is None else (strip_stress(text) or "").lower()


def fold_key(text: str | None) -> str | None:
    return None if text is None else (strip_stress(text) or "").casefold()


def ascii_key(text: str | None) -> str | None:
    """No marks at all, case folded."""
    return None if text is None else "".join(c[0] for c in clusters(text)).casefold()


def stresses(text: str | None) -> list[tuple[int, str]]:
    """(base letter's index, mark's name) of every stress mark, in order."""
    if not text:
        return []
    return [(i, NAMES[ch]) for i, c in enumerate(clusters(normalize(text) or "")) for ch in c if ch in NAMES]


def first_stress(text: str | None) -> tuple[int, str] | None:
    return next(iter(stresses(text)), None)


def last_stress(text: str | None) -> tuple[int, str] | None:
    return next(reversed(stresses(text)), None)


def put_stress(word: str | None, index: int, mark: str) -> str | None:
    """``word`` with one mark on its index-th base letter, after a mark that belongs to the letter; out of range leaves it bare."""
    if word is None:
        return None
    parts = clusters(strip_stress(word) or "")
    if 0 <= index < len(parts):
        parts[index] += MARKS[mark]
    return unicodedata.normalize("NFC", "".join(parts))


def marks_of(letter: str, before: str, after: str) -> set[str]:
    """The marks a letter may bear between its neighbours ('' at an edge): sonorants a tilde after a vowel; long vowels no grave;
    i and u alone between consonants a grave, and u also a tilde unless a sonorant follows; other vowels any mark."""
    if letter in SONORANTS:
        return {"tilde"} if before in VOWELS else set()
    if letter not in VOWELS:
        return set()
    if letter in LONG:
        return {"acute", "tilde"}
    if letter in {"i", "u"} and before not in VOWELS and after not in VOWELS:
        return {"grave", "tilde"} if letter == "u" and after not in SONORANTS else {"grave"}
    return set(MARKS)


def may_carry(word: str, index: int, mark: str) -> bool:
    letters = [unicodedata.normalize("NFC", c) for c in clusters((strip_stress(word) or "").lower())]
    padded = ["", *letters, ""]
    return 0 <= index < len(letters) and mark in marks_of(letters[index], padded[index], padded[index + 2])


# Pairs of letters that are one diphthong, and letters that vowels begin as.
DIPHTHONGS = {"au", "ai", "ei", "ui", "uo", "ie"}
PLAIN_VOWELS = set("aeiouy")


def place_of(letters: list[str], i: int, mark: str) -> tuple[int, str]:
    """Where standard spelling puts a mark found on letter i: a tilde on the second part of a diphthong or on the sonorant of a
    mixed one; an acute on a sonorant after a vowel becomes a tilde. ``letters`` are lower-case, marked ones (ė, ū) as they are."""
    at, before = letters[i], letters[i - 1] if i else ""
    after, second = [*letters[i + 1 : i + 3], "", ""][:2]
    if mark == "tilde" and at + after in DIPHTHONGS and after + second[:1] not in DIPHTHONGS:
        return i + 1, mark
    mixed = at in set("aeiu") and after in SONORANTS and before + at not in DIPHTHONGS
    if mark == "tilde" and mixed and clusters(second)[:1] != [] and clusters(second)[0][0] not in PLAIN_VOWELS:
        return i + 1, mark
    if mark == "tilde" and mixed and not second:
        return i + 1, mark
    if mark == "acute" and at in SONORANTS and before in PLAIN_VOWELS:
        return i, "tilde"
    return i, mark


def standard_notation(text: str | None) -> str | None:
    """Marks moved to where ``place_of`` puts them, unless another mark is there."""
    if not text or not stresses(text):
        return text
    bare = clusters(strip_stress(text) or "")
    letters = [unicodedata.normalize("NFC", c).lower() for c in bare]
    found = stresses(text)
    held = {i for i, _ in found}
    out = list(bare)
    for i, mark in found:
        j, new = place_of(letters, i, mark)
        if j != i and j in held:
            j, new = i, mark
        out[j] += MARKS[new]
    return unicodedata.normalize("NFC", "".join(out))


def default_form(forms: list[str]) -> str | None:
    """Leftmost stress, then tilde before acute before grave, then text; a form without stress comes last."""
    rank = {"tilde": 0, "acute": 1, "grave": 2}

    def key(f: str) -> tuple[int, int, str]:
        s = first_stress(f)
        return (s[0], rank[s[1]], f) if s else (10**6, 9, f)

    return min(forms, key=key, default=None)


def decode_stress(position_logits: list[list[float]], none_logit: float, word: str) -> tuple[int, str] | None:
    """The likeliest (letter, mark) a letter may carry, or None where no stress is at least as likely. Marks: grave, acute, tilde."""
    best, top = None, none_logit
    for i, row in enumerate(position_logits):
        for mark, x in zip(("grave", "acute", "tilde"), row, strict=True):
            if x > top and may_carry(word, i, mark):
                best, top = (i, mark), x
    return best


def osa(a: str, b: str, cap: int = 3) -> int:
    """Optimal string alignment distance, at most ``cap``: edits and transpositions of neighbours, no substring edited twice."""
    if abs(len(a) - len(b)) >= cap:
        return cap
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) >= cap:
            return cap
        two, one = one, row
    return min(one[-1], cap)


def apocope(form: str) -> str | None:
    """The short form of an infinitive in -ti or an imperative in -ki; None for other forms."""
    parts = clusters(form)
    bare = (strip_stress(form) or "").lower()
    return unicodedata.normalize("NFC", "".join(parts[:-1])) if bare.endswith(("ti", "ki")) and len(parts) > 3 and len(parts[-1]) == 1 else None


def map_distinct(df: DataFrame, column: str, fn: Callable[[str | None], object], out: str, kind: str) -> DataFrame:
    """Add ``out`` = fn(column), worked out once for each distinct value in Arrow batches and joined back (nulls too).

    Vocabulary grows much slower than text, so Python sees each spelling once and not each occurrence.
    """

    @F.pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(None if x is None or x is pd.NA else x), na_action=None)

    values = df.select(F.col(column).alias("__v")).distinct().select("__v", apply("__v").alias(out))
    return df.join(values, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
