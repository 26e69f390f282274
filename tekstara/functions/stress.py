"""Stress marks as column expressions over composed (NFC) text, without Python: bare text, place, mark, count, head and tail."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = {"grave": "̀", "acute": "́", "tilde": "̃"}
_BASES = "aeiouynmlrAEIOUYNMLR"
#: Letters that one code point holds together with a mark, and what they are made of.
COMPOSED = {c: (b, name) for b in _BASES for name, m in MARKS.items() if len(c := unicodedata.normalize("NFC", b + m)) == 1}
_FROM, _TO = "".join(COMPOSED), "".join(b for b, _ in COMPOSED.values())
_SINGLE = "".join(MARKS.values())
_STRESSED = f"(?:[{_FROM}]|[^{_SINGLE}][{_SINGLE}])"


def bare(c: Column) -> Column:
    """Text without the three marks; other marks stay."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), f"[{_SINGLE}]", "")


def marks(c: Column) -> Column:
    """How many stress marks there are."""
    return F.regexp_count(c, F.lit(f"[{_FROM}{_SINGLE}]"))


def place(c: Column) -> Column:
    """Index of the first stressed letter among the base letters, from 0; null without a mark."""
    before = F.regexp_extract(c, f"^(.*?){_STRESSED}", 1)
    return F.when(marks(c) > 0, F.length(bare(before)))


def mark(c: Column) -> Column:
    """Name of the first mark; null without one."""
    at = F.regexp_extract(c, f"({_STRESSED})", 1)
    last = F.substring(at, -1, 1)
    named = F.create_map(*[F.lit(x) for k, (_, n) in COMPOSED.items() for x in (k, n)], *[F.lit(x) for n, k in MARKS.items() for x in (k, n)])
    return F.when(marks(c) > 0, F.try_element_at(named, last))


def marked(letter: Column, name: Column) -> Column:
    """A letter with the named mark, in one code point where there is one."""
    whole = F.create_map(*[F.lit(x) for c, (b, n) in COMPOSED.items() for x in (b + n, c)])
    signs = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    return F.coalesce(F.try_element_at(whole, F.concat(letter, name)), F.concat(letter, F.try_element_at(signs, name)))


def letters(c: Column) -> Column:
    """Base letters, each with the marks that follow it."""
    return F.regexp_extract_all(c, F.lit(f"([^{_SINGLE}][{_SINGLE}]*)"), 1)


def head(c: Column, n: Column) -> Column:
    """The first ``n`` base letters with their marks."""
    return F.array_join(F.slice(letters(c), F.lit(1), F.greatest(n, F.lit(0))), "")


def tail(c: Column, n: Column) -> Column:
    """What follows the first ``n`` base letters."""
    x = letters(c)
    return F.array_join(F.slice(x, F.greatest(n, F.lit(0)) + 1, F.greatest(F.size(x) - n, F.lit(0))), "")
