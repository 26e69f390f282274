"""Lines, titles, paragraphs and sentences of running text: what to keep, how to split, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stress
from .text import all_caps, fold_ascii

WORD = r"\p{L}[\p{M}]*(?:\p{L}[\p{M}]*)*"
# Fragments and beginnings that titles, paragraphs and editorial lines are known by; headers of sections, folded.
BLOCKED_TITLES = ["(reikšmės)", "(reiksmes)", "sąrašas", "sarasas", "chronologija", "bibliografija", "diskografija", "filmografija"]
BLOCKED_PARAGRAPHS = ["taip pat skaitykite", "skaitykite daugiau", "daugiau apie", "lrt.lt primena"]
EDITORIAL = ["saltinis", "sis tekstas", "redagavo", "isleido", "leidykla", "turinys", "pastabos", "nuorodos", "puslapis", "viki"]
SECTION_STARTS = ["saltiniai ", "nuorodos ", "taip pat "]
SECTIONS = (
    "aprasymas apdovanojimai asmenybes biografija demografija ekonomika etimologija filmai geografija gyvenimas istorija isnasos isvaizda karjera klasifikacija klimatas kultura "
    "laimejimai literatura mityba mokslas nuorodos paplitimas pastabos pavadinimas politika saltiniai santykiai sportas sudetis transportas valdymas veikla"
).split() + ["budingi bruozai", "taip pat skaitykite", "ziureti taip pat"]
ABBREVIATIONS = "angl vok rus pranc lot gr lenk isp it pvz plg kt vad pav prof dr šv m mėn d".split()
MONTHS = "sausio vasario kovo balandžio gegužės birželio liepos rugpjūčio rugsėjo spalio lapkričio gruodžio".split()
SOURCES = ["Vilnius", "Kaunas", "Vaga", "Šviesa", "leidykla", "Lietuvos rašytojų sąjungos", "Pirmoji lietuviška knyga"]
NEXT_STARTS = "A-ZĄČĘĖĮŠŲŪŽ„“\"'"
_MARK, _HOLD = "\u0001", "⸾"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}[\p{L}\p{M}]*"))


def keep_title(title: Column) -> Column:
    """An article's title: no colon, none of the blocked fragments."""
    low = F.lower(F.trim(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"\s+", " ")))
    return ~any_of([low.contains(x) for x in BLOCKED_TITLES]) & ~title.contains(":")


def keep_paragraph(text: Column, least: int = 40) -> Column:
    return (F.length(text) >= least) & ~any_of([F.lower(text).startswith(x) for x in BLOCKED_PARAGRAPHS])


def keep_sentence(sentence: Column) -> Column:
    """At least three words and a stress mark."""
    return (n_words(sentence) >= 3) & (stress.marks(sentence) >= 1)


def section_header(line: Column) -> Column:
    """A known header, or a short line without an end mark."""
    bare = F.regexp_replace(F.trim(line), r"^:+|:+$", "")
    low = fold_ascii(bare)
    short = (n_words(bare) <= 6) & (F.length(bare) <= 80) & ~bare.rlike(r"[.!?…;]$")
    return low.isin(SECTIONS) | any_of([low.startswith(x) for x in SECTION_STARTS]) | short


def editorial(line: Column) -> Column:
    low = fold_ascii(line)
    year = low.rlike(r"(?:^|[^0-9a-z])(?:18|19|20)[0-9]{2}\s*m\.") & (n_words(line) < 8)
    return any_of([low.startswith(x) for x in EDITORIAL]) | low.rlike(r"(?:^|[^0-9a-z_])(?:isbn|pdf|djvu)(?:$|[^0-9a-z_])") | year


def page_number(line: Column) -> Column:
    return line.rlike(r"^\s*(?:-+\s*)?[0-9]{1,4}(?:\s*-+)?\s*$")


def coordinate(line: Column) -> Column:
    return F.lower(line).rlike(r"^\s*(?:koordinatės|coordinates)\s*:")


def list_item(line: Column) -> Column:
    return line.rlike(r"^\s*(?:[*#;:•·-]|[0-9]{1,4}\s*[\).:,-]|[IVXLCDMivxlcdm]{1,8}\s*[\).:-])")


def noise(line: Column) -> Column:
    """A line of a scanned page that is no text: numbers, nothing but signs, or, without stress marks, sources, dates, capitals, few letters."""
    one = F.trim(F.regexp_replace(line, r"\s+", " "))
    letters = F.regexp_count(one, F.lit(r"\p{L}"))
    told = any_of([one.rlike(rf"(?:^|[^\p{{L}}0-9_]){x}(?:$|[^\p{{L}}0-9_])") for x in SOURCES]) | one.rlike(r"\((?:g\.\s*)?\??[0-9]{4}(?:[–-][0-9]{4})?\)")
    plain = (stress.marks(one) == 0) & (told | all_caps(one) | (letters <= 64))
    return (one == "") | one.rlike(r"^[0-9]{1,3}$") | one.rlike(r"^[0-9]+[\s).,-]") | (letters == 0) | plain


def fragment(sentence: Column) -> Column:
    """A cut-off date."""
    months = "|".join(MONTHS)
    date = F.lower(sentence).rlike(rf"^\s*(?:[0-9]{{1,4}}\s*)?(?:m\.\s*)?(?:(?:{months})\s+)?(?:mėn\.|d\.)\s*$")
    return (n_words(sentence) <= 4) & (date | (sentence.rlike("[0-9]") & sentence.rlike(r"(?:^|[^\p{L}0-9_])(?:m|mėn|d)\.$")))


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, _MARK), lambda s: F.trim(s)), lambda s: s != "")


def prose_sentences(text: Column, protect: bool = True, least: int = 3) -> Column:
    """Cut after end marks and closing quotes where a capital or an opening quote follows; dots of abbreviations don't count if
    ``protect``. Sentences of under ``least`` words are dropped."""
    held = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}0-9_])({'|'.join(ABBREVIATIONS)})\.", f"$1$2{_HOLD}") if protect else text
    # the character after the gap is looked at, not taken
    marked = F.regexp_replace(held, rf"([.!?…]+[\"'”’)\]]*)\s+(?=[{NEXT_STARTS}])", f"$1{_MARK}")
    return F.filter(F.transform(_pieces(marked), lambda s: F.replace(s, F.lit(_HOLD), F.lit("."))), lambda s: n_words(s) >= least)


def paragraph_sentences(text: Column) -> Column:
    """Cut at line ends, then after end marks with closing signs before white space."""
    return _pieces(F.regexp_replace(F.regexp_replace(text, r"\n+", _MARK), r"([.!?]+[\"')\]]*)\s+", f"$1{_MARK}"))


def gap_sentences(text: Column) -> Column:
    """Runs of words with no end mark and no line end in a gap between them; each as its words joined by spaces."""
    words = r"\p{L}+(?:[-'’]\p{L}+)*"
    parts = F.regexp_extract_all(text, F.lit(rf"({words}|[.!?\n]+)"), 1)
    joined = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^[.!?\n]"), F.lit(_MARK)).otherwise(p)), " ")
    return _pieces(joined)


def hyphen_words(text: Column) -> Column:
    """Words with inner hyphens and apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+(?:[-']\p{L}+)*)"), 1)


def surface(text: Column) -> Column:
    """Words, numbers with a suffix after a hyphen, and single signs, as (text, is_word, suffix)."""
    tokens = F.regexp_extract_all(text, F.lit(r"([0-9]+-[\p{L}\p{M}]+|[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*|[0-9]+|[^\s\p{L}\p{M}0-9])"), 1)
    suffix = lambda t: F.when(t.rlike(r"^[0-9]+-\p{L}"), F.regexp_extract(t, r"-([\p{L}\p{M}]+)$", 1))
    return F.transform(tokens, lambda t: F.struct(t.alias("text"), t.rlike(r"\p{L}").alias("is_word"), suffix(t).alias("suffix")))


def preview_parts(text: Column) -> Column:
    """Words (letters with single inner marks) and what stands between them, which together are the text."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*|[^\p{L}\p{M}]+)"), 1)


def clean_line(line: Column) -> Column:
    """References and addresses out, white space single, brackets and bullets off the ends."""
    t = F.regexp_replace(F.replace(line, F.lit("​"), F.lit("")), r"\[\s*(?:[0-9]+|reikalingas šaltinis|šaltinis\?)\s*\]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"https?://\S+", " "), r"\(\s*\)", " ")
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^[\[\]{}|]+|[\[\]{}|]+$", ""), r"^[↑•]+[ ↑•]*", "")


def extract_sentences(text: Column) -> Column:
    """The sentences of an article's extract: lines cleaned, headers, lists, coordinates and capitals left out, then split."""
    rows = F.transform(F.split(text, "\n"), clean_line)
    kept = F.filter(rows, lambda x: (x != "") & ~coordinate(x) & ~list_item(x) & ~all_caps(x) & ~section_header(x) & (n_words(x) >= 3))
    return F.filter(F.flatten(F.transform(kept, lambda x: prose_sentences(x))), lambda s: ~fragment(s))


def edits1(c: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """All strings one deletion, transposition, substitution or insertion away, each once, without the word itself."""
    n = F.length(c)
    cut = lambda i: (F.left(c, i), F.substring(c, i + 1, n))  # noqa: E731  the first i characters and the rest
    at = F.sequence(F.lit(0), n)
    inner = F.filter(at, lambda i: i < n)
    letters = F.array(*[F.lit(x) for x in alphabet])
    rest = lambda i, k: F.substring(c, i + 1 + k, n)
    deletes = F.transform(inner, lambda i: F.concat(cut(i)[0], rest(i, 1)))
    swaps = F.transform(F.filter(at, lambda i: i < n - 1), lambda i: F.concat(cut(i)[0], F.substring(c, i + 2, F.lit(1)), F.substring(c, i + 1, F.lit(1)), rest(i, 2)))
    changed = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda x: F.concat(cut(i)[0], x, rest(i, 1)))))
    inserted = F.flatten(F.transform(at, lambda i: F.transform(letters, lambda x: F.concat(cut(i)[0], x, rest(i, 0)))))
    return F.filter(F.array_distinct(F.concat(deletes, swaps, changed, inserted)), lambda x: x != c)


def show_correction(status: Column, n_candidates: Column, unknown: Column) -> Column:
    """A restored word is always shown, a typo only where the word wasn't known."""
    return (n_candidates > 0) & F.coalesce((status == "restore") | ((status == "typo") & F.coalesce(unknown, F.lit(False))), F.lit(False))


def foreign_letters(c: Column) -> Column:
    """Whether a word holds a letter outside the Lithuanian alphabet."""
    return c.rlike(r"\p{L}") & F.regexp_replace(F.lower(stress.bare(c)), "[a-pr-vyząčęėįšųūž]", "").rlike(r"\p{L}")
