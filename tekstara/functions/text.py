"""Column expressions over text: keys, tokens, shingles, edits, case, sentences, line and page measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

TOKEN = r"([\p{L}\p{M}]+)"

# Word classes and folding of the Lithuanian alphabet.
LT_WORD = "^[A-Za-zĄČĘĖĮŠŲŪŽąčęėįšųūž]+$"
ROMAN = "^[IVXLCDM]+$"
FOLD_FROM, FOLD_TO = "ąčęėįšųūž", "aceeisuuz"
ABBREVIATIONS = (
    "a akad adr angl aps apskr dab dir doc dr egz est etc gen gr gyv habil insp isp it jaun kan kpt kt latv lenk liet lot m min mjr mln mlrd "
    "mstl nr pan pav pgl pirm plg plk pers pr pranc proc prof psn pvz rus sav sek sen sk str šnek šv tarm tel tūkst ukr val vok vyr žr"
).split()


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: ColumnOrName) -> Column:
    """Runs of letters and marks, in order."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN), 1)


def fold_ascii(c: ColumnOrName) -> Column:
    """Lower case, then the nine Lithuanian letters without their marks."""
    return F.translate(F.lower(col(c)), FOLD_FROM, FOLD_TO)


def lower_key(c: ColumnOrName) -> Column:
    return F.lower(F.trim(col(c)))


def is_word(c: ColumnOrName) -> Column:
    return col(c).rlike(LT_WORD)


def has_letter(c: ColumnOrName) -> Column:
    return col(c).rlike(r"\p{L}")


def is_alpha(c: ColumnOrName) -> Column:
    return col(c).rlike(r"^\p{L}+$")


def is_clean_form(c: ColumnOrName, least: int = 2, most: int = 32) -> Column:
    """A form for a word list: length in range, letters with inner hyphens only."""
    return F.length(col(c)).between(least, most) & col(c).rlike(r"^\p{L}+(?:-\p{L}+)*$")


def word_class(c: ColumnOrName, followed_by: ColumnOrName) -> Column:
    """ABBREVIATION, NUMERAL, WORD or FOREIGN, in this order of tests; ``followed_by`` is the character after the word."""
    w = col(c)
    short = (F.length(w) == 1) | F.lower(w).isin(ABBREVIATIONS)
    return F.when((col(followed_by) == ".") & short, "ABBREVIATION").when(w.rlike(ROMAN), "NUMERAL").when(w.rlike(LT_WORD), "WORD").otherwise("FOREIGN")


def shingles(words: Column, n: int) -> Column:
    """All runs of n words joined by spaces; none if there are fewer words."""
    k = F.size(words) - n
    return F.when(k >= 0, F.transform(F.sequence(F.lit(0), k), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def deletes1(c: ColumnOrName) -> Column:
    """All strings with one character deleted, each once."""
    s = col(c)
    n = F.length(s)
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n))))).otherwise(F.array().cast("array<string>"))


def deletes2(c: ColumnOrName) -> Column:
    return F.array_distinct(F.flatten(F.transform(deletes1(c), lambda x: deletes1(x))))


def match_case(form: ColumnOrName, like: ColumnOrName) -> Column:
    """``form`` in the case of ``like``: all capitals (if longer than one), first capital, or as it is."""
    f, o = col(form), col(like)
    first = F.substring(o, 1, 1)
    capital = F.concat(F.upper(F.substring(f, 1, 1)), F.substring(f, F.lit(2), F.length(f)))
    return F.when((F.length(o) > 1) & (F.upper(o) == o), F.upper(f)).when((o != "") & (F.upper(first) == first), capital).otherwise(f)


def common_prefix(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Length of the longest common prefix."""
    x, y = F.split(col(a), ""), F.split(col(b), "")
    n = F.least(F.length(col(a)), F.length(col(b)))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.get(x, i - 1) == F.get(y, i - 1)))
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False)).cast("int")), 0)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def sentences(c: ColumnOrName) -> Column:
    """Sentences: cut after . ! ? … with closing quotes, where white space follows; trimmed, empty ones dropped."""
    marked = F.regexp_replace(col(c), r"([.!?…]+[\"”’»)]*)\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def list_heavy(text: ColumnOrName) -> Column:
    """At least 10 non-empty lines of which over 40 % are list items or have under three words."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: F.trim(x) != "")
    short = F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|\d+[.)])") | (F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) < 3))
    return (F.size(lines) >= 10) & (F.size(short) > 0.4 * F.size(lines))


def all_caps(line: ColumnOrName) -> Column:
    """A line with capitals and no small letters."""
    return col(line).rlike(r"\p{Lu}") & ~col(line).rlike(r"\p{Ll}")


def per_thousand(pattern: str, text: ColumnOrName, n: Column) -> Column:
    """Matches of a pattern for each 1,000 of ``n``; 0 if ``n`` is 0."""
    return F.coalesce(F.try_divide(F.regexp_count(col(text), F.lit(pattern)) * 1000.0, n), F.lit(0.0))


def safe_rate(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b)), F.lit(0.0))


def distinct_readings(info: ColumnOrName) -> Column:
    """Readings separated by "; ", each once, trimmed, in order of first mention."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(col(info), "; "), lambda s: F.trim(s)), lambda x: x != "")), "; ")


def strip_markup(text: ColumnOrName) -> Column:
    """Wiki and HTML markup away: comments, references, templates (eight nesting levels), tables, links, tags, quotes."""
    t = F.regexp_replace(col(text), r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>", "")
    for _ in range(8):
        t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"(?s)\{\|.*?\|\}", "")
    t = F.regexp_replace(t, r"\[\[(?:[^\]\[|]*\|)?([^\]\[|]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://\S+(?: ([^\]]*))?\]", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"'{2,}", "")


def lemma_script(form: ColumnOrName, lemma: ColumnOrName) -> Column:
    """The cheapest script from form to lemma: ``R|lowered|strip|suffix`` if it has a common prefix, else ``W|lemma``."""
    f, g = col(form), col(lemma)
    low = F.concat(F.lower(F.substring(f, 1, 1)), F.substring(f, F.lit(2), F.length(f)))

    def script(source: Column, flag: int) -> Column:
        k = common_prefix(source, g)
        tail = F.substring(g, k + 1, F.length(g))
        strip = F.length(source) - k
        text = F.concat(F.lit(f"R|{flag}|"), strip.cast("string"), F.lit("|"), tail)
        return F.when((k > 0) | (source == g), F.struct((strip + F.length(tail)).alias("cost"), F.lit(flag).alias("lc"), strip.alias("strip"), text.alias("script")))

    best = F.array_min(F.filter(F.array(script(f, 0), script(low, 1)), lambda s: s.isNotNull()))
    return F.coalesce(best["script"], F.concat(F.lit("W|"), g))


def apply_script(form: ColumnOrName, script: ColumnOrName) -> Column:
    f, s = col(form), col(script)
    flag, strip, tail = F.split_part(s, F.lit("|"), F.lit(2)), F.split_part(s, F.lit("|"), F.lit(3)).try_cast("int"), F.split_part(s, F.lit("|"), F.lit(4))
    source = F.when(flag == "1", F.concat(F.lower(F.substring(f, 1, 1)), F.substring(f, F.lit(2), F.length(f)))).otherwise(f)
    return F.when(s.startswith("W|"), F.substring(s, F.lit(3), F.length(s))).otherwise(F.concat(F.substring(source, F.lit(1), F.length(source) - strip), tail))
