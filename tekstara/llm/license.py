"""Licence scan: Aho-Corasick over word streams, shunting-yard over SPDX expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_arrow

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of the method, with its labels.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0", "general public license version 3": "gpl-3.0",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0 1 0": "cc0",
    "public domain": "public-domain", "unlicense": "unlicense",
}
#: How restrictive a licence family is: 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 reserved or unknown.
FAMILIES = [
    (1, "lgpl mpl epl cddl cc-by-sa"),
    (2, "gpl agpl eupl cc-by-nc cc-by-nd sspl"),
    (0, "mit apache bsd isc zlib bsl boost unlicense cc0 cc-by public-domain 0bsd python psf"),
]
TAG = "spdx license identifier"
WORDS = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
#: What stands between a tag and its expression, and where the expression ends at the latest.
LEAD, LINE = re.compile(r"[ \t]*:?[ \t]*"), re.compile(r"[^\r\n]*")
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
RANK = {"or": 1, "and": 2, "with": 3}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def restriction(name: str) -> int:
    name = name.lower()
    for level, families in FAMILIES:
        if any(name == f or name.startswith((f + "-", f + "+")) for f in families.split()):
            return level
    return 3


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: the longest well-formed licence expression at the start of ``text`` as postfix, or None.

    ``with`` binds tighter than ``and``, which binds tighter than ``or``; all are left-associative and case-blind. Reading
    stops at the first token that can't continue the expression, so trailing comment marks do no harm.
    """
    out: list[str] = []
    ops: list[str] = []
    operand, at = True, 0
    while m := TOKEN.match(text, at):
        t, low = m[1], m[1].lower()
        if operand:
            if t == "(":
                ops.append(t)
            elif t == ")" or low in RANK:
                return None
            else:
                out.append(low.rstrip(".:-"))
                operand = False
        elif low in RANK:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        else:
            break
        at = m.end()
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> tuple[int, list[str]]:
    """(restriction level, licence names) of a postfix expression: ``and`` takes the stricter side, ``or`` the freer, ``with`` frees by one level."""
    stack: list[tuple[int, list[str]]] = []
    for t in postfix:
        if t not in RANK:
            stack.append((restriction(t), [t]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((max(0, a - 1), left))  # an exception's name is no licence
        else:
            stack.append(((max if t == "and" else min)(a, b), left + right))
    return stack[0]


class Scanner:
    """One automaton over all phrases; ``scan`` gives the spans of a text."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> None:
        self.machine = ahocorasick.Automaton()
        for kind, phrases in ((0, base), (1, notices), (2, {TAG: ""})):
            for p, label in phrases.items():
                key = f" {p} "
                self.machine.add_word(key, (*self.machine.get(key, ()), (kind, label, len(key))))
        self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[str, int | None, list[str]]]]:
        """(number of words, [(kind, first word, label)], [(expression, restriction, names)]); kind 0 base, 1 notice, 2 tag."""
        ws = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        line = (b" " + b" ".join(ws) + b" ").decode("latin-1")
        spans, at, seen = [], 0, -1
        hits = sorted((end - size + 1, kind, label) for end, found in self.machine.iter(line) for kind, label, size in found)
        for start, kind, label in hits:
            seen += line.count(" ", at, start + 1)
            at = start + 1
            spans.append((kind, seen, label))
        return len(ws), spans, self.expressions(text or "", [w for k, w, _ in spans if k == 2])

    def expressions(self, text: str, places: list[int]) -> list[tuple[str, int | None, list[str]]]:
        """(expression, restriction, names) of the tags whose first words the automaton found at ``places``.

        An expression runs from the tag to the end of its line or to the next tag, if that is on the same line.
        """
        if not places:
            return []
        starts, ends, wanted = {}, {}, set(places) | {w + TAG.count(" ") for w in places}
        for i, m in enumerate(WORDS.finditer(text)):
            if i in wanted:
                starts[i], ends[i] = m.start(), m.end()
        tags = []
        for w, after in zip(places, [*places[1:], None], strict=True):
            at = LEAD.match(text, ends[w + TAG.count(" ")]).end()
            end = LINE.match(text, at).end()
            said = text[at : end if after is None else max(at, min(end, starts[after]))].strip()
            post = to_postfix(said)
            tags.append((said, *(evaluate(post) if post else (None, []))))
        return tags


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, restriction int"


def scan_licenses(df: DataFrame, text: str = "text", id_col: str = "doc_id", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of ``df``: counts, first and last place, labels and evaluated expressions of its licence evidence.

    Places are where a base phrase's words stand consecutively; overlapping places all count. ``score`` is
    1 - (1 - weight) over distinct labels, a weight being 0.9 for a tag's licence, 0.7 for a base phrase's label and 0.5 for a
    notice's. ``restriction`` is the strictest evidence's level from 0 to 3. A null or empty text gives zero words, null
    places, empty labels and score 0; repeated rows give repeated results; other columns of ``df`` are ignored.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for b in batches:
            rows = []
            for t in b.column(1):
                n, spans, tags = scanner.scan(t.as_py())
                at = [w for k, w, _ in spans if k == 0]
                ours = {x for k, _, x in spans if k == 0}
                more = {x for k, _, x in spans if k == 1}
                named = {x for _, _, names in tags for x in names}
                miss = 1.0
                for x in sorted(ours | more | named):
                    miss *= 0.1 if x in named else 0.3 if x in ours else 0.5
                levels = [v for _, v, _ in tags if v is not None] + [restriction(x) for x in ours | more]
                rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(ours)), ",".join(sorted(ours | more | named)), 1 - miss, " | ".join(e for e, _, _ in tags), max(levels, default=None)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", *(x.split()[0] for x in SCHEMA.split(", "))])

    out = map_arrow(df.select(df[id_col].alias("id"), df[text].alias("text")), run, f"id {id_type}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))
