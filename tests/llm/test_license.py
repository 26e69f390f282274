import re
import string

from tekstara.llm.license import BASE, Scanner, evaluate, scan_licenses, to_postfix

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "   ", "All Rights   Reserved.", "cc-by cc by CC_BY", "all rights reserved all rights reserved", "GNU General Public License, version 3", "ccby cc by-sa",
    "ünïcode général public license general\npublic\tlicense", "x" * 50_000 + " cc by " + "y " * 20_000 + "all rights reserved", "all all rights reserved reserved", "cc by cc by",
]


def test_base_places_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as labels", "2 as n_words")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "cc by")], "doc_id long, text string")
    assert scan_licenses(df).count() == 3
    assert scan_licenses(df.limit(0)).count() == 0


def test_expressions():
    assert to_postfix("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)") == ["mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or"]
    assert evaluate(to_postfix("MIT OR GPL-3.0")) == (0, ["mit", "gpl-3.0"])
    assert evaluate(to_postfix("MIT AND GPL-3.0"))[0] == 2
    assert evaluate(to_postfix("GPL-2.0 WITH Classpath-exception-2.0")) == (1, ["gpl-2.0"])
    assert evaluate(to_postfix("MIT */ trailing"))[1] == ["mit"]
    for bad in ("", "OR MIT", "(MIT", "MIT AND", "AND"):
        assert to_postfix(bad) is None, bad


def test_tags():
    n, spans, tags = Scanner().scan("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nCode")
    assert tags == [("(MIT OR Apache-2.0)", 0, ["mit", "apache-2.0"])]
    assert any(k == 2 for k, _, _ in spans)


def test_two_tags_on_a_line():
    _, _, tags = Scanner().scan("// SPDX-License-Identifier: MIT // SPDX-License-Identifier: GPL-3.0\nSPDX License\n Identifier\tBSD-3-Clause é SPDX-License-Identifier:")
    assert [t[1:] for t in tags] == [(0, ["mit"]), (2, ["gpl-3.0"]), (0, ["bsd-3-clause"]), (None, [])]


def test_tag_far_into_a_long_text(spark):
    text = "Ünï wörds " * 200_000 + "SPDX-License-Identifier: Apache-2.0 OR MIT\n" + "tail " * 1000
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (r["expressions"], r["labels"], r["restriction"]) == ("Apache-2.0 OR MIT", "apache-2.0,mit", 0)
