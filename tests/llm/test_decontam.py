import re
import string

import numpy as np

from tekstara.llm import decontam
from tekstara.llm.decontam import Index, hashes, leaks, without_leaks

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def made():
    rng = np.random.default_rng(8)
    v = [f"t{i}" for i in range(300)]
    items = [" ".join(rng.choice(v, int(n))) for n in rng.integers(8, 60, 60)]
    docs = []
    for k, t in enumerate(items):
        w = t.split()
        for lost in (0, 1, 2, 4):
            x = w.copy()
            for j in rng.integers(0, len(x), lost):
                x[j] = "other"
            docs.append(" ".join([*rng.choice(v, int(rng.integers(0, 400))), *x, *rng.choice(v, int(rng.integers(0, 400)))]))
    return items, docs


def test_all_leaks_are_found(spark):
    items, docs = made()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(df, bench).collect()}
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x))}
    assert got == want and len(want) > 100
    clean = without_leaks(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_wand_against_full_scoring():
    items, docs = made()
    ix = Index.build(list(enumerate(items)))
    for t in docs[::7]:
        h = np.unique(hashes(t))
        q = np.flatnonzero(np.isin(ix.terms, h))
        full = {}
        for held in ix.blocks:
            for term in q.tolist():
                for i, w in zip(*held.get(term, ((), ()))[:2], strict=True):
                    full[i] = full.get(i, 0.0) + w
        want = {i for i, s in full.items() if s >= ix.need[i]}
        assert {i for i, _ in ix.wand(q.tolist(), range(len(ix.blocks)))} == want


def test_question_and_answer(spark):
    q, a = "who wrote the long book about the sea ?", " it was one old captain of a ship"
    bench = spark.createDataFrame([(1, q + a)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + q + a + " then"), (2, q), (3, a), (4, q + " nobody knows who it may have been")], "doc_id long, text string")
    got = leaks(docs, bench).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["answer_overlap"] == 1.0


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short item"), (3, "another one here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short item"), (3, "short item"), (None, "x short item"), (5, "y " * 50_000 + "short item")], "doc_id long, text string")
    # an item of two words is one shingle, met where both words stand together
    assert leaks(docs, bench.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0) for r in leaks(docs, bench).collect()) == [0, 3, 3, 5]
    assert leaks(docs.limit(0), bench).count() == 0


def test_question_mark_inside_a_word(spark):
    items = ["which colour is it?Blue", "read the page at site.org/x/?q=1 and say what stands in the first line", "what is one and one? it is two"]
    df = spark.createDataFrame([(i, f"some words before {t} and some after") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(df, bench).collect()} == {(i, i) for i in range(len(items))}


def test_split_test_sets_give_the_same(spark, monkeypatch):
    items, docs = made()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("cast(item_id as smallint) as item_id", "text")
    rows = lambda: sorted(tuple(r) for r in leaks(df, bench).collect())
    one, clean = rows(), without_leaks(df, bench).count()
    monkeypatch.setattr(decontam, "INDEX_BYTES", 3000)
    assert rows() == one and without_leaks(df, bench).count() == clean


def test_block_bounds_lose_nothing(monkeypatch):
    items, docs = made()
    for block, light, step in ((1, 0.0, 7), (4, 0.2, 50), (16, 0.6, 1 << 30)):
        monkeypatch.setattr(decontam, "BLOCK", block)
        monkeypatch.setattr(decontam, "LIGHT", light)
        monkeypatch.setattr(decontam, "ENTRIES", step)
        ix = Index.build(list(enumerate(items)))
        sets = [np.flatnonzero(np.isin(ix.terms, hashes(t))) for t in docs[::5]]
        passage, term = np.repeat(np.arange(len(sets)), list(map(len, sets))), np.concatenate(sets)
        got = set(zip(*(x.tolist() for x in ix.bounded(passage, term)), strict=True))
        for p, own in enumerate(sets):
            for b, held in enumerate(ix.blocks):
                if sum(held[t][2] for t in own.tolist() if t in held) >= ix.least[b]:
                    assert (p, b) in got
