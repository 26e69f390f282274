import math
import re
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tekstara.llm.common import crc_mod
from tekstara.llm.ngram_lm import CODE, MU, SHARE, EliasFano, Level, fit, score, squeeze, unsqueeze

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_elias_fano_against_search():
    rng = np.random.default_rng(0)
    dense = np.uint64(7 << 40) + np.arange(5000, dtype=np.uint64)
    for v in (np.zeros(0, np.uint64), np.array([9], np.uint64), np.arange(1000, dtype=np.uint64), np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64)), np.unique(np.concatenate([dense, rng.integers(0, 1 << 50, 2000).astype(np.uint64)]))):
        seq, end = EliasFano.view(np.frombuffer(EliasFano.build(v).pack() + b"tail", np.uint8))
        q = np.concatenate([v, v + np.uint64(1), rng.integers(0, 1 << 62, 500).astype(np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        i, same = seq.seek(q)
        assert (i == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all() and (seq.values() == v).all()
        assert (unsqueeze(squeeze(v)) == v).all()


def model_of(rows):
    c, pairs, ctx, docs = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            docs += 1
            w = tokens(t)
            c.update(w)
            for a, b in zip(["<s>", *w], w, strict=False):
                pairs[a, b] += 1
                ctx[a] += 1
    return c, pairs, ctx


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{x}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 90)) for i in range(120)] + [(500, None), (501, ""), (502, "neverseen w1 neverseen"), (503, "w1 " * 30_000), (503, "w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as n_tokens").repartition(3)
    rest = crc_mod("doc_id", 10)
    model = fit(df.where(rest != 0).select("text"), parts=3)
    got = score(df, model, extra={"held_out": rest == 0}).collect()
    assert len(got) == len(rows)
    c, pairs, ctx = model_of(rows)
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        w = tokens(t)
        p1 = [(c[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        full = 0.0
        for a, b, p in zip(["<s>", *w], w, p1, strict=False):
            q = (pairs[a, b] + MU * p) / (ctx[a] + MU)
            full += -CODE * round(-math.log10(q) / CODE) if pairs[a, b] else math.log10(q)
        want.setdefault((i, len(w)), (held(i), sum(x in c for x in w), n, sum(map(math.log10, p1)), full))
    for r in got:
        h, known, total, base, full = want[r["doc_id"], r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert abs(r["score"] - full) <= 1e-6 * abs(full) + CODE * 1.01 * 3


def test_pointers_give_successors(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "a c", "a b", "b a"] * 5)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string").select("text"), parts=2).open()
    assert model.size == 4
    total = sum(len(model.successors(x)) for x in range(model.size + 1))
    # begin: a, b; a: b, c, end; b: a, end; c: end
    assert total == 8


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score(df, fit(df.where(F.lit(False)).select("text"))).collect()
    assert [r["n_known"] for r in got] == [0, 0] and all(r["train_tokens"] == 0 for r in got)
    assert all(math.isfinite(r["score"]) for r in got)


def test_order_three_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 40)) for i in range(200)] + [(500, None), (501, ""), (502, "neverseen w1 w2 neverseen"), (503, "w1 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rest = crc_mod("doc_id", 10)
    model = fit(df.where(rest != 0).select("text"), parts=3, order=3)
    got = {r["doc_id"]: r["score"] for r in score(df, model).collect()}
    c, pairs, ctx = model_of(rows)
    triples = Counter()
    for i, t in rows:
        if not held(i):
            w = ["<s>", *tokens(t)]
            triples.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c.values()), len(c)
    code = lambda q: -CODE * round(-math.log10(q) / CODE)
    for i, t in rows:
        w, want = ["<s>", *tokens(t)], 0.0
        for j in range(1, len(w)):
            a, b = w[j - 1], w[j]
            two = (pairs[a, b] + MU * (c[b] + 0.1) / (n + 0.1 * (v + 1))) / (ctx[a] + MU)
            part = code(two) if pairs[a, b] else math.log10(two)
            seen = pairs[w[j - 2], a] if j > 1 else 0
            if seen:
                k = triples[w[j - 2], a, b]
                share = SHARE * round(math.log10((seen + MU) / MU) / SHARE)
                part = code((k + MU * 10**part) / (MU * 10**share)) if k else part - share
            want += part
        assert abs(got[i] - want) <= 1e-6 * abs(want) + CODE * 1.01 * 3


def test_order_three_tells_texts_with_equal_pairs_apart(spark):
    texts = ["a b c b d b e", "a b d b c b e"]  # the same pairs in another order
    train = spark.createDataFrame([(i, texts[0]) for i in range(60)], "doc_id long, text string").select("text")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    two, three = ({r["doc_id"]: r["score"] for r in score(df, fit(train, parts=2, order=k)).collect()} for k in (2, 3))
    assert abs(two[0] - two[1]) < 1e-9 and three[0] > three[1] + 0.5


def test_elements_by_place():
    rng = np.random.default_rng(3)
    for v in (np.array([9], np.uint64), np.arange(1000, dtype=np.uint64), np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))):
        seq, _ = EliasFano.view(np.frombuffer(EliasFano.build(v).pack(), np.uint8))
        i = rng.permutation(len(v))
        assert (seq.at(i) == v[i]).all()


def test_search_in_ranges():
    rng = np.random.default_rng(4)
    size, ctx = 50, np.sort(rng.integers(0, 300, 4000))
    keys = np.unique(ctx.astype(np.uint64) * np.uint64(size) + rng.integers(0, size, 4000).astype(np.uint64))
    part = Level(np.frombuffer(Level.pack(keys, size, np.arange(len(keys), dtype=np.uint64).astype(np.uint8), np.arange(len(keys)).astype(np.uint16)), np.uint8), 0, int(keys[0]) // size, size, True)
    low, top = part.low, part.low + part.pointers.n - 2
    ask = np.array([(c, w) for c in range(low, top + 1) for w in range(size)])
    a, b = part.ranges(np.arange(low, top + 1))
    of = (keys // np.uint64(size)).astype(np.int64)
    assert (a == np.searchsorted(of, np.arange(low, top + 1))).all() and (b == np.searchsorted(of, np.arange(low, top + 1), "right")).all()
    at, same = part.find(ask[:, 0], ask[:, 1])
    want = (ask[:, 0] * size + ask[:, 1]).astype(np.uint64)
    assert (same == np.isin(want, keys)).all()
    # a successor never lies outside the context's own range
    assert (at == np.clip(np.searchsorted(keys, want), a[ask[:, 0] - low], b[ask[:, 0] - low])).all()
    assert (part.codes == (np.arange(len(keys)) % 256)).all() and (part.shares == np.arange(len(keys))).all()


def test_shards_do_not_change_scores(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 80) % 60)) for i in range(150)], "doc_id long, text string").selectExpr("*", "text as __text", "1 as score").repartition(3)
    one, many = ({r["doc_id"]: r["score"] for r in score(df, fit(df.select("text"), parts=p, order=3, most=m)).collect()} for p, m in ((1, 1 << 40), (5, 500)))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one)
