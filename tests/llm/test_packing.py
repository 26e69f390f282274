from itertools import combinations

import numpy as np

from tekstara.llm.packing import best_bounds, pack


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 4):
        for _ in range(20):
            lengths = rng.integers(0, 30, rng.integers(1, 25))
            v, c = np.unique(lengths, return_counts=True)
            bounds = best_bounds(v, c, k)
            least = min(padding(lengths, [*s, v[-1]]) for r in range(min(k, len(v))) for s in combinations(v[:-1].tolist(), r))
            assert len(bounds) <= k and padding(lengths, bounds) == least


def test_batches(spark):
    texts = [None, "", "one"] + [" ".join(["w"] * n) for n in (1, 2, 3, 50, 51, 52, 200, 3000)] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as bucket", "8 as slot")
    rows = pack(df, buckets=4, budget=1000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    groups = {}
    for r in rows:
        n = len((texts[r["doc_id"]] or "").split())
        assert r["n_tokens"] == n and r["padding"] == r["bucket_len"] - n >= 0
        groups.setdefault((r["bucket"], r["batch"]), []).append(r)
    for g in groups.values():
        assert len(g) * g[0]["bucket_len"] <= 1000 or len(g) == 1
        assert sorted(r["slot"] for r in g) == list(range(len(g)))
    assert len({r["bucket"] for r in rows}) <= 4


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert pack(df).count() == 3
    assert pack(df.limit(0)).count() == 0


def test_long_clustered_lengths_are_packed_best(spark):
    rng = np.random.default_rng(9)
    for _ in range(3):
        lengths = np.concatenate([rng.integers(c, c + 40, 12) for c in rng.integers(2_000, 20_000, 5)])
        df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, n long")
        rows = pack(df, length=df["n"], buckets=4).collect()
        v = np.unique(lengths).tolist()
        # brute force over all sets of bounds by a plain recurrence
        cost = lambda i, j: sum(v[j] - n for n in lengths.tolist() if v[i] <= n <= v[j])
        best = [cost(0, j) for j in range(len(v))]
        for _k in range(3):
            best = [min([best[j]] + [best[i] + cost(i + 1, j) for i in range(j)]) for j in range(len(v))]
        assert sum(r["padding"] for r in rows) == best[-1]


def test_many_lengths_take_little_time():
    import time

    rng = np.random.default_rng(10)
    n = np.unique(rng.integers(1, 1 << 30, 200_000))
    began = time.time()
    assert len(best_bounds(n, np.ones(len(n), np.int64), 12)) == 12
    assert time.time() - began < 30
