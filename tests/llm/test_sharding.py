import zlib
from itertools import combinations

import numpy as np

from tekstara.llm.sharding import cut_at, filled, shard, shard_cuts, smallest_capacity


def test_capacity_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes, k = rng.integers(1, 20, rng.integers(1, 9)), int(rng.integers(1, 5))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        best = min(max(int(sizes[a:b].sum()) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for r in range(min(k, len(sizes))) for c in combinations(range(1, len(sizes)), r))
        cap = smallest_capacity(ends, k, int(sizes.max()))
        assert cap == best and filled(ends, cap, k)
        cuts = [0, *cut_at(ends, cap, k), len(sizes)]
        assert cuts == sorted(cuts) and all(ends[b] - ends[a] <= cap for a, b in zip(cuts, cuts[1:], strict=False))


def test_refinement_finds_the_optimum(spark):
    rng = np.random.default_rng(6)
    # keys close together, so that coarse ranges hold many groups
    keys = sorted({int(x) for x in rng.integers(0, 1 << 40, 400)} | {-5, (1 << 62)})
    sizes = [int(x) for x in rng.integers(1, 100, len(keys))]
    cuts, cap = shard_cuts(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key long, size long"), 7)
    assert cap == smallest_capacity(np.concatenate([[0], np.cumsum(sizes)]), 7, max(sizes))
    sums = [0] * 7
    for k, s in zip(keys, sizes, strict=True):
        sums[sum(k >= c for c in cuts)] += s
    assert max(sums) <= cap


def test_shards(spark):
    texts = [None, None, "", "", "ü" * 10] + [f"text {i % 150} " + "x" * (i % 37) for i in range(600)] + ["hot copy"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size_")
    rows = shard(df).collect()
    assert len(rows) == len(texts)
    by_text, slots, size = {}, {}, {}
    for r in rows:
        t = texts[r["doc_id"]]
        b = (t or "").encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        if t is not None:
            by_text.setdefault(t, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) <= rows[0]["capacity"]


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_repeats_and_long_texts(spark):
    rows = [(None, "a"), (None, None), (None, ""), (1, "a"), (1, "a"), (1, "b"), (2, ""), (3, None), (4, "ü" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as key", "3 as size")
    got = shard(df, shards=4).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    of = lambda crc, size: {r["shard"] for r in got if (r["text_crc32"], r["size"]) == (crc, size)}
    assert len(of(zlib.crc32(b"a"), 2)) == 1 and max(r["size"] for r in got) == got[0]["capacity"] == 600_001
