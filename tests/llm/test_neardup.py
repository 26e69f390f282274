import re
import string
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from tekstara.llm import common, neardup
from tekstara.llm.common import salted_join
from tekstara.llm.neardup import estimate, near_duplicates, registers, shingle_sets

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, k=2, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def texts():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(5, 120, 40)]
    out = base + base[:10]
    for t in base:  # near copies at all degrees
        for share in (0.02, 0.04, 0.06, 0.1):
            w = t.split()
            for j in np.flatnonzero(rng.random(len(w)) < share):
                w[j] = str(rng.choice(vocabulary))
            out.append(" ".join(w))
    # a large group of mutated copies, many of them too far from each other
    w0 = rng.choice(vocabulary, 100)
    for _ in range(300):
        w = w0.copy()
        for j in rng.integers(0, 100, rng.integers(0, 9)):
            w[j] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out + [None, "", "  ", "One", "one", "ONE two", "one two", "A\tb\nc", "a b c", "long " + "x " * 30_000]


def test_components_against_brute_force(spark):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as comp").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_five_words(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:120])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, k=5).collect()} == brute(rows, 5)


def test_edges(spark):
    df = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "a b c"), (1, "A B C")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 54, 3000).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    r = [registers(x, np.array([0, len(x)])) for x in (a, b, both)]
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    x, y = both[: int(len(both) * 0.9)], both[int(len(both) * 0.1) :]
    j = len(np.intersect1d(x, y)) / len(both)
    got = estimate(registers(x, np.array([0, len(x)])), registers(y, np.array([0, len(y)])), np.array([float(len(x))]), np.array([float(len(y))]))[0]
    assert abs(got - j) < 0.2


def test_sets_are_exact():
    t = "a b a b a b c".encode()
    sets, first = shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 2)
    assert len(sets) == 3 and first.tolist() == [0, 3]


def test_ids_of_other_types(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, base.replace(f"w{i} ", f"x{i} ")) for i in range(60)]
    for kind in ("smallint", "string", "decimal(20,0)"):
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
        got = near_duplicates(df)
        assert dict(got.dtypes)["component_id"] == kind and {str(r["component_id"]) for r in got.collect()} == {"0"}


def test_split_buckets_and_hot_keys(spark, monkeypatch):
    """Small blocks and groups give the same result, and very long sets have blocks of their own."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(5000 + i, " ".join(f"v{j}" for j in range(30_000) if j != 17 * i)) for i in range(4)] + [(6000 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(neardup, "CELL", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()} == brute(rows)


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = [(i, k) for i, k in enumerate([1] * 20 + [2] * 10 + [3] * 8 + [4, 4, 5, None, None])]
    big, small = spark.createDataFrame(rows, "i long, c long"), spark.createDataFrame([(k, k * 10) for k in (1, 2, 3, 4)], "c long, v long")
    for how in ("inner", "left"):
        want = sorted(((i, k, k * 10 if k and k < 5 else None) for i, k in rows if how == "left" or (k and k < 5)), key=repr)
        assert sorted((tuple(r) for r in salted_join(big, small, "c", how).select("i", "c", "v").collect()), key=repr) == want


def test_folders_of_steps_are_removed(spark):
    at = Path(urlparse(common.shared_dir(spark)).path).parent
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:60])], "doc_id long, text string")
    before = set(at.iterdir()) if at.exists() else set()
    got = near_duplicates(df)
    assert len(set(at.iterdir()) - before) == 1 and got.count() == 60


def test_settled_steps_leave_no_shuffle_files(spark):
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    df = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before = files()
    settled = common.settle(df)
    assert not files() - before
    assert settled.count() == df.count() == 100
