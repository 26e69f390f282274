"""Packing: length buckets by dynamic programming over the global histogram, token-budget batches inside them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, load, numbered, settle, tidy

BUCKETS, BUDGET = 12, 65_536


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_bounds(length: np.ndarray, count: np.ndarray, k: int) -> list[int]:
    """Bucket bounds (each the longest length inside) with the least padding, by dynamic programming over a histogram.

    ``length``: the distinct lengths in order; ``count``: how many rows have each. The cost of lengths i..j in one bucket is
    length[j] * count - total over them; it satisfies the quadrangle inequality, so optimal splits are monotone: a layer's
    middle splits bound those on both sides. The middles of one depth are worked out together, so each of the k layers takes
    O(n log n) in vectorised steps.
    """
    n = len(length)
    c = np.concatenate([[0], np.cumsum(count)]).astype(float)
    s = np.concatenate([[0], np.cumsum(length.astype(float) * count)])
    top = np.concatenate([[0], length]).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    splits = []
    for _ in range(min(k, n)):
        new, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        # parts of the row still to do: ends lo..hi, whose splits lie in a..b
        lo, hi, a, b = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(b, mid - 1) - a + 1
            first = np.cumsum(size) - size
            of = np.repeat(np.arange(len(mid)), size)
            i = np.arange(len(of)) - first[of] + a[of]
            j = mid[of]
            cost = best[i] + top[j] * (c[j] - c[i]) - (s[j] - s[i])
            least = np.minimum.reduceat(cost, first)
            at = np.full(len(mid), n)
            good = np.flatnonzero(cost == least[of])
            np.minimum.at(at, of[good], i[good])
            new[mid], split[mid] = least, at
            left, right = lo < mid, mid < hi
            lo, hi, a, b = (
                np.concatenate([lo[left], mid[right] + 1]), np.concatenate([mid[left] - 1, hi[right]]),
                np.concatenate([a[left], at[right]]), np.concatenate([at[left], b[right]]),
            )
        best = new
        splits.append(split)
    bounds, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        bounds.append(int(length[j - 1]))
        j = int(split[j])
    return bounds[::-1]


@tidy
def pack(df: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``df``: n_tokens, bucket, bucket_len (padded length), batch within the bucket, slot, padding.

    The histogram covers all rows and is exact, so no other bounds give less padding. It has few entries: n distinct lengths need
    texts of n * n / 2 words in all. A batch holds max(1, budget // bucket_len) rows of one bucket, so its padded tokens stay
    within the budget unless a single row exceeds it, which then has a batch of its own. Null or empty texts have length 0 and
    go to the first bucket; repeated rows are packed one by one; an empty table gives an empty result.
    """
    length = n_words("text") if length is None else length
    rows = settle(df.select(df[id_col].alias(id_col), length.alias("n_tokens")))
    hist = sorted((r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds = best_bounds(*(np.array(x, np.int64) for x in zip(*hist, strict=True)), buckets) if hist else [0]
    n = F.col("n_tokens")
    bucket = reduce(lambda a, b: a + b, [(n > b).cast("int") for b in bounds[:-1]], F.lit(0))
    at = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    out = numbered(rows.withColumn("bucket", bucket), "bucket").withColumn("bucket_len", at)
    fit = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(bucket_len, 1)"))
    return out.withColumn("fit", fit).select(id_col, "n_tokens", "bucket", "bucket_len", F.expr("slot div fit").alias("batch"), F.expr("slot % fit").alias("slot"), (F.col("bucket_len") - n).alias("padding"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
