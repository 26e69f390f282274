"""Sharding: the smallest feasible capacity for contiguous shards of ordered atomic groups, found by binary search."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, numbered, settle, tidy

FIRST_BITS, MORE_BITS = 16, 8


def filled(ends: np.ndarray, cap: int, shards: int) -> bool:
    """Greedy check: do contiguous shards of at most ``cap`` cover everything? ``ends``: running sizes, from 0."""
    at = 0
    for _ in range(shards):
        at = ends[np.searchsorted(ends, at + cap, "right") - 1]
        if at == ends[-1]:
            return True
    return False


def smallest_capacity(ends: np.ndarray, shards: int, least: int) -> int:
    lo, hi = max(least, -(-int(ends[-1]) // shards)), int(ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if filled(ends, mid, shards) else (mid + 1, hi)
    return lo


def cut_at(ends: np.ndarray, cap: int, shards: int) -> list[int]:
    """Indexes into ``ends`` where shards end: within the capacity, and as even as that and the remaining shards allow."""
    from_right = [len(ends) - 1]
    for _ in range(shards - 1):
        from_right.append(int(np.searchsorted(ends, ends[from_right[-1]] - cap, "left")))
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        want = ends[at] + (ends[-1] - ends[at]) / left
        j = int(np.searchsorted(ends, want))
        j = j - 1 if j > 0 and want - ends[j - 1] <= ends[min(j, len(ends) - 1)] - want else j
        most = int(np.searchsorted(ends, ends[at] + cap, "right")) - 1
        at = min(max(j, from_right[left - 1], at), most)
        cuts.append(at)
    return cuts


def shard_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first keys of shards 1.., capacity) for a table (key long, size long) of groups ordered by key.

    The driver sees sums over ranges of the key: first 2^16 of them, then, for ranges that a cut can still fall into, 2^8 finer
    ones each, until such a range is one group. A cut k lies between where greedy filling with the lower bound and with the
    upper bound of the capacity can reach, a span of at most k ranges, so what is fetched doesn't grow with the table.
    """

    def sums(df: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
        at = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
        got = df.groupBy(at.alias("p")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n"))
        return [(r["p"] << (64 - bits), r["s"], r["m"], r["n"], bits) for r in got.collect()]

    units = sorted(sums(groups, FIRST_BITS))
    while units:
        size, largest = [u[1] for u in units], max(u[2] for u in units)
        ends = np.concatenate([[0], np.cumsum(np.array(size, np.int64))])
        total = int(ends[-1])
        lo, hi = max(largest, -(-total // shards)), smallest_capacity(ends, shards, largest)
        if lo >= hi:
            break
        low = high = 0
        open_units: set[int] = set()
        for _ in range(shards):
            low = int(ends[np.searchsorted(ends, min(low + lo, total), "right") - 1])
            high = min(high + hi, total)
            a, b = int(np.searchsorted(ends, low, "right")) - 1, int(np.searchsorted(ends, high, "left"))
            open_units |= {i for i in range(max(a, 0), min(b, len(units))) if units[i][3] > 1}
        if not open_units:
            break
        finer = []
        for bits in sorted({units[i][4] for i in open_units}):
            own = [units[i][0] >> (64 - bits) for i in open_units if units[i][4] == bits]
            finer += sums(groups.where(F.shiftright("key", 64 - bits).isin(own)), min(64, bits + MORE_BITS))
        units = sorted([u for i, u in enumerate(units) if i not in open_units] + finer)
    if not units:
        return [], 0
    ends = np.concatenate([[0], np.cumsum(np.array([u[1] for u in units], np.int64))])
    cap = smallest_capacity(ends, shards, max(u[2] for u in units))
    top = (1 << 63) - 1
    return [units[i][0] if i < len(units) else top for i in cut_at(ends, cap, shards)], cap


@tidy
def shard(df: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = 16) -> DataFrame:
    """One row per row of ``df``: size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) and capacity.

    Equal texts are one atomic group, ordered by a hash of the text; a null text is a group of its own, has no bytes (size 1)
    and the checksum of the empty text, though it isn't equal to an empty text: those are one group. No shard exceeds the least capacity that contiguous shards of these groups can have.
    Repeated rows keep a slot each; an empty table gives an empty result.
    """
    t = df[text]
    key = F.when(t.isNotNull(), F.xxhash64(t)).otherwise(F.xxhash64(F.lit("null"), df[id_col]))
    crc = F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long")
    rows = settle(df.select(df[id_col].alias(id_col), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"), crc.alias("text_crc32"), key.alias("key")))
    cuts, cap = shard_cuts(settle(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    at = reduce(lambda a, b: a + b, [(F.col("key") >= c).cast("int") for c in cuts], F.lit(0))
    out = numbered(rows.withColumn("shard", at), "shard")
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.lit(cap).cast("long").alias("capacity"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))
