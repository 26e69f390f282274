"""Shared pieces: shared-folder tables, Arrow batches as flat byte arrays, vectorised word hashing, gapless numbering."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Java and RE2 class of word characters; white space is U+0020 and U+0009 to U+000D alone.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders made by the calls of ``tidy`` that are under way, innermost last, in each thread.
_SCOPES = threading.local()
#: Folders of local sessions without a setting.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below the session's ``spark.checkpoint.dir``. Only a local session without one is given a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="tekstara-")
    path = f"{at.rstrip('/')}/t-{uuid.uuid4().hex}"
    for paths in getattr(_SCOPES, "open", [])[-1:]:
        paths.append(path)
    return path


#: Removes a query's shuffle files when it ends, not when the driver happens to collect their last reference.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there and lost executors lose nothing.

    What was shuffled for it is removed once it is written.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        # select(): a plan is bound to the settings under which it was made
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f`` with its result settled, and all folders that it made in the shared folder removed after that."""

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
        spark = next(x if isinstance(x, SparkSession) else x.sparkSession for x in args if isinstance(x, SparkSession | DataFrame))
        out = None
        try:
            out = f(*args, **kwargs)
        finally:
            made = _SCOPES.open.pop()
            try:
                out = settle(out) if out is not None else None
            finally:
                for path in made:
                    remove(spark, path)
        return out

    return run


#: The most frequent keys of a join that are dealt over several tasks, and the rows of one that stay together.
HOT_KEYS, HOT_ROWS = 1000, 1024


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` (a row a key), inner or left, without one task for a key that many rows of ``big`` have.

    The HOT_KEYS most frequent keys (a broadcast of that many rows) are dealt over groups of HOT_ROWS rows, and their rows of
    ``small`` are repeated for each; any other key has at most a HOT_KEYS-th of the rows. ``counts`` are (key, c) of ``big``.
    Null keys match nothing.
    """
    some = big.where(F.col(key).isNotNull())
    counts = (some.groupBy(key).agg(F.count("*")) if counts is None else counts).toDF("__key", "__c")
    hot = F.broadcast(counts.where(F.col("__c") > HOT_ROWS).orderBy(F.desc("__c")).limit(HOT_KEYS).select("__key", F.ceil(F.col("__c") / HOT_ROWS).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = some.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.pmod(F.xxhash64(*big.columns), parts)).drop("__key", "__parts")
    right = small.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__key", "__parts")
    # sorted and merged at every size, so that a small table is joined as a large one will be
    out = left.join(right.hint("merge"), [key, "__salt"], how).drop("__salt")
    if how == "left":
        out = out.unionByName(big.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(1))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array in one uint8 array, and each row's start (one more entry than rows). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows, at most ``rows`` and of about ``most`` bytes of text, as (slice, bytes, row starts)."""
    buf, off = flat(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1), at + rows, n)
        yield batch.slice(at, end - at), buf[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_POW = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW
    if len(_POW[0]) < n:
        n = max(n, STEP_BYTES + (1 << 18))
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(n, np.uint64)
            p[0], k = 1, 1
            while k < n:
                p[k : 2 * k] = p[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            both.append(p)
        _POW = tuple(both)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row: (64-bit hashes after lower-casing A-Z, first words of rows with one more entry, byte starts, byte ends)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), none, none
    ink = ~sep[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink
    last[:-1] &= ~ink[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    p, q = _powers(n)
    sums = np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * p[:n])
    h = (sums[end] - np.where(start > 0, sums[start - 1], np.uint64(0))) * q[start]
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, off), start, end + 1


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words in rows with at least k, and the rows' first windows. A shorter row with words gives one window: all of them."""
    n = np.diff(row)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(row[:-1] - first[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = j < size
        w = h[np.minimum(at + j, len(h) - 1)]
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(1)), out)
    return out, first


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def numbered(df: DataFrame, group: str, slot: str = "slot", chunks: int = 1024) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each ``group``, without one task per group.

    Rows of a group are dealt over ``chunks`` hashed chunks, numbered there, and moved up by the counts of earlier chunks.
    Rows that repeat an id get numbers of their own; a chunk is chosen by all columns, so rows without an id are dealt too. ``group`` must hold few values: groups * chunks counts are broadcast.
    """
    c, n, base = "__chunk", "__n", "__base"
    df = df.withColumn(c, F.pmod(F.xxhash64(*df.columns), F.lit(chunks)).cast("int"))
    # aliases keep the joined names apart from any column of the caller
    w = W.partitionBy(group, c).orderBy(*[x for x in df.columns if x not in (group, c)])
    sums = (
        df.groupBy(group, c).agg(F.count("*").alias(n))
        .withColumn(base, F.sum(n).over(W.partitionBy(group).orderBy(c)) - F.col(n))
        .select(F.col(group).alias("__g"), F.col(c).alias("__c"), base)
    )
    ranked = df.withColumn(slot, F.row_number().over(w).cast("long") - 1)
    on = F.col(group).eqNullSafe(F.col("__g")) & (F.col(c) == F.col("__c"))
    return ranked.join(F.broadcast(sums), on).withColumn(slot, F.col(slot) + F.col(base)).drop("__g", "__c", base, c)
