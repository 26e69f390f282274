"""Spelling over a whole corpus: every word with each pair of its neighbours is a query, in few bytes on disk.

What a query's word can be corrected to depends on the word alone, so it is found once a distinct word. Neighbours only order
several corrections; they are looked up for those queries. All queries are met as numbers of the ``CODES`` most frequent words
(a bounded broadcast); rarer words stay strings. Steps are settled in the folder of ``spark.checkpoint.dir``; those that the
result reads stay there.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.lithuanian import osa
from .spelling import listed, restored

#: Bits of a word's number: 0 is no word, 1 a word that has no number.
BITS = 18
CODES = (1 << BITS) - 2
#: Tokens, deletions and matches that one vectorised step takes.
STEP = 1 << 19
#: Deletions or tokens of a bucket, about.
BUCKET = 1 << 20
#: Texts of a batch; few, as two workers share an executor's memory with its heap.
TEXTS = 1000
#: Longer words are compared one by one.
LONG = 64
_LOCAL: dict[str, str] = {}


def settle(df: DataFrame, rows: int = 10_000) -> tuple[DataFrame, str]:
    """``df`` written into the shared folder and read back, and its path; what was shuffled for it is removed. An Arrow batch has
    ``rows`` rows at most."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="tekstara-")
    path = f"{at.rstrip('/')}/t-{uuid.uuid4().hex}"
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.select("*").write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _release() -> None:
    """Gives freed memory back: workers stay when their task is over, and share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=2)
def _strings(joined: str) -> pa.Array:
    return pa.array(joined.split("\n") if joined else [], pa.string())


def coded(words: Broadcast) -> Callable[[pa.Array], np.ndarray]:
    """Each word's number, from 2; 1 if it has none."""
    return lambda s: pc.fill_null(pc.index_in(s, value_set=_strings(words.value)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 2


def frequent(words: DataFrame) -> list[str]:
    """The words (form, freq) seen most often, CODES at most. Words seen equally often are all taken or none."""
    least, n = 0, 0
    for freq, count in words.groupBy("freq").count().orderBy(F.desc("freq")).collect():
        n += count
        if n > CODES:
            least = freq + 1
            break
    return [r[0] for r in words.where(F.col("freq") >= least).orderBy(F.desc("freq"), "form").select("form").collect()]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _planes(keys: np.ndarray) -> bytes:
    """Bytes of sorted 64-bit keys, all first ones, all second ones and so on: in most planes neighbours are the same."""
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _keys(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n).T).view("<i8").ravel()


def _once(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its times."""
    k, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, times))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def triples(texts: DataFrame, tokens: str, words: Broadcast, size: int) -> DataFrame:
    """p, w, x, rare, n: every distinct word with its neighbours as numbers (0 at an end), and how often it is there.

    ``rare`` has those of the three that have no number, in order, with spaces between. x is -1 in rows of the pairs p, w that are
    there twice or more. Keys go as sorted arrays into buckets, ``size`` tokens in about size / BUCKET.
    """
    buckets = max(8, -(-size // BUCKET))

    def bucketed(kind: int, to: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> Iterator[tuple[int, int, int, bytes]]:
        order = np.argsort(to, kind="stable")
        cuts = [*np.flatnonzero(np.diff(to[order], prepend=-1)), len(to)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(to[order[a]]), kind, int(b - a), pack(order[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = coded(words)
        held: list[list] = [[], [], [], []]

        def given() -> Iterator[pa.RecordBatch]:
            rows: list = []
            for pairs in (0, 1):
                if held[pairs]:
                    k, n = np.unique(np.concatenate(held[pairs]), return_counts=True)
                    for many in (0, 1):
                        kk, nn = k[(n > 1) == many], n[(n > 1) == many].astype("<i8")
                        to = (_mixed(kk.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                        rows += bucketed(pairs * 3 + many, to, lambda i, kk=kk, nn=nn, many=many: _planes(kk[i]) + (nn[i].tobytes() if many else b""))
                if held[2 + pairs]:
                    k, names = np.concatenate([x[0] for x in held[2 + pairs]]), [s for x in held[2 + pairs] for s in x[1].to_pylist()]
                    to = np.fromiter((crc32(s.encode()) for s in names), np.uint64, len(names)) ^ _mixed(k.astype(np.uint64))
                    rows += bucketed(pairs * 3 + 2, (to % np.uint64(buckets)).astype(np.int32), lambda i, k=k, names=names: _planes(k[i]) + "\n".join([names[j] for j in i]).encode())
            for x in held:
                x.clear()
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 256], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "size", "blob"])

        waiting = 0
        for batch in batches:
            lists = batch.column(0).drop_null()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(lists):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
                flat, stops, at = lists.slice(at, to - at).flatten(), ends[at:to] - done, to
                if not len(flat):
                    continue
                code = number(flat)
                prev, after = np.roll(code, 1), np.roll(code, -1)
                prev[np.r_[0, stops[stops < len(flat)]]] = 0
                after[stops[stops > 0] - 1] = 0
                for pairs, parts in ((0, (prev, code, after)), (1, (prev, code))):
                    key = parts[0] << BITS | parts[1]
                    key = key if pairs else key << BITS | after
                    some = prev > 0 if pairs else np.ones(len(key), bool)
                    rare = np.any([c == 1 for c in parts], axis=0)
                    held[pairs].append(key[some & ~rare])
                    i = np.flatnonzero(some & rare)
                    named = [flat.take(pa.array(np.where(c[i] == 1, i + d, 0), mask=c[i] != 1)) for c, d in zip(parts, (-1, 0, 1), strict=False)]
                    held[2 + pairs].append((key[i], pc.binary_join_element_wise(*named, " ", null_handling="skip").cast(pa.string())))
                waiting += len(flat)
                if waiting >= 2 * STEP:
                    waiting = 0
                    yield from given()
                    _release()
        yield from given()
        _release()

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "size", "blob")), strict=True))
        made = []
        for pairs in (0, 1):
            keys = [_keys(b, n) for c, n, b in rows if c // 3 == pairs and c % 3 < 2]
            times = [np.frombuffer(b, "<i8", n, 8 * n) if c % 3 else np.ones(n, np.int64) for c, n, b in rows if c // 3 == pairs and c % 3 < 2]
            k, n = _once(keys, times)
            made.append((pairs, k, pa.nulls(len(k), pa.string()).fill_null(""), n))
            named = [(_keys(b, n), b[8 * n :].decode().split("\n")) for c, n, b in rows if c == pairs * 3 + 2]
            if named:
                t = pa.table({"k": np.concatenate([x[0] for x in named]), "rare": pa.array([s for x in named for s in x[1]], pa.string())})
                t = t.group_by(["k", "rare"]).aggregate([([], "count_all")])
                made.append((pairs, t["k"].to_numpy(), t["rare"].combine_chunks(), t["count_all"].to_numpy()))
        out = []
        for pairs, k, rare, n in made:
            few = n >= (2 if pairs else 1)
            k, rare, n = k[few], rare.filter(pa.array(few)), n[few]
            k = k << BITS if pairs else k
            code = [(k >> b * BITS & (1 << BITS) - 1).astype(np.int32) for b in (2, 1, 0)]
            code[2] = np.full(len(k), -1, np.int32) if pairs else code[2]
            out.append(pa.table([*map(pa.array, code), rare, pa.array(n.astype(np.int64))], ["p", "w", "x", "rare", "n"]))
        return pa.concat_tables(out)

    spread = texts.select(tokens).mapInArrow(run, "bucket int, kind int, size int, blob binary")
    return spread.groupBy("bucket").applyInArrow(meet, "p int, w int, x int, rare string, n long")


def spelled(found: DataFrame, words: Broadcast, short: bool = False) -> DataFrame:
    """``triples`` with prev, word and next as strings (null at an end) and all three as qid; only word and qid, if ``short``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _strings(words.value)
        for b in batches:
            codes = [b.column(i).to_numpy() for i in range(3)]
            whole = ~((codes[0] == 1) | (codes[1] == 1) | (codes[2] == 1))
            given = [known.take(pa.array(np.maximum(c - 2, 0), mask=c < 2)) for c in codes]
            if not whole.all():
                before = np.zeros(len(whole), np.int64)
                pieces = pc.split_pattern(b.column(3), " ")
                starts, flat = pieces.offsets.to_numpy()[:-1], pieces.flatten()
                starts = starts - pieces.offsets[0].as_py()
                for i, c in enumerate(codes):
                    one = c == 1
                    own = flat.take(pa.array(np.where(one, starts + before, 0), mask=~one))
                    given[i], before = pc.coalesce(given[i], own), before + one
            given = [x.cast(pa.string()) for x in given]
            qid = pc.binary_join_element_wise(*(pc.fill_null(x, "^") for x in given), " ")  # no token holds a ^
            yield pa.RecordBatch.from_arrays([given[1], qid] if short else [*(b.column(i) for i in range(3)), *given, qid], names)

    kinds = "word string, qid string" if short else "p int, w int, x int, prev string, word string, next string, qid string"
    names = [x.split()[0] for x in kinds.split(", ")]
    return found.select("p", "w", "x", "rare").mapInArrow(run, kinds)


_BASE = 0x9E3779B97F4A7C15


def _deletions(words: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of words with 0, 1 and 2 characters deleted: how many, hash, id, first and second place (modulo 256)."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    power = lambda e: np.uint64(pow(_BASE, e, 1 << 64))
    for n in map(int, np.unique(length)):
        every = np.flatnonzero(length == n)
        step = max(1, STEP // (1 + n + n * (n - 1) // 2))
        for a in range(0, len(every), step):
            some = every[a : a + step]
            m = np.frombuffer("".join(words[some]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), n).T.astype(np.uint64)
            m = _mixed(m + np.uint64(1))
            own, none = ids[some], np.zeros(len(some), np.uint8)
            # sums of hashed characters times powers of the base, with as many powers less as characters before were deleted
            sums = [np.zeros((n + 1, len(some)), np.uint64) for _ in range(3)]
            for d in range(3):
                for i in range(n):
                    sums[d][i + 1] = sums[d][i] + m[i] * power(i - d)
            yield 0, _mixed(sums[0][n]), own, none, none
            for i in range(n):
                at, cut = np.full(len(some), i & 255, np.uint8), sums[0][i] - sums[1][i + 1]
                yield 1, _mixed(cut + sums[1][n]), own, at, none
                if i + 1 < n:
                    j = np.arange(i + 1, n)
                    h = cut + sums[1][i + 1 : n] - sums[2][i + 2 : n + 1] + sums[2][n]
                    yield 2, _mixed(h.ravel()), np.tile(own, len(j)), np.full(h.size, i & 255, np.uint8), np.repeat((j & 255).astype(np.uint8), len(some))


def _near(a: np.ndarray, b: np.ndarray, less: int = 0) -> np.ndarray:
    """Places that are the same or neighbours, modulo 256; ``less`` is taken from a."""
    return (a - b + np.uint8(1 - less & 255)) <= 2


def close_pairs(asked: DataFrame, forms: DataFrame, size: int, keys: int) -> DataFrame:
    """q, f: ids (under ``size``) of ``asked`` and ``forms`` (id, word) that may be within an optimal string alignment distance of 2.

    Words within that distance share a deletion: an edit that puts or changes a letter, or swaps two, deletes one of the form, and
    one that drops, changes or swaps letters deletes one of the word. Where both sides delete, the places of a change are the same
    or neighbours, which spares most of the other pairs. Deletions are met as sorted hashes in buckets of about BUCKET (``keys``
    in all); equal hashes of other strings only give pairs that the distance rejects.
    """
    kind, buckets = np.dtype("<u4" if size < 1 << 32 else "<u8"), max(8, -(-keys // BUCKET))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: list = [[[], [], []], [[], [], []]]
        n = 0

        def given(side: int) -> Iterator[pa.RecordBatch]:
            held = both[side]
            for d in range(3):
                if held[d]:
                    h, own, i, j = (np.concatenate(x) for x in zip(*held[d], strict=True))
                    held[d] = []
                    to = (h % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(to, kind="stable")
                    h, own, i, j, to = (h[order] >> np.uint64(32)).astype("<u4"), own[order], i[order], j[order], to[order]
                    cuts = np.flatnonzero(np.diff(to, prepend=-1))
                    blobs = [b"".join(x[a:b].tobytes() for x in (h, own, i, j)) for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(to[cuts]), pa.array([side * 3 + d] * len(cuts), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

        for batch in batches:
            sides, words, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().astype(kind)
            for side in (0, 1):
                mine = sides == side
                for d, *x in _deletions(words[mine], ids[mine]):
                    both[side][d].append(x)
                    n += len(x[0])
                    if n >= 2 * STEP:
                        n = 0
                        for s in (0, 1):
                            yield from given(s)
        for s in (0, 1):
            yield from given(s)
        _release()

    def meet(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        sides: dict[int, list] = {}
        for c in range(6):
            parts = []
            for blob in (b for b, k in zip(blobs, kinds, strict=True) if k == c):
                n = len(blob) // (6 + kind.itemsize)
                parts.append([np.frombuffer(blob, t, n, o * n) for t, o in (("<u4", 0), (kind, 4), ("u1", 4 + kind.itemsize), ("u1", 5 + kind.itemsize))])
            if parts:
                x = [np.concatenate(p) for p in zip(*parts, strict=True)]
                order = np.argsort(x[0], kind="stable")
                sides[c] = [y[order] for y in x]
        found = [np.zeros((0, 2), np.int64)]
        for dq in range(3):
            for df in range(3):
                if not dq + df or dq not in sides or 3 + df not in sides:
                    continue
                (h, q, i, j), (hf, f, k, m) = sides[dq], sides[3 + df]
                a, b = np.searchsorted(hf, h, "left"), np.searchsorted(hf, h, "right")
                hit = np.flatnonzero(b > a)
                total, at = np.cumsum(b[hit] - a[hit]), 0
                while at < len(hit):
                    to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
                    some, at = hit[at:to], to
                    n = b[some] - a[some]
                    r = np.repeat(some, n)
                    s = np.arange(len(r)) + np.repeat(a[some] - np.cumsum(n) + n, n)
                    if dq == df == 2:
                        keep = _near(i[r], k[s]) & _near(j[r], m[s])
                    elif (dq, df) == (2, 1):
                        keep = _near(i[r], k[s]) | _near(j[r], k[s], 1)
                    elif (dq, df) == (1, 2):
                        keep = _near(k[s], i[r]) | _near(m[s], i[r], 1)
                    else:
                        keep = np.ones(len(r), bool)
                    pairs = np.stack([q[r[keep]].astype(np.int64), f[s[keep]].astype(np.int64)], 1)
                    found.append(pairs)
        both = np.concatenate(found)
        if len(both):
            order = np.lexsort((both[:, 1], both[:, 0]))
            both = both[order]
            both = both[np.r_[True, (both[1:] != both[:-1]).any(1)]]
        return pa.table({"q": both[:, 0], "f": both[:, 1]})

    rows = asked.select(F.lit(0).alias("side"), "word", "id").unionByName(forms.select(F.lit(1).alias("side"), "word", "id"))
    return rows.mapInArrow(spread, "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(meet, "q long, f long").distinct()


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Optimal string alignment distances, at most 3, as ``osa`` has them one by one."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    size = np.maximum(la, lb)
    out = np.where(np.minimum(la, lb) == 0, np.minimum(size, 3), 3).astype(np.uint8)
    for n in map(int, np.unique(size[size <= LONG])):
        some = np.flatnonzero((size == n) & (np.abs(la - lb) <= 2))
        if not len(some):
            continue
        x, y = (np.frombuffer("".join(s[i].ljust(n, "\0") for i in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), n).T.copy() for s in (a, b))
        far = np.full(len(some), 3, np.uint8)
        cell = {(0, j): np.full(len(some), min(j, 3), np.uint8) for j in range(min(n, 2) + 1)}
        for i in range(1, n + 1):
            for j in range(max(0, i - 2), min(n, i + 2) + 1):
                if j == 0:
                    cell[i, 0] = np.full(len(some), min(i, 3), np.uint8)
                    continue
                c = np.minimum(cell.get((i - 1, j), far) + 1, cell.get((i, j - 1), far) + 1)
                np.minimum(c, cell[i - 1, j - 1] + (x[i - 1] != y[j - 1]), out=c)
                if i > 1 and j > 1:
                    c = np.where((x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1]), np.minimum(c, cell[i - 2, j - 2] + 1), c)
                cell[i, j] = np.minimum(c, far)
                if i == n or j == n:
                    ends = (la[some] == i) & (lb[some] == j)
                    out[some[ends]] = cell[i, j][ends]
    for i in np.flatnonzero((size > LONG) & (np.abs(la - lb) <= 2)):
        out[i] = osa(a[i], b[i])
    return out


def _within(pairs: DataFrame, most: int, words: Broadcast) -> DataFrame:
    """word, form, freq with their distance, where it is at most ``most``, and the form's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(words.value)
        for b in batches:
            forms = b.column(1).to_pylist()
            d = distances(b.column(0).to_pylist(), forms)
            code = [places.get(x, 1) for x in forms]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.astype(np.int32)), pa.array(code, pa.int32())], ["word", "form", "freq", "distance", "code"]).filter(pa.array(d <= most))
        _release()

    return pairs.select("word", "form", "freq").mapInArrow(run, "word string, form string, freq long, distance int, code int")


def corpus_suggestions(texts: DataFrame, tokens: str = "tokens", least: int = 2, least_freq: int = 5, top: int = 8) -> DataFrame:
    """qid, word, kind, corrections, autofix as ``spelling.suggest`` gives them, for every distinct lower-case token with its neighbours.

    Words are the tokens seen ``least`` times or more, pairs those of neighbours seen twice or more. qid: prev, word and next.
    """
    spark = texts.sparkSession
    counts = texts.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    all_words, at_words = settle(counts.withColumn("id", F.monotonically_increasing_id()))
    part, row, n = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)), F.length("word").cast("long")
    known, form = F.col("freq") >= least, F.col("freq") >= least_freq
    # rare words and forms have deletions; their number decides into how many buckets they go
    rows, parts, size, keys = all_words.agg(F.max(row), F.max(part), F.sum("freq"), F.sum(F.when(~known | form, 1 + n + F.floor(n * (n - 1) / 2)))).first()
    rows, parts = (rows or 0) + 1, (parts or 0) + 1
    all_words = all_words.withColumn("id", part * rows + row)
    words = all_words.where(known).select(F.col("word").alias("form"), "freq")
    shared = spark.sparkContext.broadcast("\n".join(frequent(words)))

    # by distinct words: what each can be corrected to
    asked = all_words.withColumn("low", F.col("word")).withColumn("known", known).withColumn("own", F.when(known, F.col("freq")).otherwise(0)).withColumn("qid", F.col("word"))
    restore = restored(asked.where(F.length("word") >= 2).select("qid", "word", "low", "known", "own"), words).select("word", "form", "freq", "distance", "kind")
    restore, at_restore = settle(restore)
    first = F.substring("word", 1, 1)
    open_ = all_words.where(~known & (F.length("word") >= 2) & (F.upper(first) != first)).join(restore.select("word").distinct(), "word", "left_anti")
    forms = all_words.where(form)
    pairs, at_pairs = settle(close_pairs(open_.select("word", "id"), forms.select("word", "id"), parts * rows, keys or 0))
    pairs = pairs.join(forms.select(F.col("id").alias("f"), F.col("word").alias("form"), "freq"), "f").join(all_words.select(F.col("id").alias("q"), "word"), "q")
    typo = _within(pairs.where(F.col("form") != F.col("word")), 2, shared).withColumn("kind", F.lit("typo"))
    found = _numbered(restore, "form", shared).unionByName(typo).groupBy("word").agg(F.min("kind").alias("kind"), F.collect_list(F.struct("form", "freq", "distance", "code")).alias("forms"))
    found, at_found = settle(found)
    for path in (at_restore, at_pairs):
        remove(spark, path)

    # all queries, in numbers; those of words without a number or with corrections are spelled
    met, _ = settle(triples(texts, tokens, shared, size or 0), TEXTS)
    every = met.where("x >= 0")
    some = _numbered(found.where(F.col("kind") == "restore").select("word"), "word", shared).where("code > 1").select("code").distinct()
    spared = spark.createDataFrame([(1,), *((r[0],) for r in some.collect())], "w int")
    plain = F.when(known | (F.length("word") < 2), "ok").otherwise("unknown")
    verdicts = all_words.select("word", plain.alias("plain")).join(found, "word", "left").withColumn("kind", F.coalesce("kind", "plain")).drop("plain")
    asked, _ = settle(spelled(every.join(F.broadcast(spared), "w", "left_semi"), shared).join(verdicts, "word").withColumn("at", F.monotonically_increasing_id()))
    for path in (at_words, at_found):
        remove(spark, path)

    # how often neighbours stand beside each of several corrections
    several = asked.where(F.size("forms") > 1).select("at", "p", "x", "prev", "next", F.posexplode("forms").alias("i", "c"))
    name = lambda code, s: F.when(code == 1, s)
    before = F.struct((F.shiftleft(F.col("p").cast("long"), BITS) + F.col("c.code")).alias("pair"), F.concat_ws(" ", name(F.col("p"), F.col("prev")), name(F.col("c.code"), F.col("c.form"))).alias("rare"))
    after = F.struct((F.shiftleft(F.col("c.code").cast("long"), BITS) + F.col("x")).alias("pair"), F.concat_ws(" ", name(F.col("c.code"), F.col("c.form")), name(F.col("x"), F.col("next"))).alias("rare"))
    sides = F.array_compact(F.array(F.when(F.col("p") > 0, before), F.when(F.col("x") > 0, after)))
    looked = several.select("at", "i", F.inline(sides))
    beside = met.where("x = -1").select((F.shiftleft(F.col("p").cast("long"), BITS) + F.col("w")).alias("pair"), "rare", "n")
    context = looked.join(beside.hint("shuffle_hash"), ["pair", "rare"]).groupBy("at").agg(F.collect_list(F.struct("i", "n")).alias("beside"))
    context, _ = settle(context)

    rows = asked.where("forms is not null").join(context, "at", "left")
    rows = rows.select("at", "qid", "word", "kind", "beside", F.posexplode("forms").alias("i", "c"))
    times = F.aggregate(F.filter(F.coalesce("beside", F.array().cast("array<struct<i:int,n:bigint>>")), lambda x: x["i"] == F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    ranked = listed(rows.select("at", "qid", "word", "kind", "c.form", "c.freq", "c.distance", times.alias("context")), top, "at", "qid", "word")
    none = [F.array().cast("array<string>").alias("corrections"), F.lit(None).cast("string").alias("autofix")]
    plain = asked.where("forms is null").select("qid", "word", "kind", *none)
    known = spelled(every.join(F.broadcast(spared), "w", "left_anti"), shared, True).select("qid", "word", F.lit("ok").alias("kind"), *none)
    return known.unionByName(plain).unionByName(ranked.select("qid", "word", "kind", "corrections", "autofix"))


@lru_cache(maxsize=2)
def _places(joined: str) -> dict[str, int]:
    return {x: i + 2 for i, x in enumerate(joined.split("\n") if joined else [])}


def _numbered(df: DataFrame, column: str, words: Broadcast) -> DataFrame:
    """Add ``code``, the number of the word in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(words.value)
        for b in batches:
            code = [places.get(x, 1) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int32())], [*b.schema.names, "code"])

    return df.mapInArrow(run, StructType(list(df.schema.fields)).add("code", IntegerType()))
