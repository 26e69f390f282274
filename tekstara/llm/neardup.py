"""Near duplicates: SetSketch registers, banded; joint likelihood estimates; links confirmed on full sets; components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import load, map_arrow, mix, salted_join, settle, steps, tidy, windows, words

ROWS, BANDS = 4, 20
M = ROWS * BANDS
#: SetSketch parameters: base, rate, largest register value. A base near 1 makes registers as selective as MinHash values.
B, A, Q = 1.02, 20.0, 4000
#: Pairs whose estimate falls this far below the threshold aren't confirmed; over five standard errors with 80 registers.
SLACK = 0.25
#: Members of a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Blocks of a bucket that meet in one place.
CELL = 16
_ODD = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 54-bit shingle hashes of every row, and each row's first (one more entry). At most 1,024 rows."""
    h, row, _, _ = words(buf, off)
    g, first = windows(h, row, k)
    rows = len(off) - 1
    who = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    keys = np.sort((who << np.uint64(54)) | (g >> np.uint64(10)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    first = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(54)) if rows < 1024 else np.append(np.searchsorted(keys, np.arange(rows, dtype=np.uint64) << np.uint64(54)), len(keys))
    return keys & np.uint64((1 << 54) - 1), first


def registers(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16, M a row) of non-empty sets: floor(1 - log_b of the least of exponential variables), truncated."""
    x = mix(sets + _SALT)
    out, least = np.empty((len(first) - 1, M), np.uint16), np.empty_like(x)
    for i in range(M):
        np.multiply(x, _ODD[i], out=least)
        low = np.minimum.reduceat(least, first[:-1])
        e = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / A
        out[:, i] = np.clip(np.floor(1 - np.log(e) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 101) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood over how many registers are larger, smaller and equal, set sizes known."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (B - 1) / B) / np.log(B)
    more, less = p(u - v * j), p(v - u * j)
    like = up * np.log(more) + down * np.log(less) + (a.shape[1] - up - down) * np.log(np.clip(1 - more - less, 1e-9, 1))
    return j[np.arange(len(a)), like.argmax(1)]


def sketch(df: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, fingerprint of the set (null if empty) and registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, buf, off in steps(batch):
                sets, first = shingle_sets(buf, off, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                prints: list[bytes | None] = [None] * len(n)
                regs: list[bytes | None] = [None] * len(n)
                if len(full):
                    at = np.append(first[full], first[-1])
                    sums = [np.add.reduceat(mix(sets + np.uint64(s)), at[:-1]) for s in (1, 0x632BE59BD9B4E019)]
                    for i, f, r in zip(full, np.stack(sums, 1), registers(sets, at), strict=True):
                        prints[i], regs[i] = f.tobytes(), r.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "fp", "regs"])

    return map_arrow(df, run, f"id {dict(df.dtypes)['id']}, n long, fp binary, regs binary")


def full_sets(df: DataFrame, k: int) -> DataFrame:
    """id and its whole set, as sorted 64-bit values, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, buf, off in steps(batch):
                sets, first = shingle_sets(buf, off, k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sets[x:y].tobytes() for x, y in zip(first, first[1:], strict=False)], pa.binary())], names=["id", "items"])

    return map_arrow(df, run, f"id {dict(df.dtypes)['id']}, items binary")


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, M)


def likely(pairs: DataFrame, floor: float) -> DataFrame:
    """Of (a, b, na, nb, ra, rb) the pairs (a, b) whose estimate is at least ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                s = batch.slice(at, 2048)
                na, nb = (s.column(i).to_numpy().astype(float) for i in (2, 3))
                yield s.filter(pa.array(estimate(_regs(s.column(4)), _regs(s.column(5)), na, nb) >= floor)).select([0, 1])

    kind = dict(pairs.dtypes)["a"]
    return map_arrow(pairs.select("a", "b", "na", "nb", "ra", "rb"), run, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) the pairs with 100 * intersection >= percent * union on full sets. Pairs are settled, as they are counted first."""
    pairs = settle(pairs.select("a", "b"))
    of = lambda c: pairs.groupBy(c).agg(F.count("*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    kind = dict(pairs.dtypes)["a"]
    one, two = (sets.select(F.col("id").alias(c), F.col("items").alias(f"i{c}")) for c in "ab")
    return map_arrow(salted_join(salted_join(pairs, two, "b", counts=of("b")), one, "a", counts=of("a")).select("a", "b", "ia", "ib"), run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): each linked id with the least id it reaches. Rounds of least neighbour and pointer jumping, settled each round."""
    edges = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = settle(edges.groupBy("b").agg(F.count("*").alias("c")))
    labels = settle(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = salted_join(edges, labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b", counts=degrees).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("comp").alias("up"))
        new = settle(salted_join(settle(low), jump, "c", "left").select("id", "old", F.least("c", "up").alias("comp")))
        labels = new.select("id", "comp")
        if new.where("old <> comp").isEmpty():
            return labels


def _blocks(rows: DataFrame, cols: list[str], parts: str) -> DataFrame:
    """Members of buckets as arrays, dealt over as many blocks as column ``parts`` says."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col(parts)))
    return dealt.groupBy("key", "band", "block").agg(F.first("right_parts").alias("right_parts"), F.collect_list(F.struct(*cols)).alias("members"))


def sized(rows: DataFrame, item_bytes: int) -> DataFrame:
    """``rows`` (key, id, comp, n, ...) of buckets with several components: ``main`` is the bucket's largest component, and
    left_parts and right_parts say how many blocks the members outside it and all members need."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    size = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max(F.struct("c", "comp", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("k"))
    parts = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w * item_bytes / BLOCK_BYTES), F.lit(1))
    size = size.where("k > 1").select("key", "main", "c", parts(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("left_parts"), parts(F.col("c"), F.col("w")).alias("right_parts"))
    size = settle(size)
    return salted_join(rows, size.drop("c"), "key", counts=size.select("key", "c"))


def mixed(buckets: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame:
    """key, band, id, comp, n, regs, main and numbers of blocks of buckets with several components."""
    rows = buckets.join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(reps.select("id", "n").hint("merge"), "id")
    # registers come to what is left of the rows
    return settle(sized(rows.select("key", "band", "id", "comp", "n"), 8).join(reps.select("id", "regs").hint("merge"), "id"))


def meeting(rows: DataFrame, cols: list[str], fn, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """In each bucket the rows outside its largest component meet all of its rows, block by block: a block of theirs goes to each
    cell of CELL blocks of the bucket, so no task holds a bucket and a block is sent again only for every CELL * BLOCK rows.
    ``fn(key, band, x, y)`` takes two lists of members and returns ``columns``: (name, Arrow type, SQL type)."""
    keep = ["key", "band", "left_parts", "right_parts", *cols]
    left = _blocks(rows.where("comp <> main").select(*keep), cols, "left_parts")
    last = F.floor((F.col("right_parts") - 1) / CELL)
    left = left.select("key", "band", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("cell"), F.col("members").alias("x"))
    right = _blocks(rows.select(*keep), cols, "right_parts").select("key", "band", F.floor(F.col("block") / CELL).alias("cell"), F.col("members").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, band, x, y in zip(*batch.columns, strict=True):
                out = fn(key.as_py(), band.as_py(), x.as_py(), y.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(out, columns, strict=True)], names=[name for name, _, _ in columns])

    met = left.join(right.hint("merge"), ["key", "band", "cell"]).select("key", "band", "x", "y")
    return map_arrow(met, run, ", ".join(f"{name} {kind}" for name, _, kind in columns))


def candidates(m: dict, y: list[dict], regs: np.ndarray, n: np.ndarray, comp: np.ndarray, floor: float, percent: int, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, estimates) of rows of ``y`` in other components that may reach the threshold with ``m``.

    With ``band`` only those that share no earlier band, so that over all bands each pair comes once.
    """
    own = np.frombuffer(m["regs"], np.uint16)
    at = np.flatnonzero((comp != m["comp"]) & (100 * np.minimum(n, m["n"]) >= percent * np.maximum(n, m["n"])))
    same = regs[at] == own
    at, same = at[(keep := same.sum(1) >= (floor - 0.15) * M)], same[keep]
    if band is not None and len(at):
        at = at[same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
    if not len(at):
        return at, np.zeros(0)
    est = estimate(np.broadcast_to(own, (len(at), M)), regs[at], np.full(len(at), float(m["n"])), n[at])
    return at[est >= floor], est[est >= floor]


def _columns(y: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(m["regs"] for m in y), np.uint16).reshape(-1, M), np.array([m["n"] for m in y], float), np.array([m["comp"] for m in y], object)


def likeliest(rows: DataFrame, kind: tuple, floor: float, percent: int) -> DataFrame:
    """(a, b): each row outside its bucket's main component with its likeliest partner of another component in each block."""

    def fn(key, band: int, x: list[dict], y: list[dict]) -> list[list]:
        a, b, cols = [], [], _columns(y)
        for m in x:
            at, est = candidates(m, y, *cols, floor, percent)
            if len(at):
                a.append(m["id"])
                b.append(y[at[est.argmax()]]["id"])
        return [a, b]

    out = meeting(rows, ["id", "comp", "n", "regs"], fn, [("a", *kind), ("b", *kind)])
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining(rows: DataFrame, sets: DataFrame, kind: tuple, floor: float, percent: int) -> DataFrame:
    """(a, b): links between different components among all pairs that share a band and that registers don't rule out.

    First the members of each bucket that are in such a pair are found from registers, then their sets are brought together
    and pairs are confirmed where they meet, each in its first shared band. A pair that isn't a link never becomes a row, and
    one link joins a row to a component of the block.
    """

    def needed(key, band: int, x: list[dict], y: list[dict]) -> list[list]:
        ids, cols = {}, _columns(y)
        for m in x:
            at, _ = candidates(m, y, *cols, floor, percent, band)
            if len(at):
                ids[m["id"]] = None
                ids |= dict.fromkeys(y[i]["id"] for i in at)
        return [[key] * len(ids), list(ids)]

    use = meeting(rows, ["id", "comp", "n", "regs"], needed, [("key", pa.int64(), "bigint"), ("id", *kind)]).distinct()
    full = rows.join(settle(use).hint("merge"), ["key", "id"]).join(sets.hint("merge"), "id")

    def linked(key, band: int, x: list[dict], y: list[dict]) -> list[list]:
        a, b, cols = [], [], _columns(y)
        items = [np.frombuffer(m["items"], np.uint64) for m in y]
        for m in x:
            at, est = candidates(m, y, *cols, floor, percent, band)
            own, done = np.frombuffer(m["items"], np.uint64), set()
            for i in at[np.argsort(-est)]:
                if y[i]["comp"] in done:
                    continue
                both = np.sort(np.concatenate([own, items[i]]))
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(both) - same):
                    a.append(m["id"])
                    b.append(y[i]["id"])
                    done.add(y[i]["comp"])
        return [a, b]

    out = meeting(full, ["id", "comp", "n", "regs", "items"], linked, [("a", *kind), ("b", *kind)])
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@tidy
def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: n_shingles, component_id (least id reachable over links) and kept (the id is that).

    A row's set is its distinct k-word shingles; fewer words give one shingle of them all; a null or empty text gives an empty
    set, linked with nothing. Equal sets are one class, so copies cost no pairs. Class representatives that share a band of
    registers are candidates: each bucket's members with its least id, then members of different components with each other,
    first the likeliest, then all, without a row for a pair that is no link. Every link is confirmed on full sets. Repeated rows of an id are one document; rows with a
    null id are in no class and have a null component. An empty table gives an empty result.
    """
    floor = percent / 100 - SLACK
    docs = df.select(df[id_col].alias("id"), df[text].alias("text"))
    base = settle(sketch(docs, k))
    some = base.where("fp is not null and id is not null")
    classes = settle(some.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("c")))
    own = some.join(classes.select("fp", F.col("rep").alias("id")), ["fp", "id"]).groupBy("id").agg(F.max(F.struct("n", "regs")).alias("s"))
    reps = settle(own.select("id", "s.n", "s.regs"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keys = reps.select("id", F.posexplode(bands).alias("band", "key"))
    shared = settle(keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1"))
    buckets = settle(salted_join(keys, shared.drop("c"), "key", counts=shared.select("key", "c")).select("key", "band", "id", "lead"))
    # settled, so that their size is known before the texts would be shuffled to meet them
    ids = settle(buckets.select("id").distinct())
    # a repeated id has one text here: that with the most shingles
    sets = settle(full_sets(docs.join(ids, "id", "left_semi"), k).groupBy("id").agg(F.max(F.struct(F.length("items"), "items"))["items"].alias("items")))

    def with_regs(pairs: DataFrame) -> DataFrame:
        a, b = (reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}")) for c in "ab")
        return salted_join(pairs, a, "a").join(b.hint("merge"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    stars = settle(buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = settle(confirmed(likely(with_regs(stars), floor), sets, percent))
    comps = components(links)
    members, kind = buckets.select("key", "band", "id"), (to_arrow_type(reps.schema["id"].dataType), dict(reps.dtypes)["id"])
    for last in (False, True):
        rows = mixed(members, reps, comps)
        more = settle(remaining(rows, sets, kind, floor, percent) if last else confirmed(likeliest(rows, kind, floor, percent), sets, percent))
        if not more.isEmpty():
            links = settle(links.union(more))
            comps = components(links)
    # back to all rows by fingerprint
    named = classes.select("fp", "rep").join(comps, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("comp", "rep").alias("component"))
    out = salted_join(base.select("id", "n", "fp"), named, "fp", "left", counts=classes.select("fp", "c"))
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
