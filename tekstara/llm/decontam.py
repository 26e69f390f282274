"""Benchmark decontamination: a BM25 index of test items, block-max WAND over every training passage, overlap verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import load, map_arrow, settle, steps, windows, words

K1, B = 1.2, 0.75
SHINGLE, OVERLAP = 5, 0.8
#: Items of a block; bytes of item text in one index. A larger test set is met in several indexes, one after the other.
BLOCK, INDEX_BYTES = 4, 16 << 20
#: The lightest terms of a block, up to this share of its least threshold, name no passage by themselves.
LIGHT = 0.2
#: Entries of block lists that are looked at in one step.
ENTRIES = 4_000_000
FILTER_BITS = 20


def halves(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the question's and the answer's words: up to and after the word that holds the last question mark. Without one
    all is question."""
    b = text.encode("utf-8", "replace")
    h, _, start, _ = words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    at = b.rfind(b"?")
    n = len(h) if at < 0 else int(np.searchsorted(start, at, "right"))
    return h[:n], h[n:]


def hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words(b, np.array([0, len(b)]))[0]


def shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(windows(h, np.array([0, len(h)]), SHINGLE)[0])


@dataclass
class Stats:
    """What BM25 weights take from the whole test set, however many indexes it is split into."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n: int = 0
    size: int = 0
    span: int = 1

    def add(self, texts: list[str]) -> None:
        own = [h for h in map(hashes, texts) if len(h)]
        self.n += len(own)
        self.size += sum(map(len, own))
        self.span = max([self.span, *map(len, own)])
        terms, at = np.unique(np.concatenate([self.terms, *map(np.unique, own)]), return_inverse=True)
        self.df = np.bincount(at, np.concatenate([self.df, np.ones(len(at) - len(self.df), np.int64)]), minlength=len(terms)).astype(np.int64)
        self.terms = terms

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    """Postings by block of items and term with the largest weights of blocks, and lists of blocks by term for their maxima."""

    ids: list
    terms: np.ndarray
    #: for each block, term number to (items, weights, largest weight)
    blocks: list[dict[int, tuple[list[int], list[float], float]]]
    #: least threshold of each block's items, and what of it the block's listed terms must bring
    least: np.ndarray
    listed: np.ndarray
    #: by term: its first entry, and the entries' blocks and largest weights
    first: np.ndarray
    of_block: np.ndarray
    of_weight: np.ndarray
    need: np.ndarray
    full: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    span: int
    widths: list[tuple[int, int]] = field(default_factory=list)
    maybe: np.ndarray = field(repr=False, default_factory=lambda: np.zeros(0, bool))

    @staticmethod
    def build(rows: list[tuple], stats: Stats | None = None) -> Index:
        """rows: (id, text); items without words take no part.

        An item's threshold is the least score that a passage with enough of its shingles can have: the item's own score less
        its heaviest terms, as many as there are shingles that may be missing, since a term is only lost with a shingle of it.
        A block's lightest terms, whose largest weights sum to no more than LIGHT of its least threshold, aren't listed: the
        others must bring the rest.
        """
        if stats is None:
            stats = Stats()
            stats.add([t for _, t in rows])
        docs = [(i, hashes(t), *halves(t)) for i, t in rows]
        docs = [d for d in docs if len(d[1])]
        n = len(docs)
        size = np.array([len(d[1]) for d in docs], float)
        mean = stats.size / max(stats.n, 1) or 1.0
        tf = [np.unique(d[1], return_counts=True) for d in docs]
        terms = np.unique(np.concatenate([t for t, _ in tf])) if n else np.zeros(0, np.uint64)
        idf = stats.idf(terms)
        blocks: list[dict] = [{} for _ in range(-(-n // BLOCK))]
        full, need = np.zeros(n), np.zeros(n)
        question, answer, widths = [], [], []
        for k, (t, c) in enumerate(tf):
            at = np.searchsorted(terms, t)
            w = idf[at] * c * (K1 + 1) / (c + K1 * (1 - B + B * size[k] / mean))
            for j, x in zip(at.tolist(), w.tolist(), strict=True):
                held = blocks[k // BLOCK].get(j, ([], [], 0.0))
                blocks[k // BLOCK][j] = ([*held[0], k], [*held[1], x], max(held[2], x))
            q, a = docs[k][2:]
            widths.append(tuple(min(SHINGLE, max(1, len(x))) for x in (q, a)))
            question.append(shingles(q))
            answer.append(shingles(a))
            lost = int((1 - OVERLAP) * len(question[k]) + 1e-9) + int((1 - OVERLAP) * len(answer[k]) + 1e-9)
            full[k] = w.sum()
            need[k] = full[k] - np.sort(w)[::-1][:lost].sum()
        sure = 1 - 1e-6
        least = np.array([need[i : i + BLOCK].min() for i in range(0, n, BLOCK)]) * sure
        listed, entries = least.copy(), []
        for b, held in enumerate(blocks):
            for top, j in sorted((x[2], j) for j, x in held.items()):
                if not entries or entries[-1][1] != b:  # only lighter terms so far
                    if least[b] - listed[b] + top <= LIGHT * least[b]:
                        listed[b] -= top
                        continue
                entries.append((j, b, top))
        entries.sort()
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[(terms >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return Index(
            [d[0] for d in docs], terms, blocks, least, listed * sure, np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(len(terms) + 1)),
            np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries]), need * sure, full, question, answer, stats.span, widths, maybe,
        )

    def wand(self, query: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items of ``blocks`` that reach their thresholds, item at a time.

        ``query``: distinct term numbers. A block whose largest weights don't sum to its least threshold is passed over. In a
        block, lists stand in order of their current items; the pivot is the first list at which the summed bounds reach the
        threshold; lists before it skip to its item.
        """
        out = []
        for b in blocks:
            held, floor = self.blocks[b], self.least[b]
            lists = [[0, *held[t]] for t in query if t in held]
            if sum(x[3] for x in lists) < floor:
                continue
            while lists:
                lists.sort(key=lambda x: x[1][x[0]])
                bound, pivot = 0.0, -1
                for p, x in enumerate(lists):
                    bound += x[3]
                    if bound >= floor:
                        pivot = p
                        break
                if pivot < 0:
                    break
                item = lists[pivot][1][lists[pivot][0]]
                if lists[0][1][lists[0][0]] == item:
                    here = [x for x in lists if x[1][x[0]] == item]
                    score = sum(x[2][x[0]] for x in here)
                    if score >= self.need[item]:
                        out.append((item, score))
                    goal = item + 1
                else:
                    here, goal = lists[:pivot], item
                for x in here:
                    while x[0] < len(x[1]) and x[1][x[0]] < goal:
                        x[0] += 1
                lists = [x for x in lists if x[0] < len(x[1])]
        return out

    def search(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, float, float, float | None]]:
        """(row, item, score share, question overlap, answer overlap) for items verified in rows, given the rows' word hashes.

        Passages are two strides long and start at every stride, of one and a half times the longest item's words, so an
        occurrence of an item lies whole in a passage.
        """
        if not self.ids or not len(h):
            return []
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        t = np.searchsorted(self.terms, h[hit])
        good = self.terms[np.minimum(t, len(self.terms) - 1)] == h[hit]
        hit, t = hit[good], t[good]
        stride = max(8, int(1.5 * self.span))
        n = np.diff(row)
        strides = np.maximum(-(-n // stride), 1)
        base = np.concatenate([[0], np.cumsum(strides)])
        owner = np.searchsorted(row, hit, "right") - 1
        cell = base[owner] + (hit - row[owner]) // stride
        # distinct terms of each passage; a stride is in the passage that starts with it and in the one before
        starts = np.zeros(base[-1] + 1, bool)
        starts[base[:-1]] = True
        inner = np.flatnonzero(~starts[cell])
        seen = np.unique(np.concatenate([cell, cell[inner] - 1]) * len(self.terms) + np.concatenate([t, t[inner]]))
        live, blocks = self.bounded(seen // len(self.terms), seen % len(self.terms))
        if not len(live):
            return []
        at = np.searchsorted(seen, np.concatenate([live, live + 1]) * len(self.terms)).reshape(2, -1)
        of = np.searchsorted(base, live, "right") - 1
        best: dict[tuple[int, int], tuple[float, float, float | None]] = {}
        for c, r, lo, hi, block in zip(live, of, *at, blocks, strict=True):
            found = self.wand((seen[lo:hi] % len(self.terms)).tolist(), [int(block)])
            if not found:
                continue
            lo = row[r] + (c - base[r]) * stride
            have = np.unique(windows(h[lo : min(lo + 2 * stride, row[r + 1])], np.array([0, min(lo + 2 * stride, row[r + 1]) - lo]), SHINGLE)[0])
            for item, score in found:
                got = self.verify(item, h[lo : min(lo + 2 * stride, row[r + 1])], have)
                if got:
                    key, new = (int(r), item), (score / self.full[item], *got)
                    best[key] = max(best[key], new, key=lambda x: (x[1], x[0])) if key in best else new
        return [(r, i, *x) for (r, i), x in best.items()]

    def bounded(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) of all pairs in which the largest weights of a passage's listed terms reach what the block needs."""
        many = self.first[term + 1] - self.first[term]
        out = [np.zeros((2, 0), np.int64)]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(term):  # whole passages, up to ENTRIES entries of lists in one step or one passage
            done = ends[lo] - many[lo]
            hi = max(int(np.searchsorted(ends, done + ENTRIES, "right")), lo + 1)
            if hi < len(term):
                back = int(np.searchsorted(passage, passage[hi]))
                hi = back if back > lo else int(np.searchsorted(passage, passage[lo], "right"))
            own = many[lo:hi]
            hits = np.repeat(np.arange(lo, hi), own)
            entry = np.arange(len(hits)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.first[term[lo:hi]], own)
            pair, at = np.unique((passage[hits] - passage[lo]) * len(self.blocks) + self.of_block[entry], return_inverse=True)
            good = pair[np.bincount(at, self.of_weight[entry], minlength=len(pair)) >= self.listed[pair % len(self.blocks)]]
            out.append(np.stack([good // len(self.blocks) + passage[lo], good % len(self.blocks)]))
            lo = hi
        return tuple(np.concatenate(out, 1))  # type: ignore[return-value]

    def verify(self, item: int, h: np.ndarray, have: np.ndarray) -> tuple[float, float | None] | None:
        """Shares of the question's and the answer's shingles in a passage, if both reach OVERLAP. An item part of under five words is one shingle."""

        def share(own: np.ndarray, k: int) -> float:
            pool = have if k == SHINGLE else np.unique(windows(h, np.array([0, len(h)]), k)[0])
            return float(np.isin(own, pool).mean())

        q = share(self.question[item], self.widths[item][0]) if len(self.question[item]) else 1.0
        if q < OVERLAP:
            return None
        if not len(self.answer[item]):
            return q, None
        a = share(self.answer[item], self.widths[item][1])
        return (q, a) if a >= OVERLAP else None


def leaks(df: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per row of ``df`` and test item found in it: id, item id, score (share of the item's own BM25 score), overlaps.

    Every passage of every text is a query; every item at or above its threshold is verified: at least 0.8 of the five-word
    shingles of its question, and of its answer if it has one, occur in the passage (lower-cased A-Z, white space alone
    separates words). Null or empty texts and items match nothing; repeated rows are found once each; empty tables give an
    empty result. Weights come from all items. An index holds at most INDEX_BYTES of item text; beyond that the texts are read
    once for each index, and what one finds is settled before the next is broadcast. Columns of other names are ignored.
    """
    docs = df.select(df[id_col].alias("id"), df[text].alias("text"))
    named = items.select(items[item_id].alias("i"), items[item_text].alias("t"))
    id_type, item_type = docs.dtypes[0][1], named.dtypes[0][1]
    kind = to_arrow_type(named.schema["i"].dataType)

    def found_by(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, names = held.value
            for batch in batches:
                for b, buf, off in steps(batch):
                    h, row, _, _ = words(buf, off)
                    got = sorted(ix.search(h, row), key=lambda g: g[:2])
                    cols = [b.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([names[ix.ids[g[1]]] for g in got], kind)]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array([g[k] for g in got], pa.float64()) for k in (2, 3, 4)], names=["id", "item", "score", "q", "a"])

        return map_arrow(docs, run, f"id {id_type}, item {item_type}, score double, q double, a double")

    both = reduce(DataFrame.unionByName, one_by_one(named, found_by, []))
    return both.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "score", F.col("q").alias("question_overlap"), F.col("a").alias("answer_overlap"))


def one_by_one(named: DataFrame, use: Callable[[Broadcast], DataFrame], out: list[DataFrame]) -> list[DataFrame]:
    """``out`` and after it ``use`` of each broadcast (index, item ids) over rows (i, t): of a single one as it is, of several settled, so that one
    index is held at a time. A table of no items gives one empty index."""
    rows = named.where("t is not null").orderBy("i", "t")
    stats, groups = Stats(), 0
    for group in groups_of(rows):
        stats.add([t for _, t in group])
        groups += 1
    for group in groups_of(rows) if groups else [[]]:
        index = Index.build([(k, t) for k, (_, t) in enumerate(group)], stats)  # ids may repeat
        held = named.sparkSession.sparkContext.broadcast((index, [i for i, _ in group]))
        out.append(use(held) if groups < 2 else settle(use(held)))
        if groups > 1:
            held.destroy()
    return out


def groups_of(rows: DataFrame) -> Iterator[list[tuple]]:
    """Rows (i, t) in lists of up to INDEX_BYTES of text."""
    group: list[tuple] = []
    size = 0
    for r in rows.toLocalIterator():
        group.append((r["i"], r["t"]))
        size += len(r["t"].encode("utf-8", "replace"))
        if size >= INDEX_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def without_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``df``, all columns, in whose texts ``leaks`` finds no item. Null and empty texts stay, repeated rows too."""

    left = [df]

    def use(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, _ = held.value
            for batch in batches:
                for b, buf, off in steps(batch, text):
                    h, row, _, _ = words(buf, off)
                    bad = [g[0] for g in ix.search(h, row)]
                    keep = np.ones(b.num_rows, bool)
                    keep[bad] = False
                    yield b.filter(pa.array(keep))

        return left[-1].mapInArrow(run, df.schema)

    named = items.select(items[item_id].alias("i"), items[item_text].alias("t"))
    one_by_one(named, use, left)
    return left[-1]


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
