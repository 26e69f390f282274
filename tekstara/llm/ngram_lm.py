"""Language-model scoring: an Elias-Fano n-gram trie in memory-mapped levels with quantised smoothed probabilities.

Level 1 is the vocabulary: word hashes in order, as Elias-Fano sequences over hash ranges; a word's id is its place. A node of
level 2 is a word after a context of one word (or the begin of a text), a node of level 3 a word after a node of level 2. A
level holds its nodes by context, then by word id, in shards. A node's value is its word id relative to its context's base
(context times the vocabulary's size), so a shard is one increasing sequence. Monotone pointers, again Elias-Fano, give the
place of each context's first successor: a query takes its context's range from them and looks in that range for the least
value not below the word's (``Level.find``). Where it is equal, its place is the context for the next level.

Probabilities are smoothed with a Dirichlet prior whose mean is the next lower level's stored probability, and stored as 8-bit
codes. A word that isn't seen after its context gets the lower level's probability times the prior's share of that context,
which level 2 stores with 16 bits for the contexts of level 3.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, load, map_arrow, shared_dir, steps, tidy, words

#: Hash of the end token; a word whose hash is this one counts as it.
END = np.uint64(0x9D5C2F1B7A3E4C61)
MU = 200.0
#: Codes of probabilities are steps of 0.05 in log10, codes of the prior's share steps of 0.0002.
CODE, SHARE = 0.05, 0.0002
FLUSH = 3_000_000
#: Tokens whose keys a shard of level 2 or 3 holds.
SHARD = 4_000_000
STEP = 4 << 20
#: Words of high bits in a block; each block stores how many zeros stand before it.
BLOCK_WORDS = 4
_ALL = np.uint64((1 << 64) - 1)
U = np.uint64


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; Hadoop's names of the S3 scheme are Arrow's s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def put(uri: str, name: str, data: bytes) -> None:
    """Write a whole file, then give it its name: a repeated task writes the same file again."""
    if urlparse(uri).scheme in ("", "file"):
        at = urlparse(uri).path
        os.makedirs(at, exist_ok=True)
        with open(tmp := f"{at}/.{name}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(tmp, f"{at}/{name}")
        return
    fs, at = store(uri)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(tmp := f"{at}/.{name}.{uuid.uuid4().hex}") as f:
        f.write(data)
    fs.move(tmp, f"{at}/{name}")


def mapped(uri: str, name: str) -> np.ndarray:
    """The file's bytes, memory-mapped. From a store without local paths it is fetched to an unlinked local file first."""
    if urlparse(uri).scheme in ("", "file"):
        return np.asarray(np.memmap(f"{urlparse(uri).path}/{name}", np.uint8, "r"))
    fs, at = store(uri)
    with fs.open_input_stream(f"{at}/{name}") as f, tempfile.NamedTemporaryFile() as local:
        while chunk := f.read(8 << 20):
            local.write(chunk)
        local.flush()
        return np.asarray(np.memmap(local.name, np.uint8, "r"))


_BYTES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], U).ravel()


def select(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, which must have it: the byte by running counts, then a table."""
    x = bits - ((bits >> U(1)) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + ((x >> U(2)) & U(0x3333333333333333))
    x = ((x + (x >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _BYTES
    # a byte's top bit stays where no more than k ones stand in it and below
    place = np.bitwise_count(((k * _BYTES | _TOPS) - x) & _TOPS).astype(U) << U(3)
    k = k - (((x << U(8)) >> place) & U(255))
    return place + _IN_BYTE[((((bits >> place) & U(255)) << U(3)) + k).astype(np.int64)]


class EliasFano:
    """A non-decreasing uint64 sequence: low bits packed, high bits unary, zeros counted before each block of high bits."""

    def __init__(self, n: int, base: int, low_bits: int, top: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.base, self.l, self.top, self.low, self.high, self.zeros = n, base, low_bits, top, low, high, zeros
        self.ones: np.ndarray | None = None

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n = len(values)
        base = int(values[0]) if n else 0
        v = values - U(base)
        span = int(v[-1]) + 1 if n else 1
        l = max(0, (span // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * l + 63) // 64 + 2, U)
        if l:
            part = v & U((1 << l) - 1)
            for j in range(64):  # the j-th of every 64 values starts at the same bit of a group of l words
                own = part[j::64]
                word, shift = divmod(j * l, 64)
                at = np.arange(len(own)) * l + word
                low[at] |= own << U(shift)
                if shift + l > 64:
                    low[at + 1] |= own >> U(64 - shift)
        up = (v >> U(l)).astype(np.int64)
        top = int(up[-1]) if n else 0
        size = n + top + 2
        block = 64 * BLOCK_WORDS
        bits = np.zeros((size + block) // block * block, np.uint8)
        bits[up + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        ones = np.bitwise_count(high).reshape(-1, BLOCK_WORDS).sum(1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(block - ones)[:-1]]).astype(U)
        return EliasFano(n, base, l, top, low, high, zeros)

    def pack(self) -> bytes:
        head = np.array([self.n, self.base, self.l, self.top, len(self.low), len(self.high), len(self.zeros)], U)
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.zeros))

    @staticmethod
    def view(data: np.ndarray) -> tuple[EliasFano, int]:
        """The sequence at the start of a mapped file, and where it ends."""
        n, base, l, top, a, b, c = map(int, data[:56].view(U))
        w = data[56 : 56 + 8 * (a + b + c)].view(U)
        return EliasFano(n, base, l, top, w[:a], w[a : a + b], w[a + b :]), 56 + 8 * (a + b + c)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits."""
        return self._nth(k, self.zeros, _ALL)

    def _nth(self, k: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Place of the k-th one of the high bits after ``flip``, of which ``before`` stand before each block."""
        k = k.astype(U)
        block = np.searchsorted(before, k, "right") - 1
        left = k - before[block]
        word = block * BLOCK_WORDS
        bits = self.high[word] ^ flip
        count = np.bitwise_count(bits).astype(U)
        todo = np.flatnonzero(left >= count)
        while len(todo):  # fewer than BLOCK_WORDS times
            left[todo] -= count[todo]
            word[todo] += 1
            bits[todo] = self.high[word[todo]] ^ flip
            count[todo] = np.bitwise_count(bits[todo])
            todo = todo[left[todo] >= count[todo]]
        return (word.astype(U) << U(6)) + select(bits, left)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.l)
        w, s = (bit >> U(6)).astype(np.int64), bit & U(63)
        over = np.where(s > 0, self.low[w + 1] << ((U(64) - s) & U(63)), U(0))
        return ((self.low[w] >> s) | over) & U((1 << self.l) - 1)

    def seek(self, values: np.ndarray, a: np.ndarray | int = 0, b: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Successor search in places [a, b) of each value (none: all): place of the first element not below it, b if there is
        none, and whether it equals it. Values in order are found faster, as neighbours share memory."""
        n = len(values)
        end = np.full(n, self.n if b is None else b, np.int64)
        out, same = end.copy(), np.zeros(n, bool)
        lo = np.full(n, a, np.int64)
        early = values < U(self.base)
        v = np.where(early, U(0), values - U(self.base))
        up = v >> U(self.l)
        at = np.flatnonzero(~early & (up <= U(self.top)) & (lo < end))
        out[early] = lo[early]
        if not len(at):
            return out, same
        u, want = up[at], v[at] & U((1 << self.l) - 1)
        # the first place whose high part is not below the value's own
        i = np.zeros(len(at), np.int64)
        later = np.flatnonzero(u > 0)
        i[later] = (self._zero(u[later] - U(1)) + U(1) - u[later]).astype(np.int64)
        i = np.maximum(i, lo[at])
        # whether a place holds an element with that high part: its bit is set
        spot = i + u.astype(np.int64)
        live = np.flatnonzero((i < end[at]) & ((self.high[spot >> 6] >> (spot & 63).astype(U)) & U(1) == 1))
        low = self._low(i[live])
        hit = low == want[live]
        same[at[live[hit]]] = True
        live = live[low < want[live]]
        if len(live):  # a longer run: a binary search of its low bits
            stop = np.minimum((self._zero(u[live]) - u[live]).astype(np.int64), end[at[live]])
            x, y, w = i[live] + 1, stop.copy(), want[live]
            todo = np.flatnonzero(x < y)
            while len(todo):
                mid = (x[todo] + y[todo]) >> 1
                below = self._low(mid) < w[todo]
                x[todo] = np.where(below, mid + 1, x[todo])
                y[todo] = np.where(below, y[todo], mid)
                todo = todo[x[todo] < y[todo]]
            inside = np.flatnonzero(x < stop)
            same[at[live[inside]]] = self._low(x[inside]) == w[inside]
            i[live] = x
        out[at] = np.minimum(i, end[at])
        return out, same

    def at(self, i: np.ndarray) -> np.ndarray:
        """The elements at places ``i``."""
        if self.ones is None:
            self.ones = np.arange(len(self.zeros), dtype=U) * U(64 * BLOCK_WORDS) - self.zeros
        return ((self._nth(i, self.ones, U(0)) - i.astype(U)) << U(self.l)) + self._low(i) + U(self.base)

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at places ``i`` and at the places after them: the next one of the high bits needs no second search."""
        if self.ones is None:
            self.at(i[:1])
        spot = self._nth(i, self.ones, U(0))
        word = (spot >> U(6)).astype(np.int64)
        rest = self.high[word] & (_ALL << (spot & U(63))) & ~(U(1) << (spot & U(63)))
        todo = np.flatnonzero(rest == 0)
        while len(todo):
            word[todo] += 1
            rest[todo] = self.high[word[todo]]
            todo = todo[rest[todo] == 0]
        after = (word.astype(U) << U(6)) + np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(U)
        element = lambda spot, i: ((spot - i.astype(U)) << U(self.l)) + self._low(i) + U(self.base)
        return element(spot, i), element(after, i + 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(U) << U(self.l)) + self._low(np.arange(self.n)) + U(self.base)


def squeeze(x: np.ndarray) -> bytes:
    """Increasing or small values as zstd over byte planes of differences."""
    d = np.diff(x, prepend=U(0)).astype(U)
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(U).ravel(), dtype=U)


def tally(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys) if keys else np.zeros(0, U)
    if counts is None:
        k.sort()
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return k[at], np.diff(np.append(at, len(k))).astype(U)
    c = np.concatenate(counts) if counts else np.zeros(0, U)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def counted(docs: DataFrame, grams, cuts: np.ndarray, build, schema: str) -> list:
    """Count 64-bit keys of all documents and hand each range of keys, sorted and summed, to ``build`` in one task.

    ``grams(batch)`` yields arrays of keys. Tasks sum what they hold before they send it, as compressed sorted blocks; ``cuts``
    are the first keys of ranges 1.. . Rows of build's results come back to the driver: a few numbers for each range.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, c = tally(held)
            at = np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]])
            rows = [(p, squeeze(k[a:b]), squeeze(c[a:b])) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

        for batch in batches:
            for k in grams(batch):
                held.append(k)
                size += len(k)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def receive(pdf):
        k: np.ndarray = np.zeros(0, U)
        c = np.zeros(0, U)
        ks, cs, more = [], [], 0
        for a, b in zip(pdf["keys"], pdf["counts"], strict=True):
            ks.append(unsqueeze(a))
            cs.append(unsqueeze(b))
            more += len(ks[-1])
            if more >= max(len(k), 1 << 20):  # so that each key is sorted few times, however many blocks there are
                k, c = tally([k, *ks], [c, *cs])
                ks, cs, more = [], [], 0
        if more:
            k, c = tally([k, *ks], [c, *cs])
        return pd.DataFrame([build(int(pdf["part"].iloc[0]), k, c)])

    # a fixed number of tasks, which adaptive execution doesn't merge: what one reads doesn't grow with the table
    sent = map_arrow(docs, send, "part int, keys binary, counts binary").repartition(2 * (len(cuts) + 1), "part")
    return sorted(sent.groupBy("part").applyInPandas(receive, schema).collect(), key=lambda r: r["part"])


def ids_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words, with the end token after them, and each row's first token (one more entry)."""
    h, row, _, _ = words(buf, off)
    n = len(off) - 1
    first = row + np.arange(n + 1)
    out = np.full(len(h) + n, END, U)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = h
    return out, first


def once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them."""
    code, some = pd.factorize(keys)
    order = np.argsort(some)
    place = np.empty(len(some), np.int64)
    place[order] = np.arange(len(some))
    return some[order], place[code]


class Level:
    """A shard of level 2 or 3: the nodes from ``first`` on, those of contexts ``low`` to ``low + pointers.n - 2``."""

    def __init__(self, data: np.ndarray, first: int, low: int, size: int, shares: bool) -> None:
        self.first, self.low, self.size = first, low, size
        self.nodes, end = EliasFano.view(data)
        self.pointers, more = EliasFano.view(data[end:])
        self.codes = data[end + more : end + more + self.nodes.n]
        at = end + more + -(-self.nodes.n // 8) * 8
        self.shares = data[at : at + 2 * self.nodes.n].view(np.uint16) if shares else None

    @staticmethod
    def pack(keys: np.ndarray, size: int, codes: np.ndarray, shares: np.ndarray | None = None) -> bytes:
        ctx = (keys // U(size)).astype(np.int64)
        low = int(ctx[0])
        pointers = np.concatenate([[0], np.cumsum(np.bincount(ctx - low))]).astype(U)
        parts = [EliasFano.build(keys).pack(), EliasFano.build(pointers).pack(), codes.tobytes(), bytes(-len(keys) % 8)]
        return b"".join(parts + ([shares.tobytes()] if shares is not None else []))

    def ranges(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of contexts of this shard begin and end, by the pointers."""
        a, b = self.pointers.pairs(ctx - self.low)
        return a.astype(np.int64), b.astype(np.int64)

    def find(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in this shard of words after contexts, both in order, and whether they are there."""
        new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
        heads = np.flatnonzero(new)
        a, b = self.ranges(ctx[heads])
        runs = np.diff(np.append(heads, len(ctx)))
        return self.nodes.seek(ctx.astype(U) * U(self.size) + word.astype(U), np.repeat(a, runs), np.repeat(b, runs))


class Model:
    """The trie's files; arrays are mapped on first use in a process."""

    def __init__(self, uri: str, vocab: list, levels: list[list], total: int, docs: int, mu: float, order: int) -> None:
        self.uri, self.total, self.docs, self.mu, self.order = uri, total, docs, mu, order
        self.vocab_parts = [(r["part"], r["n"], r["low"]) for r in vocab if r["n"]]
        self.level_parts = [[(r["part"], r["n"], r["low"]) for r in rows if r["n"]] for rows in levels]
        self.size = sum(r["n"] for r in vocab)

    def open(self) -> Model:
        self.vocab, at = [], 0
        for part, n, _ in self.vocab_parts:
            data = mapped(self.uri, f"vocab-{part}")
            seq, end = EliasFano.view(data)
            self.vocab.append((at, seq, data[end:].view(U)))
            at += n
        self.vocab_low = np.array([int(x[2]) for x in self.vocab_parts], U)
        self.levels: list[list[Level]] = []
        self.lows: list[np.ndarray] = []
        for k, parts in enumerate(self.level_parts, 2):
            own, at = [], 0
            for part, n, low in parts:
                own.append(Level(mapped(self.uri, f"level{k}-{part}"), at, int(low) // self.size, self.size, k < self.order))
                at += n
            self.levels.append(own)
            self.lows.append(np.array([int(x[2]) for x in parts], U))
        return self

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and counts of hashes."""
        some, at = once(h)
        ids, count = np.full(len(some), -1, np.int64), np.zeros(len(some), U)
        cut = np.append(np.searchsorted(some, self.vocab_low), len(some))
        for (base, seq, counts), a, b in zip(self.vocab, cut, cut[1:], strict=False):
            if b > a:
                i, same = seq.seek(some[a:b])
                own = a + np.flatnonzero(same)
                ids[own], count[own] = i[same] + base, counts[i[same]]
        return ids[at], count[at]

    def find(self, k: int, ctx: np.ndarray, word: np.ndarray, want: str = "codes") -> tuple[np.ndarray, np.ndarray]:
        """Of nodes of level ``k``: places (-1: not there) and their codes (or shares)."""
        place, got = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx), np.uint16)
        if not len(ctx) or len(self.levels) < k - 1 or not self.levels[k - 2]:
            return place, got
        some, at = once(ctx.astype(U) * U(self.size) + word.astype(U))
        of, out = np.full(len(some), -1, np.int64), np.zeros(len(some), np.uint16)
        cut = np.append(np.searchsorted(some, self.lows[k - 2]), len(some))
        for part, a, b in zip(self.levels[k - 2], cut, cut[1:], strict=False):
            c = (some[a:b] // U(self.size)).astype(np.int64)
            # keys behind the shard's last context are in no shard
            b = a + int(np.searchsorted(c, part.low + part.pointers.n - 1))
            if b > a:
                i, same = part.find(c[: b - a], (some[a:b] % U(self.size)).astype(np.int64))
                own = a + np.flatnonzero(same)
                of[own] = i[same] + part.first
                out[own] = (part.codes if want == "codes" else part.shares)[i[same]]
        return of[at], out[at]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count.astype(float) + 0.1) / (self.total + 0.1 * (self.size + 1))

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each token's context of one word: the id before it, the vocabulary's size at the begin of a text."""
        ctx = np.concatenate([[0], ids[:-1]])
        ctx[first[:-1]] = self.size
        return ctx

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each row: tokens, known tokens, base score, score."""
        h, first = ids_of(buf, off)
        ids, count = self.look_up(h)
        base = np.log10(self.unigram(count))
        ctx = self.contexts(ids, first)
        n_ctx = np.concatenate([[0], count[:-1]]).astype(float)
        n_ctx[first[:-1]] = self.docs
        logp = base + np.log10(self.mu / (n_ctx + self.mu))
        both = np.flatnonzero((ids >= 0) & (ctx >= 0))
        place = np.full(len(h), -1, np.int64)
        place[both], codes = self.find(2, ctx[both], ids[both])
        seen = place >= 0
        logp[both] = np.where(seen[both], codes * -CODE, logp[both])
        if self.order > 2 and len(h):
            # contexts of two words that the training texts hold; a text's first word has none
            before = np.concatenate([[-1], place[:-1]])
            before[first[:-1]] = -1
            two = np.flatnonzero(before >= 0)
            logp[two] -= self.shares_of(before[two]) * SHARE
            # a trigram's last two words are a seen bigram
            two = two[seen[two]]
            node, codes = self.find(3, before[two], ids[two])
            logp[two] = np.where(node >= 0, codes * -CODE, logp[two])
        sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  each row has a token
        return np.diff(first), sums((ids >= 0).astype(np.int64)), sums(base), sums(logp)

    def shares_of(self, place: np.ndarray) -> np.ndarray:
        """Codes of the prior's shares of nodes of level 2."""
        firsts = np.array([x.first for x in self.levels[0]])
        if len(firsts) == 1:
            return self.levels[0][0].shares[place]
        out, part = np.zeros(len(place), np.uint16), np.searchsorted(firsts, place, "right") - 1
        order = np.argsort(part)
        cut = np.searchsorted(part[order], np.arange(len(firsts) + 1))
        for level, a, b in zip(self.levels[0], cut, cut[1:], strict=False):
            own = order[a:b]
            out[own] = level.shares[place[own] - level.first]
        return out

    def words_of(self, place: np.ndarray) -> np.ndarray:
        """Word ids of nodes of level 2, whose places are in order."""
        firsts = np.array([*(x.first for x in self.levels[0]), 1 << 62])
        cut = np.searchsorted(place, firsts)
        return np.concatenate([np.zeros(0, np.int64), *(((x.nodes.at(place[a:b] - x.first)) % U(self.size)).astype(np.int64) for x, a, b in zip(self.levels[0], cut, cut[1:], strict=False))])

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids; the begin of a text counts as often as there are texts."""
        out, p = np.full(len(ids), float(self.docs)), np.searchsorted([x[0] for x in self.vocab] + [self.size], ids, "right") - 1
        for j, (base, _, counts) in enumerate(self.vocab):
            own = np.flatnonzero(p == j)
            out[own] = counts[ids[own] - base]
        return out

    def successors(self, ctx: int) -> list[tuple[int, float]]:
        """(word id, log10 probability) of a word's seen successors, by the pointers."""
        out = []
        for part in self.levels[0]:
            if part.low <= ctx < part.low + part.pointers.n - 1:
                (a,), (b,) = part.ranges(np.array([ctx]))
                word = (part.nodes.at(np.arange(a, b)) - U(ctx * self.size)).tolist()
                out += [(int(w), -CODE * float(q)) for w, q in zip(word, part.codes[a:b], strict=True)]
        return out


def coded(prob: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(prob) / CODE), 0, 255).astype(np.uint8)


_OPEN: dict[tuple[str, int], Model] = {}


def opened(model: Model) -> Model:
    """The model with its files mapped, once in a process; with fewer levels it is another."""
    key = model.uri, sum(map(len, model.level_parts))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = model.open()
    return _OPEN[key]


def marks(c: np.ndarray) -> dict:
    """Sums of counts over at most 512 runs of keys, to cut the next level evenly."""
    every = max(1, len(c) // 256)
    return {"marks": np.add.reduceat(c, np.arange(0, len(c), every)).astype(np.int64).tolist(), "every": every}


def even_cuts(rows: list, more: tuple[int, ...], size: int, total: int, most: int) -> np.ndarray:
    """First keys of even ranges of a level: contexts by their counts, ``more`` ones last; within a context by word ids."""
    at, ends, grown = [0], [0], 0
    for r in rows:
        first = at[-1]
        for j, m in enumerate(r["marks"]):
            grown += m
            at.append(min(first + (j + 1) * r["every"], first + r["n"]))
            ends.append(grown)
    for n in more:
        grown += n
        at.append(at[-1] + 1)
        ends.append(grown)
    shards = -(-total // most)
    ctx = np.interp(np.arange(1, shards) * (ends[-1] / shards), ends, at)
    return np.unique((np.floor(ctx).astype(object) * size + np.floor((ctx % 1) * size).astype(object)).astype(U))


def fit(train: DataFrame, mu: float = MU, parts: int | None = None, order: int = 2, most: int = SHARD) -> Model:
    """Build the trie of a table with a ``text`` column. Counts cover all its rows; files go to the shared folder.

    ``order`` is 2 or 3, the longest n-grams that are counted. What the driver gathers is one row a shard. A shard of levels 2
    and 3 holds the keys of about ``most`` tokens, however large the table is, cut so that even one context's successors may
    spread over several. Null and empty texts count as their end token; repeated rows count each; an empty table gives a model
    of no words.
    """
    uri = shared_dir(train.sparkSession)
    parts = parts or max(8, train.rdd.getNumPartitions())

    def word_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, buf, off in steps(batch, most=STEP, rows=1 << 20):
            yield ids_of(buf, off)[0]

    def build_vocab(part: int, k: np.ndarray, c: np.ndarray) -> dict:
        put(uri, f"vocab-{part}", EliasFano.build(k).pack() + c.tobytes())
        end = int(c[k == END].sum())
        return {"part": part, "n": len(k), "low": str(int(k[0])), "total": int(c.sum()), "docs": end, **marks(c)}

    cuts = np.array([(i << 64) // parts for i in range(1, parts)], U)
    vocab = counted(train, word_keys, cuts, build_vocab, "part int, n long, low string, total long, docs long, marks array<long>, every long")
    total, docs, size = sum(r["total"] for r in vocab), sum(r["docs"] for r in vocab), sum(r["n"] for r in vocab)
    level = "part int, n long, low string, marks array<long>, every long"
    models = [Model(uri, vocab, [], total, docs, mu, order)]

    def keys_of(k: int, model: Model):
        def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            m = opened(model)
            for _, buf, off in steps(batch, most=STEP, rows=1 << 20):
                h, first = ids_of(buf, off)
                ids, _ = m.look_up(h)
                ctx = m.contexts(ids, first)
                if k > 2:
                    # the last word of a text, its end token, is no context; a text's first word has no context of two
                    at = np.ones(len(ids), bool)
                    at[first[1:] - 1] = False
                    at = np.flatnonzero(at)
                    ctx, _ = m.find(2, ctx[at], ids[at])
                    ids = ids[at + 1]
                yield ctx.astype(U) * U(size) + ids.astype(U)

        return keys

    def builder(k: int, model: Model):
        def build(part: int, keys: np.ndarray, c: np.ndarray) -> dict:
            m, codes, shares = opened(model), [], []
            for i in range(0, len(keys), 1 << 20):  # what a slice needs besides its keys is many times them
                own, n = keys[i : i + (1 << 20)], c[i : i + (1 << 20)].astype(float)
                ctx, word = (own // U(size)).astype(np.int64), (own % U(size)).astype(np.int64)
                if k == 2:
                    prior, n_ctx = m.unigram(m.counts_of(word)), m.counts_of(ctx)
                    shares.append(np.clip(np.rint(np.log10((n + mu) / mu) / SHARE), 0, 65535).astype(np.uint16))
                else:
                    heads = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
                    runs = np.diff(np.append(heads, len(ctx)))
                    last = np.repeat(m.words_of(ctx[heads]), runs)
                    prior = 10.0 ** (-CODE * m.find(2, last, word)[1])
                    n_ctx = mu * 10.0 ** (SHARE * np.repeat(m.shares_of(ctx[heads]), runs).astype(float)) - mu
                codes.append(coded((n + mu * prior) / (n_ctx + mu)))
            put(uri, f"level{k}-{part}", Level.pack(keys, size, np.concatenate(codes), np.concatenate(shares) if k < order else None))
            return {"part": part, "n": len(keys), "low": str(int(keys[0])), **marks(c)}

        return build

    if total:
        rows, more, found = vocab, (docs,), []
        for k in range(2, order + 1):
            cuts = even_cuts(rows, more, size, total, most)
            rows, more = counted(train, keys_of(k, models[-1]), cuts, builder(k, models[-1]), level), ()
            found.append(rows)
            models.append(Model(uri, vocab, list(found), total, docs, mu, order))
    return models[-1]


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), extra: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns, ``extra`` ones and n_tokens, n_known, train_tokens, base_score, score of every row of ``df``.

    A null or empty text is its end token alone. With an empty training table every token is unknown. Repeated rows are scored
    alike; an empty table gives an empty result; other columns of ``df``, whatever their names, are ignored.
    """
    extra = extra or {}
    cols = df.select(*[df[c].alias(c) for c in keep], *[e.alias(c) for c, e in extra.items()], df[text].alias("__text"))
    kept = cols.columns[:-1]
    total = model.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(model)
        for batch in batches:
            for b, buf, off in steps(batch, "__text", most=STEP, rows=1 << 20):
                n, known, base, full = m.score(buf, off)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total), pa.int64()), pa.array(base), pa.array(full)], names=[*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = dict(cols.dtypes)
    return map_arrow(cols, run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double")


@tidy
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rest = crc_mod("doc_id", 10)
    model = fit(docs.where(rest != 0).select("text"), order=3)
    return score(docs, model, extra={"held_out": rest == 0})
