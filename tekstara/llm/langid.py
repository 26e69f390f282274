"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, by FTRL-proximal, with a fitted temperature."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, load, map_arrow, steps

BITS = 16
DIM = 1 << BITS
#: Bound of the labelled sample that the weights are fitted on, in rows a language; document frequencies cover all rows.
SAMPLE_ROWS = 400
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.02
_MAP: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to lower-case code point for letters (those of one code point), 0 for all else."""
    global _MAP
    if _MAP is None:
        _MAP = np.zeros(0x110000, np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if unicodedata.category(x)[0] == "L":
                low = x.lower()
                _MAP[c] = ord(low) if len(low) == 1 else c
    return _MAP


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams at each character of all rows (n, 3), each row's first character, and which rows have a letter.

    What isn't a letter is a space, also between rows; n-grams end at their character and reach back over the row's start into
    that space. A row's count of n-grams is three times its characters.
    """
    rows = len(off) - 1
    gap = np.insert(buf, off[1:], 32) if len(buf) else np.full(rows, 32, np.uint8)
    chars = np.frombuffer(gap.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.cumsum((gap & 0xC0) != 0x80)
    first = np.concatenate([[0], heads[(off[1:] + np.arange(rows))]]).astype(np.int64)
    c = _letters()[np.minimum(chars, 0x10FFFF)].astype(np.uint32)
    some = np.add.reduceat((c > 0).astype(np.int64), first[:-1]) > 0
    b1, b2 = np.concatenate([[0], c[:-1]]).astype(np.uint32), np.concatenate([[0, 0], c[:-2]])[: len(c)].astype(np.uint32)
    h = np.empty((len(c), 3), np.uint32)
    k = np.uint32(2654435761)
    h[:, 0] = c * k
    h[:, 1] = (c * np.uint32(40503) + b1 * np.uint32(2246822519) + np.uint32(17)) * k
    h[:, 2] = (c * np.uint32(40503) + b1 * np.uint32(2246822519) + b2 * np.uint32(3266489917) + np.uint32(91)) * k
    return (h >> np.uint32(32 - BITS)).astype(np.int32), first[:-1], some


@dataclass
class Model:
    langs: list[str]
    #: idf times weight of each bucket and language, and the languages' biases, all over the temperature
    table: np.ndarray
    bias: np.ndarray

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its probability and whether there was a letter, of each row."""
        h, first, some = grams(buf, off)
        n = np.diff(np.append(first, len(h)))
        z = np.empty((len(n), len(self.langs)))
        for j in range(len(self.langs)):
            col = self.table[:, j]
            z[:, j] = np.add.reduceat(col[h[:, 0]] + col[h[:, 1]] + col[h[:, 2]], first) / (3 * n) + self.bias[j]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best], some


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, k: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, k) and biases by per-coordinate FTRL-proximal with elastic-net penalties, rows in a fixed shuffled order."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def at(i: np.ndarray) -> np.ndarray:
        zi, l1 = z[i], np.where(i == DIM, 0.0, L1)[:, None]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(xs)):
            i, x = xs[r]
            i, x = np.append(i, DIM), np.append(x, 1.0)
            w = at(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[ys[r]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = at(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def temperature(scores: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(ys)), ys]).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, seen = np.zeros(DIM, np.int64), 0, np.zeros(DIM, bool)
        for batch in batches:
            for b, buf, off in steps(batch):
                h, first, _ = grams(buf, off)
                for x, y in zip(first, np.append(first[1:], len(h)), strict=True):
                    seen[:] = False
                    seen[h[x:y].ravel()] = True
                    total += seen
                rows += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], names=["bucket", "n"])

    out = np.zeros(DIM + 1, np.int64)
    for r in map_arrow(train.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:DIM], int(out[DIM])


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from columns text and lang (neither null). Weights come from about ``sample_rows`` distinct texts of each language
    (all, if it has no more), chosen by a hash of the text, so copies count once and no language is without a text; four fifths
    of each language's fit the weights, the rest the temperature. Ties between languages go to the first by name."""
    counts = {r["lang"]: max(1, r["n"]) for r in train.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((DIM, 0)), np.zeros(0))
    df, rows = frequencies(train)
    idf = np.log((1 + rows) / (1 + df)) + 1
    spread = 1_000_000
    # the estimate of a small number of texts may be too high: up to twice the sample all are taken
    share = F.create_map(*[F.lit(x) for c in langs for x in (c, spread if counts[c] <= 2 * sample_rows else -(-sample_rows * spread // counts[c]))])
    # copies count once, however many there are, so the sample stays bounded
    picked = train.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(spread)) < F.element_at(share, F.col("lang"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, buf, off in steps(batch):
                h, first, _ = grams(buf, off)
                at, n = [], []
                for x, y in zip(first, np.append(first[1:], len(h)), strict=True):
                    i, c = np.unique(h[x:y], return_counts=True)
                    at.append(i.astype(np.int32))
                    n.append(c.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "at", "n"])

    got = map_arrow(picked.select("text", "lang"), run, "lang string, at array<int>, n array<int>").toArrow()
    lang, at, n = (got.column(i).combine_chunks() for i in range(3))
    o, at, n = np.append(at.offsets.to_numpy(), len(at.flatten())), at.flatten().to_numpy(), n.flatten().to_numpy()
    # an order that doesn't depend on how rows were dealt
    code = {c: i for i, c in enumerate(langs)}
    data = sorted(((code[c], at[o[r] : o[r + 1]].tobytes(), n[o[r] : o[r + 1]].tobytes()) for r, c in enumerate(lang.to_pylist())))
    ys, xs = np.array([d[0] for d in data], int), []
    for _, i, c in data:
        i, c = np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)
        xs.append((i, SCALE * c / c.sum() * idf[i]))
    # the place within the language decides, so that each has texts to learn from
    held = (np.arange(len(xs)) - np.searchsorted(ys, ys)) % 5 == 4
    w, bias = ftrl([x for x, h in zip(xs, held, strict=True) if not h], ys[~held], len(langs))
    heat = 1.0
    if held.any():
        heat = temperature(np.array([x @ w[i] + bias for (i, x), h in zip(xs, held, strict=True) if h]), ys[held])
    return Model(langs, (SCALE * idf[:, None] * w / heat).astype(np.float32), bias / heat)


#: Relative frequencies of n-grams are about 1e-3; this brings features near 1.
SCALE = 100.0


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), extra: dict[str, Column] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, ``extra`` ones, lang_pred and score (the calibrated probability) of every row; only the text is read for it.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned. Repeated rows are
    predicted alike; of equally likely languages the first by name is taken; an empty table gives an empty result. Columns of
    ``df`` that aren't kept may have any name; kept ones need other names than the added two (``names``).
    """
    cols = df.select(*[df[c].alias(c) for c in keep], *[e.alias(c) for c, e in (extra or {}).items()], df[text].alias("__text"))
    kept, kinds = cols.columns[:-1], dict(cols.dtypes)
    sc = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sc.value
        for batch in batches:
            for b, buf, off in steps(batch, "__text"):
                if m.langs:
                    best, p, some = m.predict(buf, off)
                else:
                    best, p, some = (np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows, bool))
                named = [m.langs[i] if s else "und" for i, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(named, pa.string()), pa.array(np.where(some, p, 0.0), pa.float64())], names=[*kept, *names])

    return map_arrow(cols, run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{names[0]}` string, `{names[1]}` double")


def fitted(docs: DataFrame) -> Model:
    """A model from the rows of ``docs`` that aren't held out (crc32 of the id modulo 5 not 0) and have a text and a language."""
    return fit(docs.where((crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return predict(docs, fitted(docs), extra={"held_out": crc_mod("doc_id", 5) == 0})
