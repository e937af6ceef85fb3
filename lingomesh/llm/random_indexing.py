"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are runs of letters, digits and non-ASCII characters, and runs of other visible characters
(``and&&&`` is two words); case counts.  A word's 64-bit hash gives its row among ``ROWS``.

1. Random indexing.  Row r has a fixed sparse index vector of ``NONZERO`` entries of +1 or -1 among
   ``DIM``.  Every occurrence of a word adds the index vectors of the ``WINDOW`` words on either side
   to its context vector.  These sums cover all documents; they are whole numbers, so their order
   does not matter.  A word's vector is its context vector, brought to unit length, less the
   corpus mean, shrunk for rare rows, next to its own index vector.
2. Pooling.  A document is the mean of its words' vectors, the length of either half of that mean
   and the logarithm of its number of words.
3. A network of two layers (``HIDDEN`` tanh units, one logit) is fitted in numpy on labelled documents.
   A fifth of them, chosen by a hash of the id, is left out of the fit and sets the temperature
   that the logit is divided by (least log loss).

Learning: rows of ``labels`` whose ``crc32(id as text) mod 3`` is not 1, at most ``MAX_ROWS`` of them
(the smallest hashes of their ids).  Labels, language, source and id are no inputs of a score.

Edge cases: null and empty texts pool to zero and get the network's score of that; without rows of
both classes every score is the share of good rows (0 without rows); null labels are ignored, of
repeated labels the largest counts; a null id is held out; of rows that share a labelled id one
text (the smallest hash) is learnt from, all are scored.  Extra columns are ignored.

Scale: three passes over the texts and no shuffle of them.  A map task sends at most ``ROWS`` rows of
partial sums; the finished table has ``ROWS`` x ``2 DIM`` numbers whatever the corpus (words beyond ``ROWS``
share rows by hash, none is left out), so it may be collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .words import BLOCK, U, int_column, span_hashes, text_buffers

ROWS = 1 << 15
DIM = 64
NONZERO = 8
WINDOW = 2
HIDDEN = 32
MAX_ROWS = 20_000
RARE = 5
FLUSH = 1 << 27           # words after which a task's 32-bit sums are handed on
_SPACE, _SIGN, _LETTER = 0, 1, 2
CLASS = np.full(256, _LETTER, np.uint8)
CLASS[:33] = _SPACE
CLASS[33:128] = _SIGN
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    CLASS[_a:_b] = _LETTER


@cache
def index_vectors(rows: int = ROWS, dim: int = DIM, nonzero: int = NONZERO) -> np.ndarray:
    """The fixed sparse vector of every row."""
    rng = np.random.Generator(np.random.PCG64(11))
    at = np.argsort(rng.random((rows, dim), np.float32), axis=1)[:, :nonzero]
    out = np.zeros((rows, dim), np.int8)
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), (rows, nonzero)), 1)
    return out


def word_rows(raw: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Row of every word and the byte where the word starts."""
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = CLASS[raw]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    full = kind[edge + 1] != _SPACE
    start, end = edge[full], np.append(edge[1:], len(raw))[full]
    return (span_hashes(raw, start, end) & U(rows - 1)).astype(np.int64), start


def _parts(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, row numbers of words, number of the row each word stands in)`` of blocks of whole
    texts; a text longer than a block comes in several parts, cut at white space."""
    i = 0
    while i < len(off) - 1:
        j = max(int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1, i + 1)
        part = raw[off[i]: off[j]]
        if j > i + 1:
            at = off[i: j + 1] - off[i]
            words, start = word_rows(np.insert(part, at[1:-1], 32))
            yield i, j, words, np.searchsorted(at[:-1] + np.arange(j - i), start, "right") - 1 + i
        else:
            lo = 0
            while lo == 0 or lo < len(part):
                hi = min(lo + BLOCK, len(part))
                while hi < len(part) and CLASS[part[hi]] != _SPACE:
                    hi += 1
                words, _ = word_rows(part[lo:hi])
                yield i, j, words, np.full(len(words), i)
                lo = max(hi, 1)
        i = j


def context_sums(words: np.ndarray, row: np.ndarray, index: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, occurrences, sums of the neighbours' index vectors)`` of the words of some documents."""
    own = index[words]
    near = np.zeros(own.shape, np.int16)
    for d in range(1, window + 1):
        same = (row[d:] == row[:-d])[:, None]
        near[d:] += own[:-d] * same
        near[:-d] += own[d:] * same
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    return words[order][first], np.diff(np.append(first, len(words))), np.add.reduceat(near[order], first, axis=0, dtype=np.int32)


TABLE = "row int, n long, sums binary"


def _sum_rows(rows: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 4096):
        part = slice(k, k + 4096)
        yield pa.RecordBatch.from_arrays([pa.array(rows[part].astype(np.int32)), pa.array(n[part].astype(np.int64)),
                                          pa.array([s.tobytes() for s in sums[part]], pa.binary())], names=["row", "n", "sums"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    n, sums, held = np.zeros(ROWS, np.int64), np.zeros((ROWS, DIM), np.int32), 0
    for batch in batches:
        for _, _, words, row in _parts(*text_buffers(batch.column("text"))):
            if not len(words):
                continue
            r, c, s = context_sums(words, row, index)
            n[r] += c
            sums[r] += s
            held += len(words)
        if held >= FLUSH:
            yield from _sum_rows(np.flatnonzero(n), n[n > 0], sums[n > 0])
            n[:], sums[:], held = 0, 0, 0
    if held:
        yield from _sum_rows(np.flatnonzero(n), n[n > 0], sums[n > 0])


def _summed(width: type):
    """Sum the rows of one partition; each row number stands in one partition only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(ROWS, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.zeros((ROWS, DIM), np.int64) if sums is None else sums
            part = np.frombuffer(b"".join(batch.column("sums").to_pylist()), width).reshape(-1, DIM)
            rows = batch.column("row").to_numpy()
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.diff(rows[order], prepend=-1))
            at = rows[order][first]
            n[at] += np.add.reduceat(batch.column("n").to_numpy()[order], first)
            sums[at] += np.add.reduceat(part[order], first, axis=0, dtype=np.int64)
        if sums is not None:
            yield from _sum_rows(np.flatnonzero(n), n[n > 0], sums[n > 0])
    return run


def context_table(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """``(occurrences, context sums)`` of every row over all documents; ``ROWS`` x ``DIM`` whole numbers."""
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts, TABLE)
    rows = parts.repartition("row").mapInArrow(_summed(np.int32), TABLE).collect()          # <= ROWS rows
    n, sums = np.zeros(ROWS, np.int64), np.zeros((ROWS, DIM), np.int64)
    for r in rows:
        n[r["row"]] = r["n"]
        sums[r["row"]] = np.frombuffer(r["sums"], np.int64)
    return n, sums


def word_vectors(n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Context half and index half of every row's vector."""
    size = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    unit = sums / np.maximum(size, 1e-9)
    mean = (unit * n[:, None]).sum(axis=0) / max(n.sum(), 1)
    context = (unit - mean) * (n / (n + RARE))[:, None]
    return np.concatenate([context, index_vectors() / np.sqrt(NONZERO)], axis=1).astype(np.float32)


def pooled(raw: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of ``2 DIM + 3`` numbers per text."""
    sums = np.zeros((len(off) - 1, 2 * DIM))
    count = np.zeros(len(off) - 1)
    for _, _, words, row in _parts(raw, off):
        for k in range(0, len(words), 1 << 14):         # a few MB of vectors at a time
            w, r = words[k: k + (1 << 14)], row[k: k + (1 << 14)]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            sums[r[first]] += np.add.reduceat(vectors[w], first, axis=0)
            count[r[first]] += np.diff(np.append(first, len(r)))
    mean = sums / np.maximum(count, 1)[:, None]
    size = [np.sqrt((mean[:, h] ** 2).sum(axis=1, keepdims=True)) for h in (slice(0, DIM), slice(DIM, None))]
    return np.concatenate([mean, *size, np.log1p(count)[:, None]], axis=1)


class Model(NamedTuple):
    """``tanh((x - mean) / scale @ w1 + b1) @ w2 + b2``, divided by ``temperature``; without a fit only ``b2``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def gradient(m: Model, x: np.ndarray, y: np.ndarray, decay: float) -> list:
    """Gradient of log loss plus ``decay / 2`` times the squared weights, by ``w1, b1, w2, b2``."""
    u = (x - m.mean) / m.scale
    h = np.tanh(u @ m.w1 + m.b1)
    g = (1 / (1 + np.exp(-np.clip(h @ m.w2 + m.b2, -40, 40))) - y) / len(y)
    back = np.outer(g, m.w2) * (1 - h * h)
    return [u.T @ back + decay * m.w1, back.sum(axis=0), h.T @ g + decay * m.w2, float(g.sum())]


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/20 and 20 of least log loss, by golden section (the loss has one
    minimum in the inverse temperature)."""
    lo, hi, r = np.log(1 / 20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if log_loss(z * np.exp(a), y) <= log_loss(z * np.exp(b), y) else (a, hi)
    return float(np.exp(-(lo + hi) / 2))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, batch: int = 128, rate: float = 3e-3,
        decay: float = 1e-4) -> Model:
    """Adam steps over the rows that are not ``aside`` in a fixed random order; the others set the temperature
    (all rows do if those hold one class only)."""
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-9), 1 - 1e-9) if len(y) else 1e-9
        return Model(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    learn = ~aside if 0 < y[~aside].sum() < (~aside).sum() else np.ones(len(y), bool)
    lx, ly = x[learn], y[learn]
    rng = np.random.Generator(np.random.PCG64(13))
    rate0 = float(ly.mean())
    params = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), float(np.log(rate0 / (1 - rate0)))]
    mean, scale = lx.mean(axis=0), lx.std(axis=0) + 1e-6
    first, second, step = [0 * p for p in params], [0 * p for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(ly))
        for k in range(0, len(order), batch):
            at, step = order[k: k + batch], step + 1
            grad = gradient(Model(mean, scale, *params, 1.0), lx[at], ly[at], decay)
            first = [0.9 * m + 0.1 * g for m, g in zip(first, grad)]
            second = [0.999 * v + 0.001 * g * g for v, g in zip(second, grad)]
            params = [p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) for p, m, v in zip(params, first, second)]
    plain = Model(mean, scale, *params, 1.0)
    rest = aside if 0 < y[aside].sum() < aside.sum() else np.ones(len(y), bool)
    return plain._replace(temperature=calibrated(plain.logit(x[rest]), y[rest]))


def _sample(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*text_buffers(batch.column("text")), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), batch.column("pick"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "mark", "pick", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS):
    """``(broadcast word vectors, model)``."""
    spark = docs.sparkSession
    marks = (labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("mark")).where("lid IS NOT NULL AND mark IS NOT NULL")
             .where(F.crc32(F.col("lid").cast("string")) % 3 != 1).groupBy("lid").agg(F.max("mark").alias("mark")))
    marks = checkpointed(marks.orderBy(F.xxhash64("lid"), "lid").limit(max_rows))
    vectors = spark.sparkContext.broadcast(word_vectors(*context_table(docs, text_col)))       # ROWS x 2 DIM float32
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    d = d.join(F.broadcast(marks), F.col("id") == F.col("lid")).select("id", "mark", F.xxhash64("text").alias("pick"), "text")
    rows = d.mapInArrow(_sample(vectors), "id long, mark int, pick long, x binary").groupBy("id").agg(
        F.min_by(F.struct("mark", "x"), F.struct("pick", "x")).alias("r"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("aside"))
    rows = sorted(rows.select("id", "r.mark", "r.x", "aside").collect())                       # <= max_rows rows
    x = np.frombuffer(b"".join(r["x"] for r in rows), float).reshape(len(rows), 2 * DIM + 3)
    return vectors, fit(x, np.array([r["mark"] for r in rows], float), np.array([r["aside"] for r in rows], bool))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: id, ``held_out, score, predicted``."""
    vectors, model = train(docs, labels, id_col, text_col, label_col, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, null = int_column(batch.column("id"))
            score = model.score(pooled(*text_buffers(batch.column("text")), vectors.value)).round(9)     # the last bits depend on the batch
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), batch.column("held_out"), pa.array(score)], names=["id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    out = d.mapInArrow(run, "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
