"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are the distinct lower-cased words (runs of letters) and word beginnings of four
to six bytes, as 64-bit hashes.  A logistic model over the ``FEATURES`` hashes that tell the labels
apart best (chi-square) is fitted with an L1 penalty.  Labelled texts that name a group of people
are copied with the names swapped inside their category; the fit adds ``BALANCE`` times the mean
squared difference of the two logits, so a mention as such cannot carry weight and neutral
mentions are not punished.

Learning: rows of ``labels`` whose ``crc32(id as text) mod 5`` is not 0, at most ``MAX_ROWS`` of them
(the smallest hashes of the id; the bound is what is broadcast and what reaches the driver).
Scoring covers every whole text.  Labels, language, source and id are never inputs of a score.

Edge cases: null and empty texts have no features, their score is the model's base rate; without
rows of both classes every score is the share of toxic rows (0 without rows); labels that are null
are ignored, of repeated labels the largest counts; a null id counts as held out.  Extra columns
are ignored by ``scores`` and kept by ``accepted``.

Scale: the labelled sample is joined by broadcasting its bounded id list, so texts are not
shuffled; scoring is one pass with a weight table of ``FEATURES`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tidy
from .words import BLOCK, U, span_hashes, text_buffers, unique_pairs

MAX_ROWS = 20_000
FEATURES = 2048
BEGINNINGS = (4, 5, 6)
L1 = 4e-4
BALANCE = 1.0
#: fixed values: names of groups by category; a name is swapped with the next of its category
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("africans", "europeans", "asians", "americans", "arabs"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[97:123] = True


def swapped(text: str, identities=IDENTITIES) -> str | None:
    """The lower-cased text with every group name replaced by the next of its category; null if it
    names none."""
    to = {name: group[(i + 1) % len(group)] for group in identities for i, name in enumerate(group)}
    hits = 0

    def put(m):
        nonlocal hits
        new = to.get(m[0])
        hits += new is not None
        return new or m[0]

    out = re.sub(r"[^\W\d_]+", put, text.lower())
    return out if hits else None


def features(raw: np.ndarray, row_ends: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, row) of lower-cased texts laid end to end, each followed by a gap byte;
    ``keep``: table of the low 20 bits of wanted hashes."""
    letter = np.zeros(len(raw) + 2, bool)
    letter[1:-1] = _LETTER[raw]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(row_ends, start, "right")
    hs, rows = [], []
    for k in (None, *BEGINNINGS):
        long = slice(None) if k is None else end - start >= k
        s, e, r = start[long], end[long], row[long]
        h = span_hashes(raw, s, e if k is None else s + k) ^ U(k or 0)
        if keep is not None:
            hit = keep[(h & U((1 << 20) - 1)).astype(np.int64)]
            h, r = h[hit], r[hit]
        hs.append(h)
        rows.append(r)
    return unique_pairs(np.concatenate(hs), np.concatenate(rows))


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their lower-cased texts laid end to end (a gap after each)."""
    for batch in batches:
        _, off = text_buffers(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1, i + 1)
            part = batch.slice(i, j - i)
            texts = [(t or "").lower().encode() for t in part.column("text").to_pylist()]
            ends = np.cumsum([len(t) + 1 for t in texts])
            yield part, np.frombuffer(b" ".join(texts) + b" ", np.uint8), ends
            i = j


def _sample_rows(identities):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split(raw, ends, n):
            h, r = features(raw, ends)
            at = np.searchsorted(r, np.arange(n + 1))
            return [h[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:])]

        for part, raw, ends in _lowered(batches):
            own = split(raw, ends, part.num_rows)
            other = [swapped(t or "", identities) for t in part.column("text").to_pylist()]
            texts = [(t or "").encode() for t in other]
            twin = split(np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.cumsum([len(t) + 1 for t in texts]), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(own, pa.list_(pa.int64())), pa.array([t if o is not None else None for t, o in zip(twin, other)], pa.list_(pa.int64()))],
                names=["toxic", "own", "twin"])
    return run


def fit(rows: list[tuple[int, np.ndarray, np.ndarray | None]], n_features: int, l1: float = L1, balance: float = BALANCE,
        steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias from ``(label, feature numbers, feature numbers of the swapped text)`` by
    accelerated proximal gradient steps."""
    y = np.array([r[0] for r in rows], float)
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    col = np.concatenate([r[1] for r in rows]).astype(np.int64) if n else np.zeros(0, np.int64)
    pairs = [(r[1], r[2]) for r in rows if r[2] is not None]
    p_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    p_col = np.concatenate([np.concatenate(p) for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    p_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs]) if pairs else np.zeros(0)
    rate = float(y.mean())
    w, bias = np.zeros(n_features), float(np.log(rate / (1 - rate)))
    most = max((len(r[1]) for r in rows), default=1) + 1
    lipschitz = 0.25 * min(most, 40 + np.mean([len(r[1]) + 1 for r in rows])) + balance * 8
    vw, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.bincount(at, vw[col], minlength=n) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.bincount(col, g[at], minlength=n_features)
        if pairs:
            d = np.bincount(p_at, p_sign * vw[p_col], minlength=len(pairs))
            grad += balance / n * np.bincount(p_col, (p_sign * d[p_at]), minlength=n_features)
        nw = vw - grad / lipschitz
        nw = np.sign(nw) * np.maximum(np.abs(nw) - l1 / lipschitz, 0)
        nb = vb - g.sum() / lipschitz
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, identities=IDENTITIES) -> tuple[np.ndarray, np.ndarray, float]:
    """``(sorted feature hashes, weights, bias)``."""
    marks = (labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("toxic")).where("lid IS NOT NULL AND toxic IS NOT NULL")
             .where(F.crc32(F.col("lid").cast("string")) % 5 != 0).groupBy("lid").agg(F.max("toxic").alias("toxic")))
    marks = checkpointed(marks.orderBy(F.xxhash64("lid"), "lid").limit(max_rows))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = checkpointed(d.join(F.broadcast(marks), F.col("id") == F.col("lid")).select("toxic", "text").mapInArrow(
        _sample_rows(identities), "toxic int, own array<long>, twin array<long>"))
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n, p = size["n"], int(size["p"] or 0)
    if n == 0 or p in (0, n):
        rate = min(max(p / n, 1e-9), 1 - 1e-9) if n else 1e-9
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate)))
    counts = sample.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("m")).where("m >= 3")
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    chi = (a * n - m * p) * (a * n - m * p) / (m * (n - m + 1))
    best = counts.withColumn("chi", chi).orderBy(F.desc("chi"), "f").limit(FEATURES).select("f").collect()                     # <= FEATURES rows
    known = np.sort(np.array([r["f"] for r in best], np.int64).view(np.uint64))

    @tidy
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in ("own", "twin"):
                lists = []
                for x in batch.column(name):
                    if not x.is_valid:
                        lists.append(None)
                        continue
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    at = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
                    lists.append(at[known[at] == v].astype(np.int32) if len(known) else np.zeros(0, np.int32))
                out.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *out], names=["toxic", "own", "twin"])

    rows = sample.mapInArrow(chosen, "toxic int, own array<int>, twin array<int>").collect()                                    # <= max_rows rows
    data = [(r["toxic"], np.array(r["own"], np.int64), None if r["twin"] is None else np.array(r["twin"], np.int64)) for r in rows]
    w, bias = fit(data, len(known))
    used = np.abs(w) > 1e-6
    return known[used], w[used], bias


def _score(known: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << 20, bool)
        keep[(known & U((1 << 20) - 1)).astype(np.int64)] = True
        for part, raw, ends in _lowered(batches):
            h, r = features(raw, ends, keep)
            z = np.full(part.num_rows, bias)
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                z += np.bincount(r[hit], weights[at[hit]], minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score)], names=["id", "held_out", "score"])
    return run


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: id, ``held_out, score, predicted``."""
    model = train(docs, labels, id_col, text_col, label_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    out = d.mapInArrow(tidy(_score(*model)), "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents, all columns kept, that are not predicted toxic (a row is judged by its own
    text, so repeated and null ids do no harm)."""
    known, weights, bias = train(docs, labels, id_col, text_col, label_col)
    place = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _score(known, weights, bias)
        for batch in batches:
            n = batch.num_rows
            texts = pa.RecordBatch.from_arrays([batch.column(place), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=["text", "id", "held_out"])
            scores = [x.column("score").to_numpy() for x in judge(iter([texts]))]
            yield batch.filter(pa.array(np.concatenate(scores) < 0.5)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
