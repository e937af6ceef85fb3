"""Best-fit packing: pattern packing by non-negative least squares.

Documents become token ids plus an end token; a document longer than a sequence is cut into
pieces, all of full length but perhaps the first.  Full pieces are sequences of their own.  The
others are packed by length only:

1. Spark counts the pieces of each length (a histogram of at most ``CAPACITY`` rows).
2. Patterns of two or three lengths that fill a sequence are enumerated; their repeat counts are
   fitted to the histogram by non-negative least squares (an active set that grows by the
   patterns of steepest descent), then rounded within what the histogram still holds.
3. What rounding leaves over is packed best fit, longest first, on the histogram, with as many
   documents as fit.
4. Every pattern slot takes a range of the pieces of its length; pieces get a gapless rank within
   their length in Spark and meet their slot by that range.

Scale: the driver only sees histogram-sized tables, whatever the number of documents: the fit has
at most ``CAPACITY`` patterns, and the best-fit step splits a group of equal open sequences at
most once per length.  Ranks are salted (``common.gapless_rank``), so one length that holds a
third of all pieces is no single task.  Texts are tokenized once.

Edge cases: null or empty text is the end token alone; a null or repeated id is packed as its own
row.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gapless_rank, tidy

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
ROUNDS = 16
GROW = 64
SWEEPS = 20
SHARES = (1.0, 0.8, 0.6, 0.4)      # of the fitted counts that are tried


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    """``list of texts → list of id lists``.  The byte-level BPE vocabulary is also there as ranks,
    whose encoder gives the same ids several times faster; texts that hold the special token's
    string, and vocabularies without such a file, take the tokenizer itself, which is loaded at the
    first of them."""
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    slow = None
    ranks_file = path.removesuffix(".json") + ".tiktoken"
    fast = None
    if os.path.exists(ranks_file):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        nonlocal slow
        if fast is None or any(s in text for s in special):
            if slow is None:
                from tokenizers import Tokenizer

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                slow = Tokenizer.from_file(path)
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def _pieces(path: str, capacity: int, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                tokens = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                cuts = list(range(len(tokens), 0, -capacity))[::-1]
                for k, end in enumerate(cuts):
                    begin = cuts[k - 1] if k else 0
                    ids.append(doc)
                    piece.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(tokens[begin:end].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def fit_patterns(histogram: np.ndarray, capacity: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns (lengths that sum to ``capacity``) with fractional repeat counts by non-negative
    least squares; ``histogram[i]`` pieces of length i."""
    h = histogram[:capacity + 1].astype(float)
    have = h > 0
    # weights as the lengths: long pieces are the hard ones to place
    weight = np.sqrt(np.arange(capacity + 1) / capacity)
    columns: list[tuple[int, ...]] = []
    known: set[tuple[int, ...]] = set()
    x = np.zeros(0)
    left = h.copy()
    size = np.arange(capacity + 1)
    third = capacity - size[:, None] - size[None, :]
    triple_ok = (size[:, None] <= size[None, :]) & (third >= size[None, :]) & (size[:, None] > 0)
    triple_ok &= have[:, None] & have[None, :] & have[np.clip(third, 0, capacity)]
    pair_ok = have & have[::-1] & (size > 0) & (size <= capacity - size)
    matrix = np.zeros((capacity + 1, 0))
    for _ in range(ROUNDS):
        slope = weight ** 2 * left
        pair = np.where(pair_ok, slope + slope[::-1], -1.0)
        triple = np.where(triple_ok, slope[:, None] + slope[None, :] + slope[np.clip(third, 0, capacity)], -1.0)
        new = []
        for flat, shape in ((pair, 1), (triple.ravel(), 2)):
            n = min(GROW, int((flat > 1e-6).sum()))
            for i in np.argpartition(-flat, n)[:n] if n else []:
                i = int(i)
                p = (i, capacity - i) if shape == 1 else (i // (capacity + 1), i % (capacity + 1), capacity - i // (capacity + 1) - i % (capacity + 1))
                if p not in known:
                    new.append(p)
        if not new:
            break
        known.update(new)
        add = np.zeros((capacity + 1, len(new)))
        for c, p in enumerate(new):
            np.add.at(add[:, c], list(p), 1.0)
        columns += new
        matrix = np.hstack([matrix, add])
        x = _non_negative(matrix * weight[:, None], h * weight, np.concatenate([x, np.zeros(len(new))]))
        keep = x > 1e-9
        columns, matrix, x = [c for c, k in zip(columns, keep) if k], matrix[:, keep], x[keep]
        known = set(columns)
        left = h - matrix @ x
        if weight @ np.abs(left) < 1e-3 * (weight @ h):
            break
    return columns, x


def rounded(columns: list[tuple[int, ...]], x: np.ndarray, rest: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts, largest first, never more than ``rest`` holds (what is used is taken
    out of it)."""
    out = []
    for i in np.argsort(-x):
        p = columns[i]
        need = {q: p.count(q) for q in set(p)}
        r = min([int(np.floor(x[i] + 0.5)), *(int(rest[q]) // m for q, m in need.items())])
        if r > 0:
            out.append((p, r))
            for q, m in need.items():
                rest[q] -= r * m
    return out


def _non_negative(a: np.ndarray, b: np.ndarray, x: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares from ``x`` by coordinate descent on the normal equations (their
    size is that of the active set)."""
    g = a.T @ a
    slope = g @ x - a.T @ b
    diagonal = np.maximum(np.diag(g), 1e-12)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(x)):
            step = max(-x[j], -slope[j] / diagonal[j])
            if step:
                x[j] += step
                slope += step * g[j]
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def best_fit(rest: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram best fit, longest first: groups of equal open sequences by free space."""
    free: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    spaces: set[int] = set()
    for q in range(capacity, 0, -1):
        n = int(rest[q])
        while n > 0:
            fits = [s for s in spaces if s >= q]
            if fits:
                s = min(fits)
                group, k = next(iter(free[s].items()))
                per = min(s // q, n)                        # equal pieces that one sequence takes
                m = min(k, max(1, n // per))
                per = min(per, n // m)
                if m == k:
                    del free[s][group]
                else:
                    free[s][group] = k - m
                if not free[s]:
                    spaces.discard(s)
            else:
                group, s = (), capacity
                per = min(s // q, n)
                m = max(1, n // per)
            made = group + (q,) * per
            free[s - per * q][made] = free[s - per * q].get(made, 0) + m
            if s - per * q:
                spaces.add(s - per * q)
            n -= m * per
    return [(p, k) for groups in free.values() for p, k in groups.items()]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that hold every piece of the histogram once.  Rounding leaves
    a residue that packs better the more short pieces it has, so several shares of the fitted
    counts are tried and the plan with the fewest sequences is taken."""
    columns, x = fit_patterns(histogram, capacity)
    plans = []
    for share in SHARES:
        rest = histogram.copy()
        fitted = rounded(columns, x * share, rest)
        plans.append(fitted + best_fit(rest, capacity))
    return min(plans, key=lambda p: sum(r for _, r in p))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, first_rank, n, first_sequence, offset``: the pieces of a length with ranks
    ``first_rank … first_rank + n - 1`` go to sequences ``first_sequence …`` at the offset."""
    used: dict[int, int] = defaultdict(int)
    out, seq = [], 0
    for p, r in patterns:
        at = 0
        for q in p:
            out.append((q, used[q], r, seq, at))
            used[q] += r
            at += q
        seq += r
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
           tokenizer: str | None = None) -> DataFrame:
    """Per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset``."""
    path = tokenizer or tokenizer_path()
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = checkpointed(d.mapInArrow(_pieces(path, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long"))
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()              # <= capacity rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    full = int(histogram[capacity])
    histogram[capacity] = 0
    table = [(capacity, 0, full, 0, 0)] + [(q, a, n, s + full, o) for q, a, n, s, o in slots(plan(histogram, capacity))]
    spark = docs.sparkSession
    slot = spark.createDataFrame(table, "slot_length long, first_rank long, n long, first_sequence long, offset long")
    ranked = gapless_rank(pieces, ["length"], ["id", "piece", "ids_crc32"], "rank")
    # slots of one length in one array: a piece finds its slot by rank without a join per slot
    by_length = slot.groupBy("slot_length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "n", "first_sequence", "offset"))).alias("slots"))
    placed = ranked.join(F.broadcast(by_length), F.col("length") == F.col("slot_length"))
    mine = F.filter("slots", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["first_rank"] + s["n"]))[0]
    placed = placed.withColumn("slot", mine)
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"), F.col("slot.offset").alias("offset"))
