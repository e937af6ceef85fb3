"""Blocked cosine top-k join.

A two-dimensional grid: pivot rows fall into ``I`` by a hash of their position, rows of the
other languages into ``J``.  Each row is sent to the cells of its row or column of the grid
only, packed into float32 matrices on the way (the pivot once for all languages), and a cell
``(code, I, J)`` is one cogroup: no join, so nothing can be broadcast, and no pair of blocks is
ever materialized.  Inside the cell numpy multiplies slabs of pivot rows with tiles and keeps a
running top-k per pivot row and a running best pivot per column; Spark reduces these winners with
a window group limit and an aggregate.  A worker holds the two sides of one cell as they came, one
tile in float64 and one slab of scores, whatever the size of the input and the number of ties.

Ties break by position everywhere: score descending, then position ascending.  Scores are
accumulated in float64 and rounded to ``SCORE_DIGITS`` decimals before any comparison, so equal
vectors have equal scores whatever the grid and the tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BYTES = 64 << 20          # of float32 vectors on each side of a cell
MAX_PIVOT_BLOCK_ROWS = 1024    # tile inside a cell
MAX_OTHER_BLOCK_ROWS = 4096
TILE_BYTES = 4 << 20           # of float32 vectors in a tile
SLAB_BYTES = 4 << 20           # of float64 scores held at once
SCORE_DIGITS = 10

KERNEL_SCHEMA = "code string, kind byte, a long, b long, score double"


def _tiles(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and float32 matrix of each packed tile (rows sorted by position), on the table's own memory."""
    out = []
    for pos, mat in zip(table.column("pos"), table.column("mat")):
        if mat.is_valid:
            p = np.frombuffer(pos.as_buffer(), dtype=np.int64)
            out.append((p, np.frombuffer(mat.as_buffer(), dtype=np.float32).reshape(len(p), -1)))
    return out


def _block_topk(S: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column index of the k best per row (score desc, column asc)."""
    n, m = S.shape
    kk = min(k, m)
    if kk == m:
        best = np.ones_like(S, dtype=bool)
    else:
        kth = np.partition(S, m - kk, axis=1)[:, m - kk, None]
        best = S >= kth
        tied = np.flatnonzero(np.count_nonzero(best, axis=1) > kk)
        if len(tied):                                       # of the ties at the k-th value the first columns
            above = S[tied] > kth[tied]
            same = best[tied] & ~above
            need = kk - np.count_nonzero(above, axis=1)
            best[tied] = above | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= need[:, None]))
    r_idx, c_idx = np.nonzero(best)
    order = np.lexsort((c_idx, -S[r_idx, c_idx], r_idx))
    return r_idx[order], c_idx[order]


def _merge_topk(state, rows, pos, score, n: int, k: int):
    """Running top-k per row: the old winners and new ``(row, pos, score)`` triples together."""
    if state is not None:
        rows, pos, score = (np.concatenate(x) for x in zip(state, (rows, pos, score)))
    order = np.lexsort((pos, -score, rows))
    rows, pos, score = rows[order], pos[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows] < k
    return rows[keep], pos[keep], score[keep]


def _cell(k: int):
    """All pairs of one grid cell: left = pivot tiles and lists of excluded positions (``gone``)."""
    unit = 10.0 ** SCORE_DIGITS

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        code = key[0].as_py()
        gone = left.column("gone").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        others = _tiles(right)
        slab = max(1, SLAB_BYTES // (8 * max((len(p) for p, _ in others), default=1)))
        pivots = []
        for pos, mat in _tiles(left) if others else ():
            rows = np.flatnonzero(~np.isin(pos, gone))
            pivots += [(pos[r], mat, r) for i in range(0, len(rows), slab) for r in [rows[i:i + slab]]]
        top = [None] * len(pivots)
        parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for opos, omat in others if pivots else ():
            wide = omat.astype(np.float64)
            best = np.full(len(opos), -np.inf)
            best_pos = np.zeros(len(opos), np.int64)
            for t, (ppos, pmat, rows) in enumerate(pivots):
                S = pmat[rows].astype(np.float64) @ wide.T
                S *= unit
                np.rint(S, out=S)
                r, c = _block_topk(S, k)
                top[t] = _merge_topk(top[t], r, opos[c], S[r, c], len(ppos), k)
                at = S.argmax(axis=0)                       # first maximum = lowest position of the slab
                score, pos = S[at, np.arange(len(opos))], ppos[at]
                better = (score > best) | ((score == best) & (pos < best_pos))
                best[better], best_pos[better] = score[better], pos[better]
            parts.append((1, best_pos, opos, best))
        parts += [(0, pivots[t][0][rows], pos, score) for t, (rows, pos, score) in enumerate(x for x in top if x is not None)]
        kind = np.concatenate([np.full(len(x[1]), x[0], np.int8) for x in parts]) if parts else np.zeros(0, np.int8)
        a, b, score = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0) for i in (1, 2, 3))
        return pa.table({"code": pa.array([code] * len(kind), pa.string()), "kind": pa.array(kind, pa.int8()),
                         "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "score": pa.array(score.astype(np.float64) / unit)})

    return run


def _pack_tile(keys: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        pos = table.column("pos").to_numpy().astype(np.int64)
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        order = np.argsort(pos, kind="stable")
        mat = np.ascontiguousarray(flat.reshape(len(pos), -1)[order])
        out = {c: table.column(c).slice(0, 1) for c in keys}
        return pa.table({**out, "pos": pa.array([pos[order].tobytes()], pa.binary()), "mat": pa.array([mat.tobytes()], pa.binary())})

    return pack


def _pack(side: DataFrame, keys: dict[str, F.Column], pos: str, tiles: F.Column) -> DataFrame:
    """One row per tile: its keys, positions and matrix as bytes.  Membership is a hash of the
    position, so the size of a tile is bounded in expectation whatever the data."""
    cols = {**keys, "tile": F.pmod(F.xxhash64(F.lit(7), pos), tiles).cast("int")}
    types = {"code": "string", "gi": "int", "gj": "int", "tile": "int"}
    rows = side.select(*[c.alias(n) for n, c in cols.items()], F.col(pos).alias("pos"), "vec")
    schema = ", ".join(f"{n} {types[n]}" for n in cols) + ", pos binary, mat binary"
    return rows.groupBy(*cols).applyInArrow(_pack_tile(list(cols)), schema)


def tile_rows(dim: int, most: int) -> int:
    return max(1, min(most, TILE_BYTES // (4 * max(dim, 1))))


def grid(n_pivot: int, n_other: dict[str, int], dim: int, target: int) -> tuple[int, dict[str, int]]:
    """Rows and, per language, columns of the grid: cells of at most ``CELL_BYTES`` a side, cut
    finer on the pivot side while there are fewer cells than ``target``."""
    rows = max(16, min(16384, CELL_BYTES // (4 * max(dim, 1))))
    gi = max(1, -(-n_pivot // rows))
    gj = {c: max(1, -(-n // rows)) for c, n in n_other.items()}
    cells = gi * sum(gj.values())
    if cells < target:
        gi = max(gi, min(n_pivot, -(-gi * target // cells)))
    return gi, gj


def block_scores(pivot: DataFrame, other: DataFrame, k: int = 5, excluded: DataFrame | None = None) -> DataFrame:
    """Winners of every grid cell: ``code, kind, a, b, score``; kind 0 = a pivot row's top-k in the
    cell, kind 1 = a column's best pivot in the cell.

    ``pivot``: ``a, vec``; ``other``: ``code, b, vec``; ``excluded``: ``code, a``, pivot rows that do
    not take part for a language.
    """
    spark = pivot.sparkSession
    counts = {r["code"]: r["n"] for r in other.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}     # one row per language
    size = pivot.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not counts or not size["n"]:
        return spark.createDataFrame([], KERNEL_SCHEMA)
    dim = size["dim"] or 1
    other_rows = tile_rows(dim, MAX_OTHER_BLOCK_ROWS)
    gi, gj = grid(size["n"], counts, dim, 2 * spark.sparkContext.defaultParallelism)
    columns = F.element_at(F.create_map(*[F.lit(x) for kv in gj.items() for x in kv]), F.col("code"))
    row_of = F.pmod(F.xxhash64("a"), F.lit(gi)).cast("int")
    col_of = F.pmod(F.xxhash64("b"), columns).cast("int")
    per_cell = max(1, -(-size["n"] // gi))
    ptiles = _pack(pivot.select("a", "vec"), {"gi": row_of}, "a", F.lit(max(1, -(-per_cell // tile_rows(dim, MAX_PIVOT_BLOCK_ROWS)))))
    per_column = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, -(-(-(-n // gj[c])) // other_rows)))]), F.col("code"))
    otiles = _pack(other, {"code": F.col("code"), "gj": col_of}, "b", per_column)
    per_language = [F.arrays_zip(F.array_repeat(F.lit(c), n).alias("code"), F.sequence(F.lit(0), F.lit(n - 1)).alias("gj")) for c, n in gj.items()]
    cells = F.explode(F.flatten(F.array(*per_language)))
    left = ptiles.select(cells.alias("cell"), "gi", "pos", "mat").select(
        "cell.code", "gi", "cell.gj", "pos", "mat", F.lit(None).cast("array<bigint>").alias("gone"))
    if excluded is not None:
        gone = excluded.select("code", row_of.alias("gi"), "a").where(F.col("code").isin(*counts)).groupBy("code", "gi").agg(F.collect_list("a").alias("gone"))
        none = F.lit(None).cast("binary")
        gone = gone.select("code", "gi", F.explode(F.sequence(F.lit(0), columns - 1)).alias("gj"), none.alias("pos"), none.alias("mat"), "gone")
        left = left.unionByName(gone)
    right = otiles.select("code", F.explode(F.sequence(F.lit(0), F.lit(gi - 1))).alias("gi"), "gj", "pos", "mat")
    return left.groupBy("code", "gi", "gj").cogroup(right.groupBy("code", "gi", "gj")).applyInArrow(_cell(k), KERNEL_SCHEMA)


def topk_from_scores(scores: DataFrame, k: int = 5) -> DataFrame:
    """Top-k per pivot row over all block pairs (W1): ``code, a, b, score, rank``."""
    w = Window.partitionBy("code", "a").orderBy(F.col("score").desc(), F.col("b").asc())
    return (
        scores.where(F.col("kind") == 0).select("code", "a", "b", "score")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def best_pivot_from_scores(scores: DataFrame) -> DataFrame:
    """Best pivot per other row (A10), ties to the lowest pivot: ``code, b, a, score``."""
    return (
        scores.where(F.col("kind") == 1)
        .groupBy("code", "b")
        .agg(F.max(F.struct(F.col("score"), (-F.col("a")).alias("na"))).alias("m"))
        .select("code", "b", (-F.col("m.na")).alias("a"), F.col("m.score").alias("score"))
    )


def topk_similarity(pivot: DataFrame, other: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(top-k per pivot row, best pivot per other row) of the cosine join; every pivot row meets
    every language of ``other`` (a ``code`` column of ``pivot`` is not looked at)."""
    scores = block_scores(pivot.select("a", "vec"), other, k)
    return topk_from_scores(scores, k), best_pivot_from_scores(scores)
