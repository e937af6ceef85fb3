"""Substring dedup: Rabin-Karp hashes of every fixed-length token window.

Which words go: a word is removed if some window of ``size`` consecutive words covers it
whose word sequence also starts in a document with a smaller id.  Windows are judged on the
input texts.

How: (1) exact copies of a text with a smaller id lose every window at once and take no
further part.  (2) Each window is anchored at the smallest hash among the ``ANCHOR``-word
sequences inside it; equal windows have equal anchors, so windows whose anchor stands in one
document only cannot repeat.  Anchors (about one per six words) are grouped in Spark.
(3) The windows that are left, all of them, are hashed (Rabin-Karp, 64 bits) and grouped in
Spark; each row learns the smallest document its window starts in.  (4) The hashes to remove
go back to their document, where repeated windows merge into maximal intervals.

Scale: no all-pairs rows; a hot passage sends one row per map chunk to its group, the rest
are decided inside the chunk (``common.chunk_leaders``).  Texts are shuffled twice, packed
with zstd.  Two different windows count as equal with probability 2**-64 a pair.

Edge cases: null or empty text has no words; fewer words than ``size`` means no window; a
null id has no smaller id and is nobody's smaller id, its text is kept whole; rows that share
an id never remove words of each other.  Extra columns are ignored by ``removals`` and kept
by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADER_SCHEMA, checkpointed, first_of_key, leaders_of, packed_texts, tidy
from .words import Block, inside_row, int_column, text_words, unique_pairs, window_hashes, word_blocks

SIZE = 13
ANCHOR = 5
CHUNK = 1 << 18        # entries whose leaders are found at once


def anchors(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of every window of the block: the smallest hash of the ``ANCHOR``-word
    sequences inside the window."""
    k = min(ANCHOR, size)
    n = len(block.words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = window_hashes(block.words, k)
    low = short[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(low, short[j: j + n], out=low)
    ok = inside_row(block.row, size)
    return low[ok], block.row[:n][ok]


def _anchor_rows(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for block in word_blocks(batches, "id", "text"):
                key, row = unique_pairs(*anchors(block, size))
                yield key, block.ids[row]
        yield from leaders_of(pairs(), CHUNK)
    return run


def _bytes(packed: bytes | None, unpack: zstandard.ZstdDecompressor) -> bytes:
    return b"" if packed is None else unpack.decompress(packed)


def _hash_sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """One array of hashes per row of an ``array<bigint>`` column (null: none)."""
    return [np.zeros(0, np.uint64) if h is None or not h.is_valid else h.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for h in batch.column(column)]


def _window_rows(size: int):
    """Windows whose anchor is shared, as leader rows."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def pairs():
            for batch in batches:
                ids, _ = int_column(batch.column("id"))
                for i, (packed, shared) in enumerate(zip(batch.column("packed").to_pylist(), _hash_sets(batch, "keys"))):
                    words = text_words(np.frombuffer(_bytes(packed, unpack), np.uint8))
                    one = Block(ids[i:i + 1], np.zeros(1, bool), words, np.zeros(len(words), np.int64))
                    anchor, _ = anchors(one, size)
                    h = np.unique(window_hashes(words, size)[np.isin(anchor, shared)])
                    yield h, np.full(len(h), ids[i])
        yield from leaders_of(pairs(), CHUNK)
    return run


def _intervals(covered_starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether each of ``n`` words is covered by a window at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, covered_starts, 1)
    np.add.at(edge, covered_starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(size: int, with_text: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_removed, digest, text = [], [], [], []
            gone = batch.column("copy").to_pylist()
            for i, (packed, hashes) in enumerate(zip(batch.column("packed").to_pylist(), _hash_sets(batch, "keys"))):
                raw = _bytes(packed, unpack)
                words = raw.split()           # bytes.split() cuts at \\x20 \\x09-\\x0D only
                cut = np.zeros(len(words), bool)
                if gone[i] and len(words) >= size:
                    cut[:] = True
                elif len(hashes):
                    h = window_hashes(text_words(np.frombuffer(raw, np.uint8)), size)
                    cut = _intervals(np.flatnonzero(np.isin(h, hashes)), size, len(words))
                left = b" ".join(words if not cut.any() else [w for w, c in zip(words, cut) if not c])
                n_words.append(len(words))
                n_removed.append(int(cut.sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    text.append(left.decode() if cut.any() else None)
            out = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(text, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``id, copy, keys``: for each document that loses words, whether it is an exact copy of a
    text with a smaller id, else the hashes of the windows to remove."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    sig = d.select("id", F.xxhash64("text").alias("s1"), F.crc32(F.coalesce("text", F.lit(""))).alias("s2"),
                   F.length("text").alias("s3")).where("s3 > 0")
    sig = checkpointed(sig)
    firsts = sig.groupBy("s1", "s2", "s3").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = checkpointed(sig.join(firsts, ["s1", "s2", "s3"]).where("id > first").select("id").distinct())
    rows = d.mapInArrow(_anchor_rows(size), LEADER_SCHEMA)
    shared = first_of_key(rows).where("shared").groupBy("doc").agg(F.collect_list("key").alias("keys"))
    # windows of a copy need no row of their own: its original has them under a smaller id
    shared = shared.join(copies.withColumnRenamed("id", "doc"), "doc", "left_anti")
    suspects = packed_texts(docs, id_col, text_col).join(shared, F.col("id") == F.col("doc")).select("id", "packed", "keys")
    windows = suspects.mapInArrow(_window_rows(size), LEADER_SCHEMA)
    again = first_of_key(windows).where("lead < doc OR first < doc").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    found = again.select(F.col("doc").alias("id"), F.lit(False).alias("copy"), "keys")
    return found.unionByName(copies.select("id", F.lit(True).alias("copy"), F.lit(None).cast("array<bigint>").alias("keys"))) \
        .groupBy("id").agg(F.max("copy").alias("copy"), F.first("keys", ignorenulls=True).alias("keys"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_words, n_removed, kept_sha256`` (and ``kept``, the kept words joined by
    one space where any word was removed, else null)."""
    gone = removed_windows(docs, id_col, text_col, size).select(F.col("id").alias("gid"), "copy", "keys")
    joined = packed_texts(docs, id_col, text_col).join(gone, F.col("id") == F.col("gid"), "left").drop("gid")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return joined.mapInArrow(_kept(size, with_text), schema).withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The documents, all columns kept, with removed words cut out of the text.  A text that
    loses no word stays as it is, white space included; a row whose words are all removed goes,
    and so does nothing else."""
    gone = removed_windows(docs, id_col, text_col, size).select(F.col("id").alias("__gid"), F.col("copy").alias("__copy"), F.col("keys").alias("__keys"))
    hit = docs.join(gone, F.col(id_col).cast("long") == F.col("__gid"), "left").select(*docs.columns, "__gid", "__copy", "__keys")
    return hit.mapInArrow(_cut_rows(size, docs.columns, text_col), docs.schema)


def _cut_rows(size: int, columns: list[str], text_col: str):
    """Rows without the words to remove; ``n_chars``, where there is one, follows."""
    def left_of(text: str | None, copy: bool, keys: np.ndarray) -> str:
        raw = (text or "").encode()
        words = raw.split()
        if copy and len(words) >= size:
            return ""
        h = window_hashes(text_words(np.frombuffer(raw, np.uint8)), size)
        gone = _intervals(np.flatnonzero(np.isin(h, keys)), size, len(words))
        return b" ".join([w for w, g in zip(words, gone) if not g]).decode() if gone.any() else text or ""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(i) for i, c in enumerate(columns)}
            mask = pc.is_valid(batch.column("__gid"))
            hit = batch.filter(mask)
            if hit.num_rows:
                new = [left_of(t, bool(c), k) for t, c, k in zip(
                    hit.column(columns.index(text_col)).to_pylist(), hit.column("__copy").to_pylist(), _hash_sets(hit, "__keys"))]
                out[text_col] = pc.replace_with_mask(out[text_col], mask, pa.array(new, out[text_col].type))
                if "n_chars" in out:
                    out["n_chars"] = pc.replace_with_mask(out["n_chars"], mask, pa.array([len(t) for t in new]).cast(out["n_chars"].type))
                keep = np.ones(batch.num_rows, bool)
                keep[np.flatnonzero(mask.to_numpy(zero_copy_only=False))] = [bool(t) for t in new]
                yield pa.RecordBatch.from_arrays(list(out.values()), names=columns).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    return run
