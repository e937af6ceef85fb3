"""Word splitting and Rabin-Karp hashing of whole Arrow text columns with numpy.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` (the UTF-8 form of
``[^\\x20\\x09-\\x0D]+``).  Word hashes are polynomials over a fixed random byte table,
window hashes are polynomials over word hashes, both modulo 2**64 with a final mix.
Texts are worked through in blocks of a few MB, so the memory beyond the eight bytes
kept per word does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240917))
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
WINDOW_BASE = U(0xD1342543DE82EF95)


class Block(NamedTuple):
    """Words of some consecutive rows: ids (int64), whether the id is null, the hash of
    every word in reading order and the index (into ``ids``) of the row it stands in."""

    ids: np.ndarray
    null: np.ndarray
    words: np.ndarray
    row: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def int_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and null mask of an integer column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return (col.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False),
            col.is_null().to_numpy(zero_copy_only=False))


def binary_array(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary column whose row i holds the bytes of ``flat[starts[i]:starts[i + 1]]``."""
    data = np.ascontiguousarray(flat)
    offsets = np.ascontiguousarray(starts * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = is_space(raw)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every (non-empty) span."""
    if not start.size:
        return np.zeros(0, np.uint64)
    n = end - start
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    return mix(np.add.reduceat(BYTE_CODE[raw[np.repeat(start, n) + within]] * powers(BASE, int(n.max()))[within], first))


def _cuts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of one long text that end behind white space (or at its end)."""
    lo = 0
    while len(raw) - lo > BLOCK:
        cut = lo + BLOCK
        while cut < len(raw):
            gap = np.flatnonzero(is_space(raw[cut: cut + 65536]))
            if gap.size:
                cut += int(gap[0]) + 1
                break
            cut = min(cut + 65536, len(raw))
        yield raw[lo:cut]
        lo = cut
    yield raw[lo:]


def text_words(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """One hash per word of one text of any length."""
    parts = [span_hashes(b, *spans(b)) for b in _cuts(LOWER[raw] if lower else raw)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def word_blocks(batches: Iterable[pa.RecordBatch], id_column: str, text_column: str, lower: bool = False) -> Iterator[Block]:
    """Rows gathered into blocks of about ``BLOCK`` bytes of text; a longer text stands alone."""
    for batch in batches:
        raw, off = text_buffers(batch.column(text_column))
        ids, null = int_column(batch.column(id_column))
        i = 0
        while i < len(ids):
            j = max(int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1, i + 1)
            part = raw[off[i]: off[j]]
            if j == i + 1:
                words = text_words(part, lower)
                yield Block(ids[i:j], null[i:j], words, np.zeros(len(words), np.int64))
            else:
                at = off[i:j + 1] - off[i]
                part = np.insert(LOWER[part] if lower else part, at[1:-1], 32)      # a gap between rows
                start, end = spans(part)
                row = np.searchsorted(at[:-1] + np.arange(j - i), start, "right") - 1
                yield Block(ids[i:j], null[i:j], span_hashes(part, start, end), row)
            i = j


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words (none if there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(WINDOW_BASE, size)):
        h += words[k: k + n] * p
    return mix(h)


def inside_row(row: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of ``size`` words from each start stays in one row."""
    return row[: len(row) - size + 1] == row[size - 1:] if len(row) >= size else np.zeros(0, bool)


def unique_pairs(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, group), ordered by group, then key."""
    order = np.lexsort((key, group))
    key, group = key[order], group[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return key[new], group[new]
