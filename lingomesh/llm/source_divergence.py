"""Source divergence audit: terms counted by length-bucketed packing, sources compared exactly.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A map task packs the terms of a chunk
by length: up to 8 bytes into one uint64, up to 16 bytes into two, both sorted by radix (16 bits
a pass, least first); longer terms into buckets of fixed width that doubles, sorted as bytes.  The last passes of
each sort are by group, and every pass is stable, so that a run of equal terms lists its documents in
order: its length is the count, the number of different documents in it the document count.  Terms hold
no zero byte, so padding with zeros is exact.

Runs are summed in Spark by ``(lang, source, term)``.  Per language the ``V`` terms that stand in ``least`` documents
or more are kept; ``N`` is the sum of a group's counts over them.  With ``p = 1 + floor(SCALE (count + 1) / (N + V))``
and ``f = floor((p - q)(p - q) / q)``:

* part ``pair``: for every group and every other source of its language ``q`` is that source's and ``f`` is summed over
  all kept terms;
* part ``term``: for every group the kept terms it has with ``p`` above the language's ``q``, by ``f``, the first ``top``.

Edge cases: null text, language and source read as empty; a document is a row, rows that repeat count each time; empty
texts and texts without terms still make their group; a language without kept terms has pair values of 0; an empty
table gives no row.  Ids and extra columns are not read.  All arithmetic is in whole numbers (64 bits, 38 digits where a
product may pass them), exact while a language holds less than 10**15 terms.

Scale: one pass over the texts, map-side runs; hot terms send one row per chunk and group, and no key of a shuffle is a
language or source alone but for sums with partial aggregation, joins that adaptive execution may split,
and the ranking of a group's ``top`` terms.  Sources are compared block by block of terms and tile by tile of sources; tasks hold about
``BLOCK_TERMS`` x ``TILE`` numbers a side.  The result has a row for every two sources of a language, as the contract asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, first_of_group
from .words import BLOCK, LOWER, U, text_buffers

SCALE = 1_000_000_000
LEAST = 3
TOP = 200
TILE = 256
BLOCK_TERMS = 4096
CHUNK = 1 << 20           # terms
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by several unsigned columns, the last one first in rank, sixteen bits a pass."""
    n = len(digits[0])
    order = np.arange(n)
    for column in digits:
        top = int(column.max()) if n else 0
        for shift in range(0, max(top.bit_length(), 1), 16):
            digit = ((column >> column.dtype.type(shift)) & column.dtype.type(0xFFFF)).astype(np.uint16)[order]
            if n and (digit != digit[0]).any():
                order = order[np.argsort(digit, kind="stable")]       # numpy sorts 16-bit numbers by radix
    return order


def pack(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans of at most eight bytes as big-endian uint64, zeros behind (a span of no byte is 0)."""
    out = np.zeros(len(start), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        at = np.flatnonzero(size > k)
        out[at] |= raw[start[at] + k].astype(np.uint64) << U(56 - 8 * k)
    return out


class Chunk:
    """Terms of some documents by length bucket: 1 and 2 for one and two words, else the width in bytes.  A bucket
    holds ``(words, document, group, occurrences)`` in the order of the documents."""

    def __init__(self):
        self.parts: dict[int, list[tuple]] = {}
        self.held = 0
        self.limit = CHUNK

    def add(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, group: np.ndarray) -> None:
        def put(bucket: int, at: np.ndarray, words: list[np.ndarray]) -> None:
            self.parts.setdefault(bucket, []).append((words, doc[at], group[at], np.ones(len(at), np.int64)))

        self.held += len(start)
        for bucket, low, high in ((1, 0, 8), (2, 8, 16)):
            at = np.flatnonzero((size > low) & (size <= high))
            if len(at):
                s, n = start[at], size[at]
                put(bucket, at, [pack(raw, s, np.minimum(n, 8))] + ([pack(raw, s + 8, n - 8)] if bucket == 2 else []))
        long = np.flatnonzero(size > 16)
        width = np.array([1 << (int(n) - 1).bit_length() for n in size[long]], np.int64)
        for w in np.unique(width).tolist():
            at = long[width == w]
            rows = np.zeros((len(at), w), np.uint8)
            for k, (s, n) in enumerate(zip(start[at].tolist(), size[at].tolist())):
                rows[k, :n] = raw[s: s + n]
            put(w, at, [rows.reshape(-1).view(f"S{w}")])

    def _sorted(self, bucket: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, documents, groups and occurrences by group, term and document, where a run of a term and where a
        document in it begins."""
        parts = self.parts[bucket]
        words = [np.concatenate(x) for x in zip(*[p[0] for p in parts])]
        doc, group, n = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        if bucket <= 2:
            order = radix_order([*words[::-1], group.astype(np.uint64)])
        else:
            order = np.argsort(words[0], kind="stable")
            order = order[radix_order([group[order].astype(np.uint64)])]
        words, doc, group, n = [w[order] for w in words], doc[order], group[order], n[order]
        new = np.ones(len(doc), bool)
        new[1:] = group[1:] != group[:-1]
        for w in words:
            new[1:] |= w[1:] != w[:-1]
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        return words, doc, group, n, new, other

    def compact(self) -> None:
        """One entry per term and document, for texts whose terms would not fit a chunk."""
        for bucket in self.parts:
            words, doc, group, n, _, other = self._sorted(bucket)
            self.parts[bucket] = [([w[other] for w in words], doc[other], group[other], np.add.reduceat(n, np.flatnonzero(other)))]
        self.held = sum(len(p[1]) for parts in self.parts.values() for p in parts)
        self.limit = max(CHUNK, 2 * self.held)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """``(group, count, documents, term)`` of every run of every bucket."""
        for bucket in self.parts:
            words, _, group, n, new, other = self._sorted(bucket)
            first = np.flatnonzero(new)
            yield group[first], np.add.reduceat(n, first), np.add.reduceat(other.astype(np.int64), first), unpacked([w[first] for w in words])


def unpacked(words: list[np.ndarray]) -> pa.Array:
    """The terms that packed words or fixed-width bytes stand for."""
    if words[0].dtype.kind == "S":
        return pa.array(words[0].tolist(), pa.binary()).cast(pa.string())
    raw = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(len(words[0]), -1)
    full = raw != 0
    ends = np.concatenate(([0], np.cumsum(full.sum(axis=1)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[full])))


def _term_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = TERM[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def _long_text(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text that cut no term."""
    lo = 0
    while lo < len(raw):
        hi = min(lo + BLOCK, len(raw))
        while hi < len(raw) and TERM[raw[hi]]:
            hi += 1
        yield raw[lo:hi]
        lo = hi


ROW = "lang string, source string, term string, n long, docs long"
NAMES = ["lang", "source", "term", "n", "docs"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, term, n, docs`` of the runs of each chunk of whole documents, and a row without a term for
    every group of the task."""
    groups: dict[tuple, int] = {}
    chunk, seen = Chunk(), 0

    def rows(group: np.ndarray, term: pa.Array, count: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([x[k] for x in groups], pa.string()) for k in (0, 1))
        for k in range(0, len(group), 1 << 15):
            part = slice(k, k + (1 << 15))
            at = pa.array(group[part])
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term[part], pa.array(count[part]), pa.array(docs[part])], names=NAMES)

    def flush() -> Iterator[pa.RecordBatch]:
        for group, count, docs, term in chunk.runs():
            yield from rows(group, term, count, docs)

    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        group = np.array([groups.setdefault(k, len(groups)) for k in keys], np.int64)
        raw, off = text_buffers(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1, i + 1)
            part = LOWER[raw[off[i]: off[j]]]
            if j > i + 1:
                at = off[i: j + 1] - off[i]
                part = np.insert(part, at[1:-1], 32)
                start, size = _term_spans(part)
                row = i + np.searchsorted(at[:-1] + np.arange(j - i), start, "right") - 1
                chunk.add(part, start, size, seen + row, group[row])
            else:                                     # a text stays in one chunk, however long it is
                for piece in _long_text(part):
                    if chunk.held >= chunk.limit:
                        chunk.compact()
                    start, size = _term_spans(piece)
                    chunk.add(piece, start, size, np.full(len(start), seen + i), np.full(len(start), group[i]))
            if chunk.held >= CHUNK:
                yield from flush()
                chunk = Chunk()
            i = j
        seen += batch.num_rows
    yield from flush()
    zero = np.zeros(len(groups), np.int64)
    yield from rows(np.arange(len(groups)), pa.nulls(len(groups), pa.string()), zero, zero)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term of every group, and a row with a null term for
    every group."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return d.mapInArrow(_counted, ROW).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> F.Column:
    """``1 + floor(SCALE (n + 1) / (total + kept))`` as a long."""
    return F.expr(f"1 + cast((cast({SCALE} as decimal(38,0)) * ({n} + 1)) div (cast({total} as decimal(38,0)) + {kept}) as long)")


def _gap(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


class Shares:
    """Groups and terms with their shares, written once.

    ``groups``: ``lang, source, p0, kept`` (share of a term that the group lacks; kept terms of the language);
    ``terms``: ``lang, source, term, n, p, q`` of the kept terms that a group has.
    """

    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, source_col: str, least: int):
        counts = checkpointed(term_counts(docs, text_col, lang_col, source_col))
        has = counts.where("term IS NOT NULL")
        kept = has.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        kept = checkpointed(kept.select(F.col("lang").alias("__l"), F.col("term").alias("__t"), "all"))
        langs = kept.groupBy("__l").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_n"))
        own = has.join(kept, (F.col("lang") == F.col("__l")) & (F.col("term") == F.col("__t"))).drop("__l", "__t", "docs")
        sums = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        every = counts.where("term IS NULL").select(F.col("lang").alias("__g"), F.col("source").alias("__s"))
        groups = every.join(sums, (F.col("__g") == F.col("lang")) & (F.col("__s") == F.col("source")), "left").drop("lang", "source")
        groups = groups.join(langs, F.col("__g") == F.col("__l"), "left").na.fill(0, ["group_n", "kept", "lang_n"])
        p0 = F.when(F.col("kept") > 0, F.expr(f"1 + cast(cast({SCALE} as decimal(38,0)) div (group_n + greatest(kept, 1)) as long)"))
        self.groups = checkpointed(groups.select(F.col("__g").alias("lang"), F.col("__s").alias("source"), "group_n", "kept", "lang_n", p0.alias("p0")))
        g = self.groups.select(F.col("lang").alias("__g"), F.col("source").alias("__s"), "group_n", "kept", "lang_n")
        terms = own.join(g, (F.col("lang") == F.col("__g")) & (F.col("source") == F.col("__s")))
        self.terms = checkpointed(terms.select("lang", "source", "term", "n", _share("n", "group_n", "kept").alias("p"), _share("all", "lang_n", "kept").alias("q")))


def _tile_sums(head: pa.Table, rows: pa.Table, names: list[str]) -> pa.Table:
    """For one block of terms and two tiles of sources: the sum over the block's terms of ``f`` less ``f`` of two absent terms.
    Of a tile with itself there is a left side only."""
    lang, a, b, total = [], [], [], []
    sides = (0, 1) if head.num_rows and head.column("i")[0] != head.column("j")[0] else (0, 0)
    side, source = head.column("side").to_numpy(), head.column("source").to_pylist()
    p0 = head.column("p0").to_numpy()
    if rows.num_rows and len(source):
        number, terms = np.unique(np.array(rows.column("term").to_pylist(), object), return_inverse=True)
        grid = []
        for s in sides:
            at = np.flatnonzero(side == s)
            known = {source[k]: c for c, k in enumerate(at.tolist())}
            dense = np.repeat(p0[at][None, :], len(number), axis=0)
            mine = np.flatnonzero(rows.column("side").to_numpy() == s)
            who = rows.column("source").to_pylist()
            dense[terms[mine], [known[who[k]] for k in mine.tolist()]] = rows.column("p").to_numpy()[mine]
            grid.append((list(known), p0[at], dense))
        (left, left0, x), (right, right0, y) = grid
        for c, name in enumerate(left):
            d, d0 = x[:, [c]] - y, left0[c] - right0
            sums = (d * d // y).sum(axis=0) - len(number) * (d0 * d0 // right0)
            some = sums != 0
            a += [name] * int(some.sum())
            b += [right[k] for k in np.flatnonzero(some)]
            total += sums[some].tolist()
        lang = [head.column("lang")[0].as_py()] * len(a)
    return pa.table([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(total, pa.int64())], names=names)


def pair_values(shares: Shares, tile: int = TILE, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language.

    What two absent terms give is the same for all terms, so it is multiplied by the number of kept terms; the grid of
    (term block, source tile, source tile) adds how far the terms that occur differ from it.
    """
    most = shares.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("kept").alias("v")).agg(F.max("s").alias("s"), F.max("v").alias("v")).first()
    tiles, blocks = -(-(most["s"] or 1) // tile), max(1, -(-(most["v"] or 0) // block_terms))
    at = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))

    def dealt(df: DataFrame) -> DataFrame:
        """Every row as the left side of the tiles (own, any) and as the right side of (any, own), if that is another tile."""
        df = df.withColumn("own", at).withColumn("any", other)
        left = df.withColumn("side", F.lit(0)).withColumn("i", F.col("own")).withColumn("j", F.col("any"))
        right = df.withColumn("side", F.lit(1)).withColumn("i", F.col("any")).withColumn("j", F.col("own")).where("any <> own")
        return left.unionByName(right).drop("own", "any")

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    rows = dealt(shares.terms.select("lang", "source", "term", "p", block.alias("block")))
    heads = dealt(shares.groups.where("kept > 0").select("lang", "source", "p0", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    where, names = ["lang", "block", "i", "j"], ["lang", "source", "item", "more"]

    def sums(head: pa.Table, terms: pa.Table) -> pa.Table:
        return _tile_sums(head, terms, names)

    more = heads.groupBy(*where).cogroup(rows.groupBy(*where)).applyInArrow(sums, "lang string, source string, item string, more long")
    more = more.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    a = shares.groups.select("lang", "source", "p0", "kept")
    b = shares.groups.select(F.col("lang").alias("__l"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = a.join(b, (F.col("lang") == F.col("__l")) & (F.col("source") != F.col("item"))).drop("__l")
    m = more.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("item").alias("__i"), "more")
    pairs = pairs.join(m, (F.col("lang") == F.col("__l")) & (F.col("source") == F.col("__s")) & (F.col("item") == F.col("__i")), "left")
    value = F.when(F.col("kept") > 0, F.col("kept") * _gap("p0", "q0") + F.coalesce("more", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return pairs.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``."""
    shares = Shares(docs, text_col, lang_col, source_col, least)
    group, order = ["lang", "source"], [F.desc("value"), "item"]
    pairs = pair_values(shares).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("part", F.lit("pair"))
    terms = shares.terms.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    terms = first_of_group(terms, group, order, top, "item").withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
