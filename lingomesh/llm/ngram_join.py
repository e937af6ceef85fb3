"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Two documents link when the Jaccard similarity of their sets of distinct five-word shingles
(A-Z lower-cased) is ``THRESHOLD`` per cent or more.  ``classes`` returns one row per document
with the smallest id that links reach from it; copies are not expanded into pairs.

How:

1. A first pass makes, per document, its set size and a 128-bit set signature, and finds frequent
   shingles.  Equal sets collapse to their smallest document.
2. A second pass makes a hashed bitmap whose width follows the set's size, and the *prefix*: the
   first ``n - ceil(0.8 n) + 1`` shingles in one global order (frequent shingles last, else by
   hash).  Sets with Jaccard >= 0.8 share a prefix shingle in any global order, so no link is lost.
3. Prefix shingles are grouped in Spark.  First every document meets only the smallest document
   of each of its groups (a star, not all pairs); bitmap bit counts bound the overlap from above,
   survivors get an exact sorted-array intersection, links become components.
4. Groups that still hold several components are tiled: a group of up to ``TILE`` documents is one
   tile, a larger one is cut into size bands and blocks.  Inside a tile only pairs of different
   components and compatible sizes are compared by bitmap, and only those that pass the bound
   leave it for the exact step.

Scale: a shingle that stands in a 512th of all documents is put last in the order; the list of
those holds at most 512 x (mean set size) hashes whatever the number of documents, and is the
only thing broadcast.  Groups of a hot shingle are decided inside the map chunks (see
``common.chunk_leaders``), big residual groups are split into blocks, small ones with one first
component are dealt into bins of about ``BIN`` members.

Edge cases: null or empty text has an empty set and links with nothing; one to four words make
one shingle of the whole sequence; a null id links with nothing and has a null component; rows
that share an id share its links.  Equal texts always link.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEADER_SCHEMA, Scratch, components, first_of_key, leaders_of, packed_texts, tidy
from .words import U, Block, binary_array, inside_row, int_column, mix, text_words, unique_pairs, window_hashes, word_blocks

SHINGLE = 5
THRESHOLD = 80            # per cent
FREQUENT = 512            # a shingle in one of so many documents is ordered last
TILE = 1024
BIN = 4 * TILE            # members of small groups that are looked at together
SALTS = 32
CHUNK = 1 << 19           # prefix rows whose leaders are found at once
FOLD = 1 << 20            # values of the folded list of rows that go
BAND = float(np.log(100 / THRESHOLD)) * 1.0001    # a little wider, so that rounding parts no pair


def shingle_sets(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle hash, row), ordered by row, then hash."""
    n = len(block.words) - size + 1
    if n > 0:
        ok = inside_row(block.row, size)
        h, row = window_hashes(block.words, size)[ok], block.row[:n][ok]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(block.row, minlength=len(block.ids))
    short = np.flatnonzero((count > 0) & (count < size))
    if short.size:
        first = np.searchsorted(block.row, short)
        own = [window_hashes(block.words[f: f + c], c)[0] ^ U(c) for f, c in zip(first, count[short])]
        h, row = np.concatenate((h, np.array(own, np.uint64))), np.concatenate((row, short))
    return unique_pairs(h, row)


def signatures(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums per set."""
    sums = (np.concatenate(([U(0)], np.cumsum(mix(h ^ U(c)), dtype=np.uint64))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return tuple((s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums)


@tidy
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: a row ``id, n, sig1, sig2`` per document, and rows ``key, often`` for shingles in
    one of ``FREQUENT`` documents of a chunk: whatever is that frequent in the whole table is so in
    one chunk at least."""
    names = ["id", "n", "sig1", "sig2", "key", "often"]

    def flush(parts, docs):
        key, count = np.unique(np.concatenate(parts), return_counts=True)
        many = count >= max(2, docs / FREQUENT)
        k, none = int(many.sum()), pa.nulls(int(many.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none] * 4 + [pa.array(key[many].view(np.int64)), pa.array(count[many].astype(np.int64))], names=names)

    parts, held, docs = [], 0, 0
    for block in word_blocks(batches, "id", "text", lower=True):
        h, row = shingle_sets(block)
        n = np.bincount(row, minlength=len(block.ids))
        sig1, sig2 = signatures(h, np.concatenate(([0], np.cumsum(n))))
        none = pa.nulls(len(block.ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(block.ids, mask=block.null), pa.array(n), pa.array(sig1), pa.array(sig2), none, none], names=names)
        parts.append(h)
        held += len(h)
        docs += len(block.ids)
        if held >= 1 << 20:
            yield flush(parts, docs)
            parts, held, docs = [], 0, 0
    if parts:
        yield flush(parts, docs)


def bitmaps(h: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Per row a bitmap of the power of two of bits that is at least four times the set's size."""
    n = np.diff(starts)
    width = 1 << np.ceil(np.log2(np.clip(4 * n, 64, 1 << 17))).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    at = (h & (U(1 << 18) - U(1))).astype(np.int64) & (width[row] - 1)
    first = np.concatenate(([0], np.cumsum(width)))
    bits = np.zeros(int(first[-1]), np.uint8)
    bits[first[row] + at] = 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[a // 8: b // 8] for a, b in zip(first[:-1], first[1:])]


def _sketches(frequent):
    """Pass over all texts: id, set size, set signature, prefix and bitmap."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for block in word_blocks(batches, "id", "text", lower=True):
            h, row = shingle_sets(block)
            n = np.bincount(row, minlength=len(block.ids))
            starts = np.concatenate(([0], np.cumsum(n)))
            sig1, sig2 = signatures(h, starts)
            late = np.isin(h, last, kind="sort") if len(last) else np.zeros(len(h), bool)
            order = np.lexsort((h, late, row))
            rank = np.arange(len(h)) - starts[row]
            want = np.where(n > 0, n - -(-THRESHOLD * n // 100) + 1, 0)
            take = rank < want[row]
            prefix, at = h[order][take], np.concatenate(([0], np.cumsum(want)))
            bits = bitmaps(h, starts)
            for a in range(0, len(block.ids), 4096):
                b = min(a + 4096, len(block.ids))
                yield pa.RecordBatch.from_arrays([
                    pa.array(block.ids[a:b], mask=block.null[a:b]), pa.array(n[a:b]), pa.array(sig1[a:b]), pa.array(sig2[a:b]),
                    binary_array(prefix[at[a]:at[b]], at[a:b + 1] - at[a]), pa.array(bits[a:b], pa.binary())],
                    names=["id", "n", "sig1", "sig2", "prefix", "bits"])
    return run


@tidy
def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for batch in batches:
            ids, _ = int_column(batch.column("id"))
            parts = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            if parts:
                yield np.concatenate(parts), np.repeat(ids, [len(p) for p in parts])
    yield from leaders_of(pairs(), CHUNK)


def linked(n_a, n_b, overlap):
    """100 * intersection >= THRESHOLD * union, in whole numbers."""
    return (100 + THRESHOLD) * overlap >= THRESHOLD * (n_a + n_b)


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """OR the bitmaps (rows of uint64) down to ``width`` words."""
    return bits if bits.shape[1] == width else np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1)


def may_link(n_a, n_b, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound on the overlap from bit counts (rows of equal width): a bit set in one bitmap
    only stands for a shingle the other set lacks."""
    both = np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)
    only_a = np.bitwise_count(a).sum(axis=-1, dtype=np.int64) - both
    only_b = np.bitwise_count(b).sum(axis=-1, dtype=np.int64) - both
    return linked(n_a, n_b, np.minimum(n_a - only_a, n_b - only_b))


def _words64(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


@tidy
def _bounded_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        bits_a, bits_b = _words64(batch.column("ba")), _words64(batch.column("bb"))
        wa, wb = (np.array([len(x) for x in y], np.int64) for y in (bits_a, bits_b))
        keep = np.zeros(len(na), bool)
        for u, v in set(zip(wa.tolist(), wb.tolist())):
            at = np.flatnonzero((wa == u) & (wb == v))
            w = min(u, v)
            keep[at] = may_link(na[at], nb[at], _fold(np.stack([bits_a[i] for i in at]), w), _fold(np.stack([bits_b[i] for i in at]), w))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


@tidy
def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted shingle hashes of packed texts."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        ids, _ = int_column(batch.column("id"))
        for lo in range(0, len(ids), 256):
            sets = []
            for packed in batch.column("packed")[lo: lo + 256].to_pylist():
                words = text_words(np.frombuffer(b"" if packed is None else unpack.decompress(packed), np.uint8), lower=True)
                h, _ = shingle_sets(Block(ids[:1], np.zeros(1, bool), words, np.zeros(len(words), np.int64)))
                sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo: lo + 256]), pa.array(sets, pa.binary())], names=["sid", "shingles"])


@tidy
def _exact_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(_words64(batch.column("sa")), _words64(batch.column("sb"))):
            keep.append(bool(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compare(tile, src, n, comp, left, right, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs that share a tile, are in different components and pass the bound.

    ``tile`` (sorted) and ``src`` say which row stands in which tile; entries ``d`` apart are
    paired for all tiles at once, for d = 1, 2, … up to the longest tile.  A pair that shares many
    tiles is looked at once.
    """
    end = np.searchsorted(tile, tile, "right")
    size = len(rows)
    found = np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    i, d = np.arange(len(tile)), 1
    while True:
        i = i[end[i] - i > d]
        if not i.size:
            break
        j = i + d
        x, y = src[i], src[j]
        lo, hi = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        ok = ((left[i] & right[j]) | (right[i] & left[j])) & (comp[x] != comp[y]) & (100 * lo >= THRESHOLD * hi)
        waiting.append(np.minimum(x[ok], y[ok]) * size + np.maximum(x[ok], y[ok]))
        if sum(map(len, waiting)) > 1 << 20:
            found, waiting = np.unique(np.concatenate([found, *waiting])), []
        d += 1
    found = np.unique(np.concatenate([found, *waiting]))
    width = np.array([len(r) for r in rows], np.int64)
    out = []
    for k in range(0, len(found), 1 << 13):
        x, y = np.divmod(found[k: k + (1 << 13)], size)
        for u, v in set(zip(width[x].tolist(), width[y].tolist())):
            both = (width[x] == u) & (width[y] == v)
            p, q, w = x[both], y[both], min(u, v)
            hit = may_link(n[p], n[q], _fold(np.stack([rows[r] for r in p]), w), _fold(np.stack([rows[r] for r in q]), w))
            out.append(np.stack([p[hit], q[hit]]))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that never cut a run of equal values of the columns."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        last = np.ones(t.num_rows, bool)
        for c in columns:
            v = t.column(c).to_numpy()
            last &= v == v[-1]
        cut = t.num_rows - int(last.sum())
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _numbers(t: pa.Table, columns: list[str]) -> np.ndarray:
    """0, 1, 2, … for the runs of equal values of the columns."""
    new = np.zeros(t.num_rows, bool)
    for c in columns:
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _named(t: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    ids = t.column("id").to_numpy()
    pairs = np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1)
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


@tidy
def _small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``first, bin, id, n, comp, bits, keys`` sorted by ``first, bin``: the tiles are the keys."""
    for t in _runs(batches, ["first", "bin"]):
        lists = t.column("keys").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        key = lists.flatten().to_numpy(zero_copy_only=False)
        src = np.repeat(np.arange(t.num_rows), count)
        run = _numbers(t, ["first", "bin"])[src]
        order = np.lexsort((src, key, run))
        key, src, run = key[order], src[order], run[order]
        new = np.zeros(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        yes = np.ones(len(key), bool)
        yield _named(t, *_compare(np.cumsum(new), src, t.column("n").to_numpy(), t.column("comp").to_numpy(), yes, yes, _words64(t.column("bits"))))


@tidy
def _large_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles ``key, tb, i, j``, sorted by tile."""
    where = ["key", "tb", "i", "j"]
    for t in _runs(batches, where):
        left, right = (t.column(c).to_numpy() for c in ("left", "right"))
        yield _named(t, *_compare(_numbers(t, where), np.arange(t.num_rows), t.column("n").to_numpy(), t.column("comp").to_numpy(), left, right,
                                  _words64(t.column("bits"))))


def _verify(pairs: DataFrame, sketch: DataFrame, packed: DataFrame, stored: Scratch) -> DataFrame:
    """Links among the candidate pairs: bitmap bound, then exact intersection."""
    sa = sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    sb = sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    passed = stored(pairs.join(sa, "a").join(sb, "b").mapInArrow(_bounded_pairs, "a long, b long"))
    need = passed.select(F.col("a").alias("id")).unionByName(passed.select(F.col("b").alias("id"))).distinct()
    # never a broadcast join: packing and unpacking would run in one task, with a Python worker each
    sets = packed.join(need.hint("merge"), "id", "left_semi").mapInArrow(_set_rows, "sid long, shingles binary")
    both = (passed.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b"))
    out = stored(both.mapInArrow(_exact_pairs, "a long, b long").distinct())
    stored.drop(passed)
    return out


def _binned(groups: DataFrame) -> DataFrame:
    """``key, first, k, bin``: the small groups (``k = 1``) of one first component are dealt by key
    into bins of about ``BIN`` members.  Bin counts are copied per salt, so that no first component
    gathers its groups in one task."""
    many = groups.where("k = 1").groupBy("first").agg(F.ceil(F.sum("m") / BIN).cast("int").alias("bins")).where("bins > 1")
    many = many.select(F.col("first").alias("__f"), "bins", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    salt = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SALTS)).cast("int")
    rows = groups.withColumn("salt", salt).join(many, (F.col("first") == F.col("__f")) & (F.col("salt") == F.col("__s")), "left")
    return rows.select("key", "first", "k", F.pmod(F.xxhash64("key"), F.coalesce("bins", F.lit(1))).cast("int").alias("bin"))


def _residual_pairs(shared: DataFrame, comp: DataFrame, sketch: DataFrame, stored: Scratch) -> DataFrame:
    """Pairs of different components in one prefix group, found tile by tile."""
    rows = (shared.select("key", F.col("doc").alias("id")).join(comp, F.col("id") == F.col("node"), "left")
            .select("key", "id", F.coalesce("root", "id").alias("comp")))
    mark = F.xxhash64("id")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"),
                                     F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 30))).alias("s")).where("c1 < c2")
    # shingles of one passage have the same members: one of them stands for all
    groups = groups.groupBy("m", "x", "s").agg(F.min("key").alias("key"), F.min("c1").alias("first")).select(
        "key", "first", "m", F.ceil(F.col("m") / TILE).cast("int").alias("k"))
    groups = _binned(stored(groups))
    rows = stored(rows.join(groups, "key"))
    bits = sketch.select("id", "n", "bits")
    # small groups that begin with the same component mostly hold the same documents: they are looked
    # at together, each document once with the keys it has there; bins bound what one task holds, and
    # a pair found in several bins goes in the distinct below
    small = rows.where("k = 1").groupBy("first", "bin", "id").agg(F.min("comp").alias("comp"), F.collect_list("key").alias("keys")).join(bits, "id")
    small = small.select("first", "bin", "id", "n", "comp", "bits", "keys").repartition("first", "bin").sortWithinPartitions("first", "bin")
    found = small.mapInArrow(_small_groups, "a long, b long")
    rows = rows.where("k > 1").join(bits, "id")
    rows = rows.withColumn("band", F.floor(F.log("n") / F.lit(BAND)).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))

    def role(band, i, j, left, right):
        return F.struct(band.alias("tb"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    # of a group of more than TILE rows, tile (band, i, j) compares block i of the band with block j of
    # the same band (i <= j) and of the next one (any i, j)
    others = F.sequence(F.lit(0), F.col("k") - 1)
    band, block, yes, no = F.col("band"), F.col("block"), F.lit(True), F.lit(False)
    split = F.concat(
        F.transform(others, lambda j: role(band, block, j, yes, j == block)),
        F.filter(F.transform(others, lambda i: role(band, i, block, no, yes)), lambda t: t["i"] < t["j"]),
        F.transform(others, lambda i: role(band - 1, i, block, no, yes)))
    dealt = rows.select("key", "id", "n", "comp", "bits", F.explode(split).alias("t"))
    dealt = dealt.select("key", "id", "n", "comp", "bits", "t.tb", "t.i", "t.j", "t.left", "t.right")
    dealt = dealt.repartition("key", "tb", "i", "j").sortWithinPartitions("key", "tb", "i", "j")
    return found.unionByName(dealt.mapInArrow(_large_groups, "a long, b long")).where("a < b").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sketch, reps, edges)``: the per-row sketches, ``sig1, sig2, rep`` of every distinct set,
    and links ``a, b`` between representatives whose components are those of all links."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs = texts.count()
    stored = Scratch(spark, "ngram")
    survey = stored(texts.mapInArrow(_survey, "id long, n long, sig1 long, sig2 long, key long, often long"))
    often = survey.where("key IS NOT NULL").groupBy("key").agg(F.sum("often").alias("often")).where(F.col("often") >= max(2, n_docs / FREQUENT))
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in often.select("key").collect()], np.int64).view(np.uint64)))
    rows = survey.where("key IS NULL").select("id", "n", "sig1", "sig2")
    reps = stored(rows.where("id IS NOT NULL AND n > 0").groupBy("n", "sig1", "sig2").agg(F.min("id").alias("rep")))
    sketch = texts.where("id IS NOT NULL").mapInArrow(_sketches(frequent), "id long, n long, sig1 long, sig2 long, prefix binary, bits binary")
    sketch = stored(sketch.join(reps.withColumnRenamed("rep", "id"), ["id", "n", "sig1", "sig2"])
                          .dropDuplicates(["id", "n", "sig1", "sig2"]).select("id", "n", "prefix", "bits"))
    known = packed_texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    shared = stored(first_of_key(sketch.select("id", "prefix").mapInArrow(_prefix_rows, LEADER_SCHEMA)).where("shared").select("key", "doc", "lead", "first"))
    star = (shared.select(F.col("doc").alias("b"), F.when(F.col("lead") < F.col("doc"), F.col("lead")).otherwise(F.col("first")).alias("a"))
            .where("a < b").distinct())
    edges = _verify(star, sketch, known, stored)
    comp = components(edges)
    rest = _verify(_residual_pairs(shared, comp, sketch, stored), sketch, known, stored)
    stored.drop(sketch, shared)
    return rows, reps, edges.unionByName(rest)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``."""
    rows, reps, edges = links(docs, id_col, text_col)
    comp = components(edges)
    root = reps.join(comp, F.col("rep") == F.col("node"), "left").select("n", "sig1", "sig2", F.coalesce("root", "rep").alias("component"))
    named = rows.where("id IS NOT NULL").select("id", "n", "sig1", "sig2").join(root, ["n", "sig1", "sig2"], "left")
    out = named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    nulls = rows.where("id IS NULL").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(nulls)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, one row of each group of linked sets: the one with the smallest id (of rows that
    share it, the one with the smallest hash of id and text).  Rows are judged by their own text: of rows that repeat an id and its text
    one stays, rows that share an id but not their text are judged apart.  Rows without a set or an id stay, all of them.

    Most rows do not move: the hashes of the rows that go, folded to ``FOLD`` values, are broadcast, and only rows that meet one
    are joined to the exact list.
    """
    node = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    rows, reps, edges = links(docs.select(node.alias("__node"), F.col(text_col).alias("__text")), "__node", "__text")
    comp = components(edges)
    root = reps.join(comp, F.col("rep") == F.col("node"), "left").select("n", "sig1", "sig2", F.coalesce("root", "rep").alias("component"))
    stored = Scratch(docs.sparkSession, "keep")
    named = rows.where("id IS NOT NULL AND n > 0").groupBy(F.col("id").alias("node"), "n", "sig1", "sig2").agg(F.count(F.lit(1)).alias("copies"))
    named = named.join(root, ["n", "sig1", "sig2"]).select("node", "component", "copies")
    ids = docs.select(node.alias("__node"), F.col(id_col).cast("long").alias("__id")).where("__node IS NOT NULL").distinct()
    named = stored(named.join(ids, F.col("node") == F.col("__node")).select("node", "component", "copies", "__id"))
    first = named.groupBy("component").agg(F.min(F.struct("__id", "node")).alias("m"), F.count(F.lit(1)).alias("members")).where("members > 1").select(
        "component", F.col("m.node").alias("first"))
    gone = named.join(first, "component").where("node <> first").select(F.col("node").alias("__gone"), F.lit(False).alias("__once"))
    again = named.where("copies > 1").join(gone, F.col("node") == F.col("__gone"), "left_anti").select(F.col("node").alias("__gone"), F.lit(True).alias("__once"))
    touched = stored(gone.unionByName(again))                # rows of these nodes go, or stay once
    folded = F.broadcast(touched.select(F.pmod("__gone", F.lit(FOLD)).alias("__fold")).distinct())
    marked = docs.withColumn("__node", node)
    fold = F.pmod(F.coalesce("__node", F.lit(-1).cast("long")), F.lit(FOLD)) == F.col("__fold")
    none = F.col("__node").isNull()
    apart = marked.where(none).unionByName(marked.where(~none).join(folded, fold, "left_anti"))
    met = marked.where(~none).join(folded, fold, "left_semi").join(touched, F.col("__node") == F.col("__gone"), "left")
    once = met.where("__once").dropDuplicates(["__node"])
    return apart.select(*docs.columns).unionByName(met.where("__gone IS NULL").select(*docs.columns)).unionByName(once.select(*docs.columns))
