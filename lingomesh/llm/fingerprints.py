"""Document fingerprints: one-permutation MinHash, native DataFrame functions only.

A text's five-word shingles are hashed once (xxhash64).  The top bits of the hash pick one of
``BINS`` bins, where the smallest hash wins.  An empty bin takes the minimum of a
non-empty one by optimal densification: it walks the bins in a pseudo-random order of its own
(``offset + step * t``, step odd, so every bin is met) and copies the first that was filled by a
shingle.  Of each bin only the low ``BITS`` bits are stored (of the minimum hashed with the bin's
number), packed as one hexadecimal digit a bin.  Two fingerprints agree by chance in 2**-BITS of the bins; ``likeness`` corrects for that:
``(agreeing share - 2**-BITS) / (1 - 2**-BITS)``, not below 0.

Edge cases: one to four words count as one shingle of the whole sequence; null, empty and
white-space-only texts have the fingerprint of dashes, likeness 1 to each other and 0 to others.
Equal texts have equal fingerprints.  Rows with a null id come after all others, rows that share
an id in an order of their text.  Extra columns are ignored.

Scale: arrays inside a row, no explode and no shuffle for a fingerprint.  The next document is
found over ids alone: ids are range-partitioned, sorted inside the partitions, and one row per
partition bridges the borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, checkpointed, let

BINS = 256
BITS = 4
SHINGLE = 5
_BIN_BITS = BINS.bit_length() - 1
#: the walk of each bin: odd steps and offsets from congruential rules
_STEPS = [(1103515245 * (2 * j + 1) + 12345) * 2 + 1 & (BINS - 1) | 1 for j in range(BINS)]
_OFFSETS = [(1664525 * (j + 7) * (j + 3) + 1013904223 >> 5) & (BINS - 1) for j in range(BINS)]
_INVERSE = [pow(a, -1, BINS) for a in _STEPS]
PROBES = 8                # steps of a walk that are looked up one by one


def walk(j: int, t: int) -> int:
    """The bin that the walk of bin ``j`` meets at step ``t``."""
    return (_OFFSETS[j] + _STEPS[j] * t) % BINS


def shingle_hashes(text: Column) -> Column:
    """xxhash64 of every five-word sequence (the whole sequence if it is shorter)."""
    def hashes(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, F.array(F.xxhash64(words))).otherwise(many)

    return let(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), ""), hashes)


def _bin(h: Column) -> Column:
    """The bin of a hash; bins grow with the (signed) hash."""
    return F.shiftright(h, 64 - _BIN_BITS).cast("int") + BINS // 2


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each non-empty bin: the first of its bin after one sort."""
    return let(F.sort_array(hashes), lambda h: F.filter(
        h, lambda x, i: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(F.get(h, i - 1)), 64 - _BIN_BITS) != 0, F.lit(True))))


def pack(minima: Column) -> Column:
    """One hexadecimal digit per bin: the low bits of its minimum hashed with the bin's number, or
    of the minimum of the first filled bin of its walk.  The first steps of a walk are looked up;
    beyond them the walk is turned round: the filled bin with the smallest step number
    ``(bin - offset) / step mod BINS`` is the one it meets first."""
    inverse, offset = (F.array(*[F.lit(x) for x in xs]) for xs in (_INVERSE, _OFFSETS))
    steps = [F.array(*[F.lit(walk(j, t)) for j in range(BINS)]) for t in range(PROBES)]

    def body(m: Column, bins: Column) -> Column:
        def digit(h: Column, j: Column) -> Column:
            # hashed with the bin: a minimum that fills many bins must not agree by chance in all of them
            return F.substring(F.lit("0123456789abcdef"), F.xxhash64(h, j).bitwiseAND((1 << BITS) - 1).cast("int") + 1, F.lit(1))

        def place(j: Column) -> Column:
            looked = [F.nullif(F.array_position(bins, F.get(s, j)), F.lit(0).cast("long")).cast("int") - 1 for s in steps]
            nearest = F.array_min(F.transform(bins, lambda b, i: (
                (b - F.get(offset, j)) * F.get(inverse, j)).bitwiseAND(BINS - 1) * BINS + i)).bitwiseAND(BINS - 1)
            return F.coalesce(*looked, nearest)

        def fill(a: Column, b: Column) -> Column:
            empty = F.transform(F.sequence(a, b), lambda j: digit(F.get(m, place(j)), j))
            return F.when(a <= b, F.array_join(empty, "")).otherwise(F.lit(""))

        filled = F.transform(m, lambda h, i: F.concat(
            fill(F.coalesce(F.get(bins, i - 1), F.lit(-1)) + 1, F.get(bins, i) - 1), digit(h, F.get(bins, i))))
        return F.concat(F.array_join(filled, ""), fill(F.get(bins, F.size(bins) - 1) + 1, F.lit(BINS - 1)))

    def packed(m: Column) -> Column:
        return F.when(F.size(m) == 0, F.lit("-" * BINS)).otherwise(let(F.transform(m, _bin), lambda bins: body(m, bins)))

    return let(minima, packed)


def fingerprint(text: Column) -> Column:
    return pack(bin_minima(shingle_hashes(text)))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected estimate of the Jaccard similarity, 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda x: x))
    chance = 2.0 ** -BITS
    share = F.greatest((same / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("-") | b.startswith("-"), F.lit(0.0)).otherwise(share)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` per row."""
    return docs.select(id_col, fingerprint(F.col(text_col)).alias("fingerprint"))


def ring(docs: DataFrame) -> DataFrame:
    """``k, n, copies, prev`` for every distinct key of ``docs(k, n)``: ``prev`` is the next smaller
    key, for the smallest one the largest."""
    keys = docs.groupBy("k").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    placed = checkpointed(keys.repartitionByRange("k").withColumn("p", F.spark_partition_id()))
    borders = placed.groupBy("p").agg(F.max("k").alias("top")).withColumn("one", F.lit(1))      # one row per partition
    before = F.lag("top").over(Window.partitionBy("one").orderBy("p"))
    borders = borders.select("p", F.coalesce(before, F.max("top").over(Window.partitionBy("one"))).alias("border"))
    inside = F.lag("k").over(Window.partitionBy("p").orderBy("k"))
    return (placed.withColumn("inside", inside).join(F.broadcast(borders), "p")
            .select("k", "n", "copies", F.coalesce("inside", "border").alias("prev")))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The edited text ends with the start of the next document's text instead of its
    own second half; the next document is the next smaller id (after the smallest: the largest)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    d = docs.select(key.alias("k"), text.alias("text"))
    order = checkpointed(ring(d.select("k", F.length("text").alias("n"))))
    # each text goes to its own key once; from there its start goes on to the document it is next of
    after = order.select(F.col("prev").alias("pk"), F.col("k").alias("after"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    placed = d.withColumn("fingerprint", fingerprint(F.col("text"))).join(after, F.col("k") == F.col("pk")).drop("pk")
    starts = placed.select("after", F.substring("text", F.lit(1), F.col("half")).alias("start"), F.col("fingerprint").alias("next_fingerprint"))
    if not order.where("copies > 1").isEmpty():
        starts = starts.dropDuplicates(["after"])
    n = F.length("text")
    own = placed.select("k", n.cast("long").alias("n_chars"), F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")).alias("head"), "fingerprint")
    pairs = own.join(starts, F.col("k") == F.col("after")).withColumn("edited", F.concat("head", "start")).drop("head", "start", "after")
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return pairs.select(
        F.col("k.id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
