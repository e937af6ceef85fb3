"""Phrase collocation mining: multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words.
Every word position begins a suffix that is followed to ``max_words`` words or the end of its piece.

1. Words are counted per language.  At most ``HOT`` words (those with one in ``HOT`` of all occurrences
   or more) count as hot; their list is broadcast.  So is a bitmap of ``BITS`` bits with one bit set for every
   word that occurs ``min_count`` times: a word without its bit is in no phrase, so suffixes end before it.
2. A map chunk makes one row per distinct suffix with its number of occurrences (a phrase that stands
   everywhere sends one row per chunk).  Rows are routed by language and two leading words, so that a
   route holds all suffixes of its leading words; suffixes that begin with two hot words are routed
   by all their words, so that no route is hot.
3. Inside a route the suffix pointers are sorted by multikey three-way quicksort, word by word.  The
   occurrences in an equal partition are the count of the words that it shares; partitions with fewer than
   ``min_count`` are abandoned.  All open partitions of a route take a step together in numpy.
   Of suffixes that begin with two hot words, the pair is counted in parts, summed by Spark.
4. Counts are joined to the cuts of every candidate; scores are decimals of 38 digits (exact while
   a phrase occurs less than 10**15 times).

Result (``collocations``): per language the first ``top`` phrases with ``rank, phrase, a, l, r, n, score`` as
the module's contract says: ``a = f(phrase)``; of all cuts into two the one with the least
``floor(1000000 a a / (l r))``, ties to the shortest first part; phrases inside a longer candidate with at
least ``inside`` per cent of their count are left out; ranked by score, ``a`` (both descending) and phrase.

Edge cases: null and empty texts have no words; a null language is ``und``; a language without words has no
row.  Rows that repeat count each time.  Other columns, ids too, are not read.  Two words of a chunk
count as one with probability 2**-64 a pair (64-bit hashes); counting across chunks goes by the words.

Scale: two passes over the texts; what is shuffled is distinct suffixes per chunk.  Long texts are
worked through in parts that see ``max_words - 1`` words of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, first_of_group
from .words import BLOCK, LOWER, U, mix, span_hashes, text_buffers

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
INSIDE = 50               # per cent
HOT = 1 << 16
HOT_LEAST = 20_000        # occurrences that a hot word has at least
ROUTE_ROWS = 1 << 18      # occurrences that an average route stands for
CHUNK = 1 << 19           # words
BITS = 1 << 25            # of the bitmap of frequent words
BIT_ROWS = 1 << 12        # rows that the bitmap is gathered in
_GAP, _BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = _GAP
KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = _BREAK


def _spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece number of every word."""
    kind = np.full(len(raw) + 2, _BREAK, np.uint8)
    kind[1:-1] = KIND[raw]
    gap = kind != 0
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end, np.cumsum(kind == _BREAK)[start]


class Words:
    """Words of one part of a text block: dense numbers, piece and language of each, how many of them
    begin suffixes (the rest only follow), and hash and bytes of every number."""

    def __init__(self, raw: np.ndarray, lang_of, own: int):
        start, end, piece = _spans(raw)
        self.piece = piece.astype(np.int32)
        self.hash, first, number = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        self.number = number.astype(np.int32)
        self.bytes = [raw[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist())]
        self.lang = lang_of(start).astype(np.int32)
        self.own = int(np.searchsorted(start, own))


def _parts(raw: np.ndarray, off: np.ndarray, lang: np.ndarray, follow: int) -> Iterator[Words]:
    """Blocks of whole texts; a longer text in parts that begin with a word and see ``follow`` words more."""
    i = 0
    while i < len(off) - 1:
        j = max(int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1, i + 1)
        part = raw[off[i]: off[j]]
        if j > i + 1:
            at = off[i: j + 1] - off[i]
            ends = at[:-1] + np.arange(j - i)
            yield Words(np.insert(LOWER[part], at[1:-1], 10), lambda s, e=ends, i=i: lang[i + np.searchsorted(e, s, "right") - 1], len(part) + j - i)
        else:
            lo = 0
            while lo < len(part):
                hi = _word_start(part, lo + BLOCK)
                end = hi
                for _ in range(follow):
                    end = _word_start(part, _gap(part, end))
                yield Words(LOWER[part[lo:end]], lambda s, i=i: np.full(len(s), lang[i]), hi - lo)
                lo = hi
        i = j


def _gap(raw: np.ndarray, at: int) -> int:
    """The first byte from ``at`` on that belongs to no word (or the end)."""
    return _seek(raw, at, False)


def _word_start(raw: np.ndarray, at: int) -> int:
    """The first byte from ``at`` on that begins a word (or the end)."""
    if 0 < at < len(raw) and KIND[raw[at]] == 0 and KIND[raw[at - 1]] == 0:
        at = _gap(raw, at)
    return _seek(raw, at, True)


def _seek(raw: np.ndarray, at: int, word: bool) -> int:
    while at < len(raw):
        hit = np.flatnonzero((KIND[raw[at: at + 65536]] == 0) == word)
        if hit.size:
            return at + int(hit[0])
        at += 65536
    return len(raw)


def _chunks(batches: Iterator[pa.RecordBatch], follow: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, list[str]]]:
    """``(word numbers of the suffixes (n, follow + 1), -1 behind a piece's end; language numbers; words; word
    hashes; language hashes; languages)`` of about ``CHUNK`` suffixes."""
    names: dict[str, int] = {}
    waiting: list[Words] = []
    held = 0

    def flush(waiting: list[Words]):
        hashes, first = np.unique(np.concatenate([w.hash for w in waiting]), return_index=True)
        every = [b for w in waiting for b in w.bytes]
        words = pa.array([every[k] for k in first.tolist()], pa.binary())
        rows, langs = [], []
        for w in waiting:
            number = np.searchsorted(hashes, w.hash).astype(np.int32)[w.number]
            out = np.full((w.own, follow + 1), -1, np.int32)
            out[:, 0] = number[:w.own]
            for d in range(1, follow + 1):
                m = min(w.own, len(number) - d)
                if m > 0:
                    out[:m, d] = np.where(w.piece[d: d + m] == w.piece[:m], number[d: d + m], -1)
            rows.append(out)
            langs.append(w.lang[:w.own])
        listed = list(names)
        of_lang = span_hashes(*_laid_out(listed))
        return np.concatenate(rows), np.concatenate(langs), words, hashes, of_lang, listed

    for batch in batches:
        lang = np.array([names.setdefault("und" if x is None else x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
        for w in _parts(*text_buffers(batch.column("text")), lang, follow):
            if not w.own:
                continue
            waiting.append(w)
            held += w.own
            if held >= CHUNK:
                full, waiting, held = flush(waiting), [], 0
                yield full
                del full
    if waiting:
        full, waiting = flush(waiting), []
        yield full


def _laid_out(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of some names (each behind a mark, so that none is empty)."""
    raw = [b"\xff" + x.encode() for x in names]
    end = np.cumsum([len(x) for x in raw])
    return np.frombuffer(b"".join(raw), np.uint8), end - [len(x) for x in raw], end


def _word_mark(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word ^ (lang * U(3)))


def _slices(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), 1 << 15):
        yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 15) for c in columns], names=names)


def _langs(listed: list[str], number: np.ndarray) -> pa.Array:
    return pa.array(listed, pa.string()).take(pa.array(number))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, word, n`` of a chunk; the row without a word holds the language's number of occurrences."""
    for rows, lang, words, _, _, listed in _chunks(batches, 0):
        key, n = np.unique(lang.astype(np.int64) * len(words) + rows[:, 0], return_counts=True)
        at, word = np.divmod(key, len(words))
        yield from _slices([_langs(listed, at), words.take(pa.array(word)).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
        at, n = np.unique(lang, return_counts=True)
        yield from _slices([_langs(listed, at), pa.nulls(len(at), pa.string()), pa.array(n)], ["lang", "word", "n"])


def _frequent_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, bits`` of the bitmap: the bits of each batch's words by part of the bitmap."""
    each = BITS // BIT_ROWS
    for batch in batches:
        if batch.num_rows:
            marks = _marks(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            part, bit = np.divmod(np.unique((marks & U(BITS - 1)).astype(np.int64)), each)
            known, at = np.unique(part, return_inverse=True)
            bits = np.zeros((len(known), each), np.uint8)
            bits[at, bit] = 1
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], names=["part", "bits"])


def _joined_bits(table: pa.Table) -> pa.Table:
    all_bits = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]))
    return pa.table([table.column("part").slice(0, 1), pa.array([all_bits.tobytes()], pa.binary())], names=["part", "bits"])


def frequent_bitmap(words: DataFrame) -> np.ndarray:
    """The bitmap (bytes) over the rows ``lang, phrase``; it has ``BITS`` bits however many words there are."""
    rows = words.select("lang", "phrase").mapInArrow(_frequent_bits, "part long, bits binary").groupBy("part").applyInArrow(_joined_bits, "part long, bits binary")
    out = np.zeros((BIT_ROWS, BITS // BIT_ROWS // 8), np.uint8)
    for r in rows.collect():                                                                   # <= BIT_ROWS rows
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _marks(langs: list[str], words: list[str]) -> np.ndarray:
    """Mark of each word in its language, as the chunks have it."""
    raw = [w.encode() for w in words]
    end = np.cumsum([len(x) for x in raw])
    known, at = np.unique(np.array(langs, object), return_inverse=True)
    return _word_mark(span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(x) for x in raw], end), span_hashes(*_laid_out(known.tolist()))[at])


def _route(routes: int, hot, bitmap, max_words: int):
    """Rows ``route, lang, phrase, n`` of the distinct suffixes of a chunk that have two frequent words at least; suffixes that
    begin with two hot words have routes of their own, from ``routes`` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for rows, lang, words, hashes, of_lang, listed in _chunks(batches, max_words - 1):
            open_end = np.ones(len(rows), bool)
            for k in range(rows.shape[1]):
                at = (_word_mark(hashes[rows[:, k]], of_lang[lang]) & U(BITS - 1)).astype(np.int64)
                open_end &= (rows[:, k] >= 0) & ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)
                rows[~open_end, k] = -1
            more = rows[:, 1] >= 0
            del open_end, at
            rows, n = _distinct(np.column_stack([lang[more], rows[more]]))
            if not len(rows):
                continue
            lang, rows = rows[:, 0], rows[:, 1:]
            first, second = (_word_mark(hashes[rows[:, k]], of_lang[lang]) for k in (0, 1))
            both = np.isin(first, hot.value) & np.isin(second, hot.value)
            mark = mix(first + second * U(5))
            for k in range(2, rows.shape[1]):
                mark = np.where(both & (rows[:, k] >= 0), mix(mark + hashes[rows[:, k]] * U(2 * k + 3)), mark)
            route = (mark % U(routes)).astype(np.int64) + np.where(both, routes, 0)
            for k in range(0, len(rows), 1 << 15):
                part = rows[k: k + (1 << 15)]
                text = pc.binary_join_element_wise(*[words.take(pa.array(part[:, c], mask=part[:, c] < 0)) for c in range(part.shape[1])], b" ", null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array(route[k: k + (1 << 15)]), _langs(listed, lang[k: k + (1 << 15)]), text.cast(pa.string()), pa.array(n[k: k + (1 << 15)])],
                                                 names=["route", "lang", "phrase", "n"])
    return run


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers from -1 on, and how often each stands there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    key = rows[:, 0].astype(np.int64) + 1
    for k in range(1, rows.shape[1]):
        width = int(rows[:, k].max()) + 2
        if int(key.max()) >= (1 << 62) // width:            # number what there is so far anew
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + rows[:, k] + 1
    key, first, n = np.unique(key, return_index=True, return_counts=True)
    return rows[first], n


def multikey_quicksort(keys: np.ndarray, weight: np.ndarray, least: list[int], ends: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of shared beginnings of suffixes by three-way radix quicksort.

    ``keys``: one suffix per row, one number per column (``ends``: the suffix is over); ``weight``: occurrences of each suffix.
    Every open partition takes a pivot (median of three) at its depth and splits into smaller, equal and larger;
    the equal part goes on one column deeper, and its weight is the count of the beginning it shares.  A part that weighs less than
    ``least`` of its depth is abandoned (``least`` must not fall with the depth).

    Returns ``(pointer, depth, count)``: for each beginning of ``depth`` numbers with enough occurrences a suffix that has it.
    """
    n, deepest = keys.shape
    pointer = np.arange(n)
    start, end, depth = np.array([0]), np.array([n]), np.array([0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    least_of = np.array(least, np.int64)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    while len(start):
        size = end - start
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        part = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(part)) - first[part] + start[part]
        who = pointer[place]
        key = keys[who, depth[part]]
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)
        pivot = three[1][part]
        side = 1 + (key > pivot).astype(np.int64) - (key < pivot)
        counts = np.bincount(part * 3 + side, minlength=3 * len(start)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(counts, axis=1) - counts
        for s in range(3):                                   # stable: pointers keep their order inside each side
            at = np.flatnonzero(side == s)
            before = np.cumsum(counts[:, s]) - counts[:, s]
            pointer[begin[part[at], s] + np.arange(len(at)) - before[part[at]]] = who[at]
        start, size, side = begin.ravel(), counts.ravel(), np.tile([0, 1, 2], len(start))
        depth, pivot = np.repeat(depth, 3), np.repeat(three[1], 3)
        full = size > 0
        start, size, side, depth, pivot = start[full], size[full], side[full], depth[full], pivot[full]
        heavy = np.add.reduceat(weight[pointer[_ranges(start, size)]], np.cumsum(size) - size)
        equal = side == 1
        go = (heavy >= least_of[depth]) & ~(equal & (pivot == ends))
        hit = go & equal
        found.append((pointer[start[hit]], depth[hit] + 1, heavy[hit]))
        depth = depth + equal
        go &= depth < deepest
        start, end, depth = start[go], (start + size)[go], depth[go]
    return tuple(np.concatenate(x) for x in zip(*found))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - first, size)


def _count_route(routes: int, min_count: int, max_words: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lang = table.column("lang").combine_chunks().dictionary_encode()
        split = pc.split_pattern(table.column("phrase").combine_chunks(), " ")
        words = split.flatten().dictionary_encode()
        size = np.diff(split.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        keys = np.full((len(size), 1 + max_words), -1, np.int64)
        keys[:, 0] = lang.indices.to_numpy()
        keys[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = words.indices.to_numpy()
        # of two hot words this route has a part only: they are handed on whatever their number
        part = bool(table.num_rows) and table.column("route")[0].as_py() >= routes
        least = [1, 1, 1] + [min_count] * max_words if part else [min_count] * (max_words + 1)
        who, depth, count = multikey_quicksort(keys, table.column("n").to_numpy(), least[: max_words + 1])
        who, depth, count = (x[depth >= 3] for x in (who, depth, count))
        langs, names, out = lang.dictionary, words.dictionary, []
        text = pc.binary_join_element_wise(*[names.take(pa.array(keys[who, c], mask=(depth <= c) | (keys[who, c] < 0))) for c in range(1, 1 + max_words)], " ", null_handling="skip")
        out = [langs.take(pa.array(keys[who, 0])), text, pa.array((depth - 1).astype(np.int32)), pa.array(count)]
        return pa.table([out[0].cast(pa.string()), out[1].cast(pa.string()), out[2], out[3].cast(pa.int64())], names=["lang", "phrase", "words", "f"])
    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(counts, totals, hot)``: ``lang, phrase, words, f`` of all phrases of 1 to ``max_words`` words with at least ``min_count``
    occurrences; ``lang, n`` of all languages with words; and ``lang, phrase, f`` of at most ``HOT`` words."""
    if min_count < 1 or max_words < 2:
        raise ValueError("min_count must be 1 at least and max_words 2 at least")
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = checkpointed(words.where(F.col("word").isNull() | (F.col("f") >= min_count)))
    totals = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = words.where("word IS NOT NULL").where(F.col("f") >= max(total / HOT, HOT_LEAST)).select("lang", F.col("word").alias("phrase"), "f")
    listed = hot.select("lang", "phrase").collect()                                            # <= HOT rows
    marks = _marks(*zip(*listed)) if listed else np.zeros(0, U)
    single = words.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    bitmap = spark.sparkContext.broadcast(frequent_bitmap(single))
    routes = max(256, -(-total // ROUTE_ROWS))
    suffixes = texts.mapInArrow(_route(routes, spark.sparkContext.broadcast(np.sort(marks)), bitmap, max_words), "route long, lang string, phrase string, n long")
    long = suffixes.groupBy("route").applyInArrow(_count_route(routes, min_count, max_words), "lang string, phrase string, words int, f long")
    long = long.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return checkpointed(single.unionByName(long)), totals, hot


def _with_count(cuts: DataFrame, part: str, name: str, counts: DataFrame, hot: DataFrame) -> DataFrame:
    """``name``: the count of the phrase in ``part``.  Hot words take theirs from the broadcast list, so the candidates that share one
    do not meet in one task."""
    known = F.broadcast(hot.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), F.col("f").alias("__hot")))
    cuts = cuts.join(known, (F.col("lang") == F.col("__l")) & (F.col(part) == F.col("__p")), "left").drop("__l", "__p")
    # no phrase begins with a space: rows that have their count are spread and meet nothing
    cuts = cuts.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), "phrase")))
    rest = counts.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), F.col("f").alias("__f"))
    cuts = cuts.join(rest, (F.col("lang") == F.col("__l")) & (F.col("__key") == F.col("__p")), "left")
    return cuts.withColumn(name, F.coalesce("__hot", "__f")).drop("__l", "__p", "__f", "__hot", "__key")


def scored(counts: DataFrame, hot: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of every phrase of two words or more by its lowest-scoring cut."""
    word = F.split("phrase", " ")
    cuts = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cuts = _with_count(_with_count(cuts, "left", "l", counts, hot), "right", "r", counts, hot)
    whole = "cast({} as decimal(38,0))"
    score = F.expr(f"({whole.format(1000000)} * a * a) div ({whole.format('l')} * r)").cast("long")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def outermost(rows: DataFrame, max_words: int = MAX_WORDS, inside: int = INSIDE) -> DataFrame:
    """The rows without phrases that stand inside a longer one with ``inside`` per cent of their count or more."""
    if max_words < 3:
        return rows
    word = F.split("phrase", " ")
    long = rows.where("words >= 3").select("lang", "a", "words", word.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    long = long.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    held = long.select(F.col("lang").alias("__l"), F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("__p"), "a")
    held = held.groupBy("__l", "__p").agg(F.max("a").alias("__most"))
    rows = rows.join(held, (F.col("lang") == F.col("__l")) & (F.col("phrase") == F.col("__p")), "left")
    return rows.where(F.coalesce(F.lit(100) * F.col("__most") < F.lit(inside) * F.col("a"), F.lit(True))).drop("__l", "__p", "__most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 inside: int = INSIDE) -> DataFrame:
    """Per language the ``top`` best phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, totals, hot = phrase_counts(docs, text_col, lang_col, min_count, max_words)
    rows = outermost(scored(counts, hot), max_words, inside)
    rows = first_of_group(rows, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], top, "phrase")
    n = totals.select(F.col("lang").alias("__l"), "n")
    rows = rows.join(n, F.col("lang") == F.col("__l"))
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
