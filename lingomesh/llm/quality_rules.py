"""Quality rules: distribution divergence from language references (DataFrame functions only).

Base counts per text: words, code points in words, symbol characters, lines equal to an earlier
line, words inside repeated three-word windows.  Method: a text's histogram over character
classes and its histogram over the ``COMMON`` most frequent words of its language are compared
with the same histograms of all texts of that language by Jensen-Shannon distance (base 2, so
0 to 1).  A text is rejected when a distance passes its limit; guards keep short texts (fewer
than ``MIN_WORDS``) and languages with few documents out of the comparison.

The ``COMMON`` words hold too small a share of a language for a text without any of them to pass
``MAX_WORD_DISTANCE``.  Wrong languages and word salad are found by a third distance, of a text's
share of words among the ``WIDE`` most frequent ones to the median share in its language, so that
copies of one text move it little.  It is in parts of the distance of a text with none of them:
``common_distance`` is 0 from the median up and 1 for a text without a common word.  On the
labelled texts of sf0.1 clean ones have up to 0.28 (one of 3,243 has 0.8), 99 of 100 clean ones
of another language more than 0.39 (to the mean share); a text that mixes languages lies between.
Where fewer than ``LEAST_EXPECTED`` such words are to be expected none may be there by chance, so
no distance is given.

Scale: one pass over the texts counts words per language (map-side combine; the top list uses a
window group limit, so a language that holds most rows sends ``COMMON`` rows per task), one pass
makes the counts, small rows per document meet the references.  Every language of ``MIN_DOCS``
documents has a reference.  Those that hold a thousandth of all documents or more, at most 1000,
are broadcast; the rows of all others meet theirs in a shuffle by language, where none is hot, as
each holds less than a thousandth.

Edge cases: null or empty text has no words and fails the base rule; a null language
counts as the empty one; texts of a language with fewer than ``min_docs`` documents meet the base
rule only (``compared`` says of each row whether it met the references); equal lines and windows count each time; a doc_id may repeat or be null
(each row is judged alone).  Extra columns are ignored by ``metrics`` and kept by ``accepted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, checkpointed, let

COMMON = 16
MIN_WORDS = 50
MIN_DOCS = 50
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42
WIDE = 300
MAX_COMMON_DISTANCE = 0.35
LEAST_EXPECTED = 15
HOT_LANGS = 1000          # a language with one of so many documents is broadcast
BUCKETS = 512             # of the wide list by word hash, so that a look-up meets a word or two
SYMBOLS = r"[#*$%&|<>]"
#: rarer character classes, counted by pattern; white space and "other" (letters) follow from the rest
CLASSES = {"digit": "[0-9]", "upper": r"\p{Lu}", "punct": r"[.,;:!?'\"()\-]", "symbol": r"[#*$%&|<>@/\\^_~`+=\[\]{}]"}
_CODES = "abcdefghijklmnopqrstuvwxyz"[:COMMON]


def words_of(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` matches of the text, unchanged."""
    return F.array_remove(F.split(text, GAP), "")


def repeat_words(words: Column) -> Column:
    """How many words are covered by a three-word window that the text holds twice or more.
    Windows are sorted by hash, so the cost is n log n in the length of the text."""
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(at, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def repeated(w: Column) -> Column:
        return F.sort_array(F.transform(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1)["h"] == x["h"], F.lit(False))
                                                 | F.coalesce(F.get(w, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        new = F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(windows, repeated), covered)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``__words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = docs.withColumn("__words", words_of(text))
    return d.select(
        *docs.columns, "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("__words"), repeat_words).alias("n_repeat_words"),
        F.length(text).cast("long").alias("__chars"),
    )


def class_counts(text_col: str = "text") -> list[Column]:
    """Counts of the classes of ``CLASSES``; the two that follow are white space and other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"__c_{k}") for k, p in CLASSES.items()]


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of equal length that each sum to 1."""
    def half(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) / 2 + half(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1).cast("long")))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def relative_distance(share: Column, reference: Column) -> Column:
    """Distance of a share below the reference's, in parts of the distance of a share of 0."""
    def two(x):
        return F.array(x, 1 - x)
    least = distance(two(F.lit(0.0)), two(reference))
    return F.when(share >= reference, F.lit(0.0)).otherwise(distance(two(share), two(reference)) / least)


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, common, wide``: per language the ``COMMON`` most frequent words (ties by word) and
    the ``WIDE`` most frequent ones dealt over ``BUCKETS`` lists by hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    each = docs.select(lang.alias("lang"), F.explode(words_of(text)).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= WIDE)
    top = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("t"))
    top = top.select("lang", F.transform("t", lambda x: x["word"]).alias("words"))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.filter("words", lambda w: _bucket(w) == b))
    return top.select("lang", F.slice("words", 1, COMMON).alias("common"), dealt.alias("wide"))


def _row_key(text_col: str, lang_col: str) -> list[Column]:
    """128 bits of what a row is judged by."""
    both = [F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))]
    return [F.xxhash64(*both).alias("__h1"), F.xxhash64(*both[::-1]).alias("__h2")]


def within_limits(failed: Column) -> Column:
    """Neither the base rule nor a distance rejects the text; a distance that is not given rejects nothing."""
    limits = {"char_distance": MAX_CHAR_DISTANCE, "word_distance": MAX_WORD_DISTANCE, "common_distance": MAX_COMMON_DISTANCE}
    kept = ~failed
    for name, limit in limits.items():
        kept = kept & ~F.coalesce(F.col(name) > limit, F.lit(False))
    return kept


def _coded(hits: Column) -> Column:
    """Of the words on the wide list: their number, and a letter for each that is one of ``common``
    (which the wide list begins with), a point for each other."""
    letter = lambda w: F.substring(F.lit("." + _CODES), (F.array_position("common", w) + 1).cast("int"), F.lit(1))
    return F.struct(F.size(hits).cast("long").alias("n"), F.array_join(F.transform(hits, letter), "").alias("codes"))


def _median_share(rows: DataFrame) -> DataFrame:
    """``lang, ref_wide``: the median share, in thousandths, of ``WIDE`` words in the texts that
    are compared.  Counts per thousandth make it exact, whatever the order of the rows."""
    share = F.floor(1000 * F.col("n_wide") / F.col("n_words")).cast("int")
    counts = rows.where((F.col("n_words") >= MIN_WORDS) & F.col("n_wide").isNotNull()).groupBy("lang", share.alias("share")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select("lang", "share", F.sum("n").over(Window.partitionBy("lang").orderBy("share")).alias("upto"),
                         F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    return upto.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg((F.min("share") / 1000).alias("ref_wide"))


def _by_lang(rows: DataFrame, side: DataFrame, rare_langs: bool) -> DataFrame:
    """Left join on ``lang``: languages marked ``hot`` by broadcast, the others, if any, by shuffle."""
    hot = side.where("hot").drop("hot")                                                                              # <= HOT_LANGS rows
    if not rare_langs:
        return rows.join(F.broadcast(hot), "lang", "left")
    rest = rows.join(F.broadcast(hot.select("lang")), "lang", "left_anti")
    return rows.join(F.broadcast(hot), "lang").unionByName(rest.join(side.where(~F.col("hot")).drop("hot").hint("merge"), "lang", "left"))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, min_docs: int) -> DataFrame:
    """The columns of ``metrics`` and those of ``_row_key``."""
    d = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    sizes = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    total = d.count()
    enough = sizes.where(F.col("n_docs") >= min_docs).select("lang", (F.col("n_docs") * HOT_LANGS >= total).alias("hot"))
    lists = checkpointed(common_words(d, "text", "lang").join(enough, "lang").select("lang", "hot", "common", "wide"))
    rare_langs = lists.where(~F.col("hot")).limit(1).count() > 0
    counted = _by_lang(base_counts(d), lists, rare_langs).select(
        id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__chars", *class_counts("text"), "common",
        *_row_key("text", "lang"),
        F.when(F.col("common").isNotNull(), let(F.filter("__words", lambda w: F.array_contains(F.get("wide", _bucket(w)), w)), _coded)).alias("__coded"))
    classes = [F.col(f"__c_{k}") for k in CLASSES]
    space = F.col("__chars") - F.col("word_chars")
    other = F.greatest(F.col("word_chars") - sum(classes[1:], classes[0]), F.lit(0).cast("long"))
    codes = F.col("__coded")["codes"]
    common_n = [(F.length(codes) - F.length(F.replace(codes, F.lit(c)))).cast("long") for c in _CODES]
    code_n = [F.col("n_words") - sum(common_n[1:], common_n[0]), *common_n]
    rows = checkpointed(counted.select(
        id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__h1", "__h2",
        F.array(*classes, space, other).alias("chars"),
        F.when(F.col("common").isNotNull(), F.array(*code_n)).alias("commons"), F.col("__coded")["n"].alias("n_wide")))
    width, height = len(CLASSES) + 2, COMMON + 1
    refs = rows.where("commons IS NOT NULL").groupBy("lang").agg(
        F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(width)]).alias("ref_chars"),
        F.array(*[F.sum(F.get("commons", F.lit(i))) for i in range(height)]).alias("ref_commons"))
    refs = checkpointed(refs.join(_median_share(rows), "lang", "left").select("lang", _shares(F.col("ref_chars")).alias("ref_chars"), _shares(F.col("ref_commons")).alias("ref_commons"), "ref_wide")
                        .join(lists.select("lang", "hot"), "lang"))
    judged = _by_lang(rows, refs, rare_langs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    guard = (F.col("n_words") >= MIN_WORDS) & F.col("ref_chars").isNotNull()
    judged = judged.withColumn("char_distance", F.when(guard, distance(_shares(F.col("chars")), F.col("ref_chars")))) \
        .withColumn("word_distance", F.when(guard, distance(_shares(F.col("commons")), F.col("ref_commons")))) \
        .withColumn("common_distance", F.when(guard & (F.col("n_words") * F.col("ref_wide") >= LEAST_EXPECTED),
                                              relative_distance(F.col("n_wide") / F.col("n_words"), F.col("ref_wide"))))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), within_limits(failed).alias("kept"), guard.alias("compared"), "char_distance", "word_distance",
                         "common_distance", "__h1", "__h2")


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row: id, base counts, ``base_failed``, ``kept``, ``compared`` and the three distances."""
    return _judged(docs, id_col, text_col, lang_col, min_docs).drop("__h1", "__h2")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns kept, that pass.  A failed row is found again by its id and the
    hashes of its text and language, so rows that share an id or have none do not go with it."""
    gone = _judged(docs, id_col, text_col, lang_col, min_docs).where(~F.col("kept")).select(F.col(id_col).alias("__gone"), "__h1", "__h2").distinct()
    h1, h2 = _row_key(text_col, lang_col)
    rows = docs.withColumns({"__g1": h1, "__g2": h2})
    same = F.col(id_col).eqNullSafe(F.col("__gone")) & (F.col("__g1") == F.col("__h1")) & (F.col("__g2") == F.col("__h2"))
    return rows.join(gone, same, "left_anti").select(*docs.columns)
