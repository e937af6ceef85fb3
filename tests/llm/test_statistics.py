"""Quality classifier, phrase mining and source audit against plain restatements, on texts made for the edges."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lingomesh.llm import collocations, random_indexing, source_divergence
from lingomesh.llm.words import text_buffers

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n int, phrase string, f string, rank int, term string, side int"


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "ü", "日本", "antidisestablishmentarian", "x" * 40, "x" * 33, "abcdefgh", "abcdefghi", "sixteenletterword", "a\x01b", "don't", "Az", "aZ", "4", "$"]
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n ", "en", "b"), (3, "...,,;\x0b\x0c", "en", "a"), (4, "one", "xx", "only"), (5, None, "", ""), (6, "one", "xx", None)]
    for i in range(7, 90):
        w = [rng.choice(vocabulary[: rng.choice([3, 10, 45])]) for _ in range(rng.choice([1, 2, 5, 40, 200]))]
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for x in w)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), rng.choice(["hot", "hot", "s1", "s2", None, ""])))
    rows += [(90, "same pair " * 3000, "en", "hot"), (90, "same pair " * 3000, "en", "hot"), (None, "of the " * 50, "de", "z"), (91, "long" * 5000 + " tail", "de", "z")]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 7, "x", "y", 1, "z", 2) for i, t, lang, s in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return {tuple(r) for r in df.collect()}


# --- phrase collocation mining

@pytest.mark.parametrize("hot", [1, 20_000])
def test_collocations_equal_brute_force(docs, monkeypatch, hot):
    """With the low bound nearly every word is hot: pairs are counted in parts."""
    monkeypatch.setattr(collocations, "HOT_LEAST", hot)
    monkeypatch.setattr(collocations, "HOT", 1 << 20 if hot == 1 else 1 << 16)
    got = plain(collocations.collocations(docs, min_count=5, top=30))
    want = brute.collocations([(t, lang) for _, t, lang, _ in ROWS], 5, 30)
    assert got == want and {r[0] for r in got} >= {"en", "de", "und"} and max(r[1] for r in got) == 30


def test_collocations_defaults_and_longer_phrases(docs):
    assert plain(collocations.collocations(docs)) == brute.collocations([(t, lang) for _, t, lang, _ in ROWS])
    four = collocations.phrase_counts(docs, min_count=5, max_words=4)[0].where("words = 4").collect()
    assert any(r["phrase"] == "same pair same pair" and r["f"] == 2 * 2999 for r in four)


def test_collocations_of_nothing(none):
    out = collocations.collocations(none)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_quicksort_counts_shared_beginnings():
    rng = np.random.default_rng(1)
    keys = rng.integers(-1, 6, (2000, 4))
    for c in range(1, 4):
        keys[:, c] = np.where(keys[:, c - 1] < 0, -1, keys[:, c])
    weight = rng.integers(1, 9, len(keys))
    who, depth, count = collocations.multikey_quicksort(keys, weight, [10, 10, 10, 10])
    got = {tuple(keys[p, :d].tolist()): int(n) for p, d, n in zip(who, depth, count)}
    want = {}
    for row, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 5):
            if row[d - 1] < 0:
                break
            want[tuple(row[:d])] = want.get(tuple(row[:d]), 0) + w
    assert got == {k: v for k, v in want.items() if v >= 10} and len(got) == len(who)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 19])
def test_long_texts_in_parts_lose_no_phrase(monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    text = "a b c. d e f g, aa  bb\tcc\n" * 30 + "x" * 200 + " y z"
    batch = pa.RecordBatch.from_pydict({"lang": ["en", None, "de"], "text": [text, "a b", "  q r s t  "]}, pa.schema([("lang", pa.string()), ("text", pa.string())]))
    got = {}
    for rows, lang, words, _, _, listed in collocations._chunks(iter([batch]), 2):
        for row, number in zip(rows.tolist(), lang.tolist()):
            for k in range(1, 4):
                if row[k - 1] >= 0:
                    key = (listed[number], " ".join(words[x].as_py().decode() for x in row[:k]))
                    got[key] = got.get(key, 0) + 1
    want = {}
    import re
    for t, lang in ((text, "en"), ("a b", "und"), ("  q r s t  ", "de")):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = piece.split()
            for k, i in itertools.product((1, 2, 3), range(len(w))):
                if i + k <= len(w):
                    key = (lang, " ".join(w[i:i + k]))
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 123_456_789_012_345
    counts = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    hot = counts.where("phrase = 'a'").select("lang", "phrase", "f")
    row = collocations.scored(counts, hot).first()
    assert row["score"] == 1000000 * big * big // ((big + 7) * (big + 9)) and (row["l"], row["r"]) == (big + 7, big + 9)


# --- source divergence audit

@pytest.mark.parametrize("least,top,tile,block", [(3, 200, 256, 4096), (2, 3, 2, 5), (1, 5, 1, 1000), (90, 5, 256, 10)])
def test_divergence_equals_brute_force(docs, least, top, tile, block, monkeypatch):
    whole = source_divergence.pair_values
    monkeypatch.setattr(source_divergence, "pair_values", lambda shares: whole(shares, tile, block))
    got = plain(source_divergence.audit(docs, least=least, top=top))
    assert got == brute.source_divergence([(t, lang, s) for _, t, lang, s in ROWS], least, top)
    assert ("xx", "only", "pair", "", 0, 1) in got or least == 1      # a language without kept terms


def test_divergence_of_nothing(none):
    out = source_divergence.audit(none)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_radix_order_and_packing():
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> rng.integers(0, 60, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)
    assert source_divergence.radix_order([low, high]).tolist() == sorted(range(500), key=lambda k: (high[k], low[k]))
    terms = ["a", "abcdefgh", "é", "日本語", "abcdefghijklmnop", "ab" * 20]
    chunk = source_divergence.Chunk()
    for doc, term in [(0, t) for t in terms] + [(0, "a"), (1, "a"), (1, "ab" * 20)]:
        raw = np.frombuffer(term.encode(), np.uint8)
        chunk.add(raw, np.array([0]), np.array([len(raw)]), np.array([doc]), np.array([0]))
    for compact in (False, True):
        if compact:
            chunk.compact()
        got = {t: (int(n), int(d)) for _, count, docs, term in chunk.runs() for t, n, d in zip(term.to_pylist(), count, docs)}
        assert got == {**{t: (1, 1) for t in terms}, "a": (3, 2), "ab" * 20: (2, 2)}


def test_a_long_text_counts_as_one_document(monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK", 50)
    monkeypatch.setattr(source_divergence, "CHUNK", 20)
    texts = ["alpha beta " * 40 + "g" * 99, None, "alpha", "beta gamma " * 9]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 4, "source": ["s"] * 4}, pa.schema([(c, pa.string()) for c in ("text", "lang", "source")]))
    got = {}
    for b in source_divergence._counted(iter([batch])):
        for r in b.to_pylist():
            old = got.get(r["term"], (0, 0))
            got[r["term"]] = (old[0] + r["n"], old[1] + r["docs"])
    assert got == {"alpha": (41, 2), "beta": (49, 2), "gamma": (9, 1), "g" * 99: (1, 1), None: (0, 0)}


# --- quality classifier

def test_context_sums_equal_plain_loops():
    index = random_indexing.index_vectors()
    assert (np.abs(index).sum(axis=1) == random_indexing.NONZERO).all()
    texts = ["The cat&&& sat", None, "", "the cat the cat cat", "x"]
    raw, off = text_buffers(pa.array(texts, pa.string()))
    (_, _, words, row), = random_indexing._parts(raw, off)
    assert np.bincount(row, minlength=5).tolist() == [4, 0, 0, 5, 1] and words[2] != words[1]
    rows, n, sums = random_indexing.context_sums(words, row, index)
    want = {}
    for i in range(len(words)):
        total = want.setdefault(int(words[i]), [0, np.zeros(random_indexing.DIM, int)])
        total[0] += 1
        for j in range(max(0, i - 2), min(len(words), i + 3)):
            if j != i and row[j] == row[i]:
                total[1] += index[words[j]]
    assert {int(r): (int(c), s.tolist()) for r, c, s in zip(rows, n, sums)} == {r: (c, s.tolist()) for r, (c, s) in want.items()}


def test_context_table_covers_every_text(docs):
    n, sums = random_indexing.context_table(docs)
    index, count, want = random_indexing.index_vectors(), np.zeros_like(n), np.zeros_like(sums)
    for _, t, _, _ in ROWS:
        for _, _, words, row in random_indexing._parts(*text_buffers(pa.array([t], pa.string()))):
            if len(words):
                r, c, s = random_indexing.context_sums(words, row, index)
                count[r] += c
                want[r] += s
    assert (n == count).all() and (sums == want).all()


def test_gradient_and_temperature():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 6)), (rng.random(50) < 0.4).astype(float)
    m = random_indexing.Model(np.zeros(6), np.ones(6), rng.normal(size=(6, 3)), rng.normal(size=3), rng.normal(size=3), 0.3, 1.0)
    loss = lambda m: random_indexing.log_loss(m.logit(x), y) + 0.05 * (np.sum(m.w1 ** 2) + np.sum(m.w2 ** 2))      # noqa: E731
    grad = random_indexing.gradient(m, x, y, 0.1)
    for name, g in zip(("w1", "b1", "w2", "b2"), grad):
        old = np.array(getattr(m, name), float)
        for at in np.ndindex(old.shape):
            step = np.zeros(old.shape)
            step[at] = 1e-6
            slope = (loss(m._replace(**{name: old + step})) - loss(m._replace(**{name: old - step}))) / 2e-6
            assert abs(slope - np.array(g)[at]) < 1e-6
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(random_indexing.calibrated(z * 5, y) - 5) < 0.6
    grid = np.exp(np.linspace(np.log(0.06), np.log(19), 400))
    assert random_indexing.log_loss(z * 5 / random_indexing.calibrated(z * 5, y), y) <= min(random_indexing.log_loss(z * 5 / t, y) for t in grid) + 1e-9


def test_quality_on_held_out_rows(spark):
    import zlib
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = random_indexing.scores(d, labels)
    rows = out.join(labels, "doc_id", "left").collect()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == d.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95 and np.mean([r["quality"] for r in held]) < 0.95


def test_quality_edges(spark, docs, none):
    some = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(i, int(i % 2), "x") for i in range(7, 80)] + [(7, None, ""), (None, 1, ""), (9, 0, "")], some)
    rows = random_indexing.scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    blank = {r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 5)}
    assert len(blank) == 1                                                       # null, empty and blank texts score alike
    same = [r["score"] for r in rows if r["doc_id"] == 90]
    assert len(same) == 2 and same[0] == same[1]
    again = {(r["doc_id"], r["score"]) for r in random_indexing.scores(docs.repartition(2), labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in rows}
    assert {r["score"] for r in random_indexing.scores(docs, labels.where("quality = 1")).collect()} == {1 - 1e-9}
    assert {r["score"] for r in random_indexing.scores(docs, labels.limit(0)).collect()} == {1e-9}
    assert random_indexing.scores(none, labels).count() == 0
