"""Operators over documents against plain restatements, on texts made for the edges: null, empty and
blank texts, very long texts, copies, near copies, shared passages, repeated rows, null ids and
extra columns whose names the operators use themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lingomesh.llm import fingerprints, ngram_join, packing, quality_rules, sharding, substring_dedup

from . import brute

SCHEMA = "doc_id long, text string, lang string, id string, key string, n int, keys string, shard string"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two"), (5, "one\ttwo"), (6, "ONE two"), (7, "a b c d"), (8, "a b c d e")]
    base = words(rng, 400)
    rows += [(10, " ".join(base)), (11, " ".join(base)), (9, " ".join(base))]
    for i in range(12, 30):                      # near copies around the threshold
        w = list(base)
        for k in rng.sample(range(400), rng.choice([1, 2, 5, 9, 10, 11, 12, 20])):
            w[k] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    passage = words(rng, 60)
    for i in range(30, 60):                      # a passage that many share
        rows.append((i, " ".join(words(rng, rng.randrange(5, 200)) + passage + words(rng, rng.randrange(0, 90)))))
    for i in range(60, 70):                      # chains: each near the one before
        w = list(base[:200])
        for k in range((i - 60) * 3):
            w[k * 6] = f"chain{k}"
        rows.append((i, " ".join(w)))
    rows += [(70, "same " * 3000), (71, "same " * 3000), (72, "same " * 500), (73, " ".join(words(rng, 30000))), (74, "é ß 日本 🎉 " * 40)]
    rows += [(75, "dup line here\nother\ndup line here\n\n" * 20), (75, "dup line here\nother\ndup line here\n\n" * 20), (None, "one two"), (None, None)]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i is None else ("en", "de", None)[i % 3], "x", "y", 7, "z", "s") for i, t in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_substring_dedup(docs, none):
    assert plain(substring_dedup.removals(docs)) == order(brute.substring_dedup(ROWS))
    assert substring_dedup.removals(none).count() == 0


def test_substring_dedup_keeps_documents(docs):
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    removed = {(i, n): (r, sha) for i, n, r, sha in brute.substring_dedup(ROWS) if i is not None}
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in ROWS:
        if i is None:
            continue
        cut, sha = removed[i, len(brute.words(t))]
        if cut == 0:
            assert kept[i] == t
        elif cut == len(brute.words(t)):
            assert i not in kept
        else:
            assert hashlib.sha256(kept[i].encode()).hexdigest() == sha


def test_ngram_join(docs, none):
    got = plain(ngram_join.classes(docs))
    assert got == order(brute.jaccard_classes(ROWS))
    assert ngram_join.classes(none).count() == 0


def test_ngram_join_tiles(spark, monkeypatch):
    """Groups larger than a tile are cut into bands and blocks without losing a link."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 1)
    rng = random.Random(8)
    core = words(rng, 60)
    rows = []
    for i in range(60):
        w = core[: rng.randrange(30, 61)] + words(rng, rng.randrange(0, 14))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(ngram_join.classes(df)) == order(brute.jaccard_classes(rows))


def test_ngram_join_bins(spark, monkeypatch):
    """Small groups of one first component are not all looked at together, and no link is lost."""
    from pyspark.sql import functions as F

    groups = spark.range(5000).select(F.xxhash64("id").alias("key"), F.lit(7).cast("long").alias("first"), F.lit(100).alias("m"), F.lit(1).alias("k"))
    got = ngram_join._binned(groups.union(groups.limit(3).selectExpr("key + 1", "8L", "m", "k")))
    sizes = {(r["first"], r["bin"]): r["count"] * 100 for r in got.groupBy("first", "bin").count().collect()}
    assert sum(sizes.values()) == 500_300 and max(sizes.values()) <= 2 * ngram_join.BIN and sizes[8, 0] == 300
    monkeypatch.setattr(ngram_join, "BIN", 4)
    rng = random.Random(8)
    core = words(rng, 60)
    rows = [(i, " ".join(core[: rng.randrange(30, 61)] + words(rng, rng.randrange(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(ngram_join.classes(df)) == order(brute.jaccard_classes(rows))


def kept_by_hand(rows):
    """One (id, text) of each group of linked sets of the distinct (id, text): the smallest id; all without a set or an id."""
    nodes = sorted({(i, t) for i, t in rows if i is not None and brute.shingles(t)})
    classes = brute.jaccard_classes([(k, t) for k, (_, t) in enumerate(nodes)])
    rest = [(i, t) for i, t in rows if i is None or not brute.shingles(t)]
    return sorted([nodes[k][0] for k, _, c in classes if k == c] + [i for i, _ in rest if i is not None]), len([1 for i, _ in rest if i is None])


def test_keep_one(docs):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    want, nulls = kept_by_hand(ROWS)
    assert sorted(i for i in got if i is not None) == want and got.count(None) == nulls == 2


def test_keep_one_judges_rows_by_their_set(spark, none):
    """An id that repeats loses neither its unique text nor keeps its copies."""
    a, b, c, d = ("alpha beta gamma delta eps", "one two three four five six", "x y z", "only here under a repeated id")
    rows = [(3, a), (5, b), (5, a), (7, c), (7, c), (7, d), (7, d), (8, None), (8, None), (None, a), (None, a), (9, ""), (2, c.upper())]
    df = spark.createDataFrame([(i, t, "en", "x", "y", 7, "z", "s") for i, t in rows], SCHEMA).repartition(4)
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (2, c.upper()), (7, d), (8, None), (8, None), (None, a), (None, a), (9, "")], key=str)
    assert ngram_join.keep_one(none).count() == 0


def test_quality_base_counts(docs, none):
    got = order([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                 for r in quality_rules.metrics(docs).collect()])
    want = []
    for i, t in ROWS:
        b = brute.quality_base(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == order(want)
    assert quality_rules.metrics(none).count() == 0


def test_quality_divergence(spark):
    """Texts of odd characters or odd words go, ordinary ones stay, short ones are not compared."""
    rng = random.Random(2)
    common = "the of and to in is it that was for on are as with his they".split()

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."

    rows = [(i, text(rng.randrange(80, 200)), "en") for i in range(200)]
    rows += [(900, " ".join(f"{rng.randrange(10**6)}$$%%" for _ in range(90)), "en"), (901, " ".join(["the of"] + [f"the{rng.randrange(10**6)}" for _ in range(3)] * 30), "en")]
    rows += [(902, " ".join(common[:1] * 1 + [w for k in range(60) for w in (common[0], f"q{k}z")]), "en"), (903, text(20), "en"), (904, "жук " * 10, "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r for r in quality_rules.metrics(df).collect()}
    assert all(kept[i]["kept"] for i in range(200))
    assert not kept[900]["kept"] and kept[900]["char_distance"] > quality_rules.MAX_CHAR_DISTANCE
    assert kept[902]["word_distance"] > quality_rules.MAX_WORD_DISTANCE and not kept[902]["kept"]
    assert kept[903]["char_distance"] is None and kept[904]["char_distance"] is None
    ids = {r["doc_id"] for r in quality_rules.accepted(df).collect()}
    assert ids == {i for i, r in kept.items() if r["kept"]}


def test_quality_wrong_language(spark):
    """Against a reference of natural word shares (the 16 most frequent words make a fifth of all) a
    text of another language or of invented words goes, whatever its length."""
    rng = random.Random(4)
    lists = {g: [f"{g}{''.join(rng.choice('abcdefghij') for _ in range(1 + k % 7))}{'qrstuvw'[k % 7]}" for k in range(3000)] for g in "lmn"}
    shares = [1 / (k + 12) for k in range(3000)]

    def text(g, n):
        return " ".join(rng.choices(lists[g], shares, k=n))

    rows = [(i, text("l" if i % 2 else "m", rng.randrange(60, 400)), "l" if i % 2 else "m") for i in range(400)]
    odd = [(1000 + i, text("m", n), "l") for i, n in enumerate((60, 200, 1500))] + [(1010 + i, text("n", n), "m") for i, n in enumerate((60, 200, 1500))]
    kept = {r["doc_id"]: r for r in quality_rules.metrics(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert sum(kept[i]["kept"] for i in range(400)) >= 396
    assert not any(kept[i]["kept"] for i, *_ in odd) and min(kept[i]["common_distance"] for i, *_ in odd) > quality_rules.MAX_COMMON_DISTANCE
    assert max(kept[i]["word_distance"] for i, *_ in odd) < quality_rules.MAX_WORD_DISTANCE
    ids = {r["doc_id"] for r in quality_rules.accepted(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert ids == {i for i, r in kept.items() if r["kept"]}


def test_quality_query_gives_the_operators_verdict(spark, tmp_path):
    """The query and its SQL twin reject wrong-language texts too, and both say which rows met a reference."""
    import duckdb

    from lingomesh.llm import queries

    rng = random.Random(6)
    lists = {g: [f"{g}{''.join(rng.choice('abcdefghij') for _ in range(1 + k % 7))}{'qrstuvw'[k % 7]}" for k in range(3000)] for g in "lmn"}
    shares = [1 / (k + 12) for k in range(3000)]
    rows = [(i, " ".join(rng.choices(lists["lm"[i % 2]], shares, k=rng.randrange(40, 200))), "lm"[i % 2]) for i in range(200)]
    odd = [(1000 + i, " ".join(rng.choices(lists["m"], shares, k=200)), "l") for i in range(3)]
    edge = [(2000 + i, " ".join(rng.choices(lists["n"], shares, k=90)), "n") for i in range(quality_rules.MIN_DOCS)]
    few = [(3000 + i, f"{rng.randrange(9)} $ " * 90, "few") for i in range(quality_rules.MIN_DOCS - 1)]
    rows += odd + edge + few + [(4000, None, None), (4001, "", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_quality_rules(spark, str(tmp_path)).collect()}
    assert not any(got[i]["kept"] for i, *_ in odd) and all(got[i]["compared"] for i, *_ in odd + edge) and not any(got[i]["compared"] for i, *_ in few)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(queries.ORACLE["op7_quality_rules"])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(next(iter(got.values())).asDict())
    assert {r[names.index("doc_id")]: dict(zip(names, r)) for r in cursor.fetchall()} == {i: r.asDict() for i, r in got.items()}


def test_quality_rare_language(spark):
    """A language below a thousandth of a large table is compared as in a small one."""
    rng = random.Random(8)
    words_ = [f"r{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(words_, k=120)), "rare") for i in range(60)] + [(99, " ".join(f"{k}$$%%" for k in range(90)), "rare"), (98, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = spark.range(70_000).selectExpr("id + 1000 AS doc_id", "'a b' AS text", "'en' AS lang")
    pick = "doc_id < 1000"
    alone = {r["doc_id"]: (r["kept"], r["char_distance"], r["word_distance"], r["common_distance"]) for r in quality_rules.metrics(df).collect()}
    got = quality_rules.metrics(df.unionByName(many)).where(pick).collect()
    assert len(got) == len(rows) and not alone[99][0] and alone[0][1] is not None
    for r in got:
        assert r["kept"] == alone[r["doc_id"]][0]
        for x, y in zip((r["char_distance"], r["word_distance"], r["common_distance"]), alone[r["doc_id"]][1:]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def test_quality_accepted_judges_rows(spark):
    """A failing row takes neither the clean rows of its id nor, without an id, all rows without one."""
    clean = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    rows = [(1, clean[0], "en"), (1, "too short", "en"), (None, clean[1], "en"), (None, "", "en"), (None, None, None), (2, clean[2], "en"), (2, clean[2], "en"), (3, "x", "en")]
    rows += [(None, clean[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = [(i, t, g) for i, t, g in rows if t in clean]
    assert sorted(map(tuple, quality_rules.accepted(df).collect()), key=repr) == sorted(want, key=repr)


def xx64(words_):
    import xxhash

    h = 42
    for w in words_:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return h


def brute_fingerprint(text):
    import xxhash

    w = brute.words(text)
    if not w:
        return "-" * fingerprints.BINS
    shingles = {xx64(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    best = {}
    for h in shingles:
        signed = h - (1 << 64) if h >> 63 else h
        b = (signed >> 56) + 128
        best[b] = min(best.get(b, signed), signed)
    out = []
    for j in range(fingerprints.BINS):
        b, t = j, 0
        while b not in best:
            b = fingerprints.walk(j, t)
            t += 1
        first = xxhash.xxh64((best[b] % (1 << 64)).to_bytes(8, "little"), seed=42).intdigest()
        out.append("0123456789abcdef"[xxhash.xxh64(j.to_bytes(4, "little"), seed=first).intdigest() & 15])
    return "".join(out)


def test_fingerprints(spark, docs, none):
    got = {(r["doc_id"], r["text"]): r["fingerprint"] for r in fingerprints.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()}
    short = [(i, t) for i, t in ROWS if i is not None and len(t or "") < 20000]
    assert len(short) > 50
    for i, t in short:
        assert got[i, t] == brute_fingerprint(t), i
    assert fingerprints.edited_pairs(none).count() == 0


def test_edited_pairs(spark):
    rows = [(i, t) for i, t in dict(reversed(ROWS)).items() if i is not None and len(t or "") < 20000]
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    ring = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(ring):
        t, following = t or "", ring[(k + 1) % len(ring)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == brute_fingerprint(t) and got[i]["edited_fingerprint"] == brute_fingerprint(edited)
        a, b, c = (set(tuple(brute.words(x)[j:j + 5]) for j in range(max(1, len(brute.words(x)) - 4))) if brute.words(x) else set() for x in (t, edited, following))
        for name, other in (("near_edited", b), ("near_next", c)):
            true = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(got[i][name] - true) < 0.16
    one = fingerprints.edited_pairs(spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert len(one) == 2 and all(r["near_next"] == 1.0 for r in one)


def test_sharding(docs, none):
    rows = [r.asDict() for r in sharding.placement(docs, old_shards=5, new_shards=7).collect()]
    assert order([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]) == order(
        [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS])
    counts = [[r["slot"] for r in rows if r["shard"] == s] for s in range(7)]
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert all(sorted(c) == list(range(len(c))) for c in counts)
    assert sharding.placement(none).count() == 0


def test_sharding_groups_of_equal_texts(spark):
    """Equal texts are dealt like other rows: a group larger than a shard lies in several, counts stay equal."""
    df = spark.createDataFrame([(i, "the same text" if i < 300 else f"text {i}") for i in range(400)], "doc_id long, text string")
    rows = sharding.placement(df, old_shards=3, new_shards=4).collect()
    assert sorted(sum(r["shard"] == s for r in rows) for s in range(4)) == [100] * 4
    assert len({r["shard"] for r in rows if r["doc_id"] < 300}) > 1


def test_sharding_moves_the_fewest_bytes():
    """Against every choice of the shards that take an extra row."""
    import itertools

    rng = random.Random(3)
    for _ in range(500):
        old, new = rng.randrange(1, 5), rng.randrange(1, 6)
        blocks = [(o, c, rng.randrange(1, 6), 0) for o in range(old) for c in rng.sample(range(4), rng.randrange(0, 4))]
        size = {(o, c): rng.randrange(1, 30) for o, c, *_ in blocks}
        blocks = [(o, c, n, n * size[o, c]) for o, c, n, _ in blocks]
        plan = sharding.transfers(blocks, new)
        got = {}
        for o, c, first, n, s in plan:
            got.setdefault((o, c), []).append((first, n))
        for o, c, n, _ in blocks:
            ranges = sorted(got[o, c])
            assert [a for a, _ in ranges] == [sum(m for _, m in ranges[:k]) for k in range(len(ranges))] and sum(m for _, m in ranges) == n
        rows = [sum(n for *_, n, s in plan if s == j) for j in range(new)]
        assert max(rows) - min(rows) <= 1
        base, more = divmod(sum(b[2] for b in blocks), new)

        def least(larger):                               # what leaves an overfull shard is its smallest rows
            moved = 0
            for o in range(old):
                sizes = sorted(size[oo, c] for oo, c, n, _ in blocks if oo == o for _ in range(n))
                moved += sum(sizes[: max(0, len(sizes) - base - (o in larger))]) if o < new else sum(sizes)
            return moved

        assert sum(n * size[o, c] for o, c, _, n, s in plan if o != s) == min(least(k) for k in itertools.combinations(range(new), more))


def test_min_cost_flow_is_cheapest():
    import itertools

    rng = random.Random(1)
    for _ in range(40):
        supply = [rng.randrange(0, 3) for _ in range(3)]
        capacity = [0, 0, 0]
        for _ in range(sum(supply)):
            capacity[rng.randrange(3)] += 1
        cost = [[rng.randrange(0, 9) for _ in range(3)] for _ in range(3)]
        arcs = [(s, 3 + t, 99, cost[s][t]) for s in range(3) for t in range(3)] + [(3 + t, 6, capacity[t], 0) for t in range(3)]
        flow = sharding.min_cost_flow(7, arcs, list(enumerate(supply)), 6)
        units = [s for s, n in enumerate(supply) for _ in range(n)]
        seats = [t for t, n in enumerate(capacity) for _ in range(n)]
        best = min((sum(cost[s][t] for s, t in zip(units, p)) for p in set(itertools.permutations(seats))), default=0)
        assert sum(n * price for (*_, price), n in zip(arcs, flow)) == best
        assert [sum(flow[3 * s: 3 * s + 3]) for s in range(3)] == supply
        assert all(n <= arc[2] for arc, n in zip(arcs, flow))


def test_rewrite(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 50), "x") for i in range(300)], "doc_id long, text string, slot_note string")
    told = {r["shard"]: r["rows"] for r in sharding.rewrite(df, str(tmp_path / "out"), old_shards=3, new_shards=4).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == told and 3 in told
    assert set(df.columns) <= set(back.columns)


def first_fit(lengths, capacity=1024):
    """Sequences that first-fit decreasing needs, one piece at a time."""
    free = []
    for q in sorted(lengths, reverse=True):
        at = next((k for k, s in enumerate(free) if s >= q), None)
        if at is None:
            free.append(capacity - q)
        else:
            free[at] -= q
    return len(free)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = [r.asDict() for r in packing.packed(docs).collect()]
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for i, text in ROWS:
        if i in (None, 75):
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    assert len(by_doc[None]) == 2 and len(by_doc[75]) == 2 * len({r["piece"] for r in by_doc[75]})
    assert len(by_seq) <= 1.01 * first_fit([r["length"] for r in rows]) + 1
    assert packing.packed(none).count() == 0


def test_special_token_text_is_tokenized_alike():
    from tokenizers import Tokenizer

    encode, t = packing._encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for text in ("a <|endoftext|> b", "", "  x\n\n y ", "日本 é 🎉", "a" * 3000):
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_workers_of_the_pipeline_give_memory_back():
    """Every Arrow function ends with ``tidy``, and the large tokenizer is loaded only for texts that need it."""
    import subprocess
    import sys

    for run in (packing._pieces("", 8, 2), substring_dedup._anchor_rows(13), substring_dedup._window_rows(13), substring_dedup._kept(13, True),
                substring_dedup._cut_rows(13, ["text"], "text")):
        assert hasattr(run, "__wrapped__")
    code = "import sys; from lingomesh.llm import packing; packing._encoder(packing.tokenizer_path())('a b'); print('tokenizers' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"


@pytest.mark.parametrize("kind", ["uniform", "hot", "long", "short"])
def test_packing_plan(kind):
    rng = np.random.default_rng(0)
    lengths = {"uniform": rng.integers(1, 1024, 3000), "hot": np.where(rng.random(3000) < 0.4, 700, rng.integers(1, 400, 3000)),
               "long": rng.integers(513, 1024, 500), "short": rng.integers(1, 20, 3000)}[kind]
    h = np.bincount(lengths, minlength=1025)
    plan = packing.plan(h)
    used = np.zeros(1025, int)
    for p, r in plan:
        assert sum(p) <= 1024
        for q in p:
            used[q] += r
    assert (used == h).all()
    assert sum(r for _, r in plan) <= 1.01 * first_fit(lengths) + 1
