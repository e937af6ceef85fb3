"""Language sets, similarity top-k, greedy assignment, grading of matches."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingomesh import labels as L
from lingomesh.operators import assign, similarity
from lingomesh.operators.match import run_matching
from lingomesh.operators.quality import CrawlColumns, build_sets, check_sets, invalid_codes

COLS = CrawlColumns(url="url", embedding="emb", status="status", indexability="idx")


def test_build_sets_drop_precedence(spark):
    rows = [
        (0, "de", "https://a.de/x", "200", "Indexable", "[1,0,0,0,0,0,0,0]"),
        (1, "de", "https://www.a.de/x/", "200", "Indexable", "[0,1,0,0,0,0,0,0]"),   # duplicate of 0
        (2, "de", "https://a.de/y", "200", "Indexable", "[1,2,3,4,5]"),               # wrong dimension
        (3, "de", "https://a.de/z", "404", "Indexable", "[1,0,0,0,0,0,0,0]"),
        (4, "de", "", "200", "Indexable", "[1,0,0,0,0,0,0,0]"),
        (5, "de", "https://a.de/w", "200", "Non-Indexable", "[1,0,0,0,0,0,0,0]"),
        (6, "de", "https://a.de/v", "200", "Indexable", ""),
        (7, "de", "https://a.de/u", "200", "Indexable", "kaputt"),
        (8, "de", "https://a.de/q", "200", "Indexable", "[0,0,0,0,0,0,0,0]"),         # zero, owns nothing
        (9, "de", "https://a.de/q", "200", "Indexable", "[0,0,1,0,0,0,0,0]"),         # first valid owner
        (10, "de", "https://a.de/q", "200", "Indexable", "[0,0,0,0,0,0,0,0]"),        # zero after owner: duplicate
        (11, "de", "https://a.de/s", "x", "Indexable", "[0,0,0,1,0,0,0,0]"),
    ]
    df = spark.createDataFrame(rows, "pos long, code string, url string, status string, idx string, emb string")
    valid, dropped = build_sets(df, COLS, True)
    reasons = {r["pos"]: (r["stage"], r["reason"]) for r in dropped.collect()}
    assert sorted(r["pos"] for r in valid.collect()) == [0, 9]
    assert reasons[1] == (3, "Duplikat nach Normalisierung von https://a.de/x")
    assert reasons[2] == (3, "Dimension 5 statt 8 (vermutlich abgeschnitten)")
    assert reasons[3] == (1, "Status Code 404")
    assert reasons[4] == (1, "leere URL")
    assert reasons[5] == (1, "nicht indexierbar (Non-Indexable)")
    assert reasons[6] == (2, "Embedding fehlt")
    assert reasons[7] == (2, "Embedding nicht lesbar")
    assert reasons[8] == (3, L.DROP_ZERO)
    assert reasons[10] == (3, "Duplikat nach Normalisierung von https://a.de/q")
    assert reasons[11] == (1, "Status Code")
    norms = [float(np.linalg.norm(r["vec"])) for r in valid.collect()]
    assert norms == pytest.approx([1.0, 1.0], abs=1e-6)


def test_check_sets(spark):
    df = spark.createDataFrame([("de", [1.0, 0.0]), ("fr", [1.0, 0.0, 0.0])], "code string, vec array<float>")
    problems = check_sets(df, "de")
    assert any("Dimensionen" in p for p in problems)
    assert check_sets(df.where("code = 'de'"), "en")[:1] == ["Mindestens zwei Sprachsets mit gültigem Code nötig."]


def _unit(rng, n, d):
    m = rng.standard_normal((n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_topk_kernel_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MAX_PIVOT_BLOCK_ROWS", 7)
    monkeypatch.setattr(similarity, "MAX_OTHER_BLOCK_ROWS", 11)
    rng = np.random.default_rng(0)
    P, O = _unit(rng, 50, 16).astype(np.float32), _unit(rng, 70, 16).astype(np.float32)
    piv = spark.createDataFrame([("fr", i, P[i].tolist()) for i in range(50)], "code string, a long, vec array<float>")
    oth = spark.createDataFrame([("fr", j, O[j].tolist()) for j in range(70)], "code string, b long, vec array<float>")
    topk, best = similarity.topk_similarity(piv, oth, 5)
    S = P.astype(np.float64) @ O.astype(np.float64).T
    got = {}
    for r in topk.collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"]))
    for a in range(50):
        want = sorted(range(70), key=lambda b: (-S[a, b], b))[:5]
        assert [b for _, b in sorted(got[a])] == want
    for r in best.collect():
        assert r["a"] == int(np.argmax(S[:, r["b"]]))
    assert best.count() == 70


@pytest.mark.parametrize("cell, pivot_tile, other_tile", [(1 << 20, 7, 11), (2000, 1024, 4096), (4000, 5, 3)])
def test_copies_rank_by_position_in_any_grid(spark, monkeypatch, cell, pivot_tile, other_tile):
    """Exact copies of a vector score the same whichever block they fall into."""
    monkeypatch.setattr(similarity, "CELL_BYTES", cell)
    monkeypatch.setattr(similarity, "MAX_PIVOT_BLOCK_ROWS", pivot_tile)
    monkeypatch.setattr(similarity, "MAX_OTHER_BLOCK_ROWS", other_tile)
    rng = np.random.default_rng(4)
    base = _unit(rng, 6, 300).astype(np.float32)
    piv = spark.createDataFrame([(i, base[i % 6].tolist()) for i in range(60)], "a long, vec array<float>")
    oth = spark.createDataFrame([("fr", j, base[j % 6].tolist()) for j in range(90)], "code string, b long, vec array<float>")
    topk, best = similarity.topk_similarity(piv, oth, 4)
    got = {}
    for r in topk.collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"]))
    for a in range(60):
        assert [b for _, b in sorted(got[a])] == [a % 6, a % 6 + 6, a % 6 + 12, a % 6 + 18]
    assert {r["b"]: r["a"] for r in best.collect()} == {j: j % 6 for j in range(90)}
    gone = spark.createDataFrame([("fr", a) for a in range(6)], "code string, a long")
    best = similarity.best_pivot_from_scores(similarity.block_scores(piv, oth, 4, gone))
    assert {r["b"]: r["a"] for r in best.collect()} == {j: j % 6 + 6 for j in range(90)}
    plan = similarity.block_scores(piv, oth, 4)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Join" not in plan


@pytest.mark.parametrize("copies", [False, True])
def test_cell_memory_is_that_of_a_slab(copies):
    """A worker's arrays follow neither the tiles of a cell nor the ties among its scores."""
    rng = np.random.default_rng(5)
    n, m, k = 2048, 8192, 5
    P, O = (np.repeat(v[:1], len(v), axis=0) if copies else v for v in (_unit(rng, n, 16).astype(np.float32), _unit(rng, m, 16).astype(np.float32)))

    def tiles(v, rows, first):
        at = range(0, len(v), rows)
        return [np.arange(first + i, first + i + len(v[i:i + rows])).tobytes() for i in at], [v[i:i + rows].tobytes() for i in at]

    pos, mat = tiles(P, 1024, 0)
    left = pa.table({"pos": pa.array(pos, pa.binary()), "mat": pa.array(mat, pa.binary()), "gone": pa.nulls(len(pos), pa.list_(pa.int64()))})
    pos, mat = tiles(O, 4096, 10_000)
    right = pa.table({"pos": pa.array(pos, pa.binary()), "mat": pa.array(mat, pa.binary())})
    tracemalloc.start()
    out = similarity._cell(k)((pa.scalar("fr"),), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20, peak
    got = out.to_pandas()
    S = np.rint(P.astype(np.float64) @ O.astype(np.float64).T * 10.0 ** similarity.SCORE_DIGITS)
    top = got[got.kind == 0].sort_values(["a", "score", "b"], ascending=[True, False, True])
    assert top.a.tolist() == np.repeat(np.arange(n), k).tolist()
    assert (top.b.to_numpy().reshape(-1, k) - 10_000 == np.argsort(-S, axis=1, kind="stable")[:, :k]).all()
    best = got[got.kind == 1].sort_values("b")
    assert (best.a.to_numpy() == S.argmax(axis=0)).all() and len(best) == m


def test_excluded_pivots_need_no_python(spark):
    rng = np.random.default_rng(6)
    piv = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_unit(rng, 6, 4))], "a long, vec array<float>")
    oth = spark.createDataFrame([("fr", i, v.tolist()) for i, v in enumerate(_unit(rng, 6, 4))], "code string, b long, vec array<float>")
    plan = similarity.block_scores(piv, oth, 2, spark.createDataFrame([("fr", 1)], "code string, a long"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan


def _sequential(edges):
    used_a, used_b, out = set(), set(), set()
    for code, a, b, s in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if (code, a) in used_a or (code, b) in used_b:
            continue
        used_a.add((code, a))
        used_b.add((code, b))
        out.add((code, a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_rounds_equal_sequential(spark, seed):
    rnd = random.Random(seed)
    edges = []
    for code in ("de", "fr"):
        for _ in range(300):
            edges.append((code, rnd.randrange(40), rnd.randrange(40), round(rnd.random(), 1)))
    edges = list({(c, a, b): (c, a, b, s) for c, a, b, s in edges}.values())
    df = spark.createDataFrame(edges, assign.EDGE_SCHEMA)
    got = {(r["code"], r["a"], r["b"]) for r in assign.greedy_assign(df, rounds=1).collect()}
    assert got == _sequential(edges)
    stay = {(r["code"], r["a"], r["b"]) for r in assign.greedy_assign(df, rounds=2, max_component=3).collect()}
    assert stay == got


def test_greedy_descending_chain(spark):
    # a chain a0-b0 (0.9) , a1-b0 (0.95), a1-b1 (0.8) ...: greedy must resolve it in order
    edges = [("de", i // 2, (i + 1) // 2, 1.0 - i * 0.0004) for i in range(2000)]
    df = spark.createDataFrame(edges, assign.EDGE_SCHEMA)
    got = {(r["code"], r["a"], r["b"]) for r in assign.greedy_assign(df).collect()}
    assert got == _sequential(edges)


def _sets(spark, rows):
    return spark.createDataFrame(
        [(c, p, u, u.replace("https://", ""), v) for c, p, u, v in rows],
        "code string, pos long, url string, norm_url string, vec array<float>",
    )


def test_conflict_reciprocity_margin(spark):
    s = 0.6 ** 0.5
    rows = [
        ("de", 0, "https://x.com/de/a", [1.0, 0.0, 0.0]),
        ("de", 1, "https://x.com/de/b", [0.8, s, 0.0]),
        ("fr", 0, "https://x.com/fr/a", [1.0, 0.0, 0.0]),
        ("fr", 1, "https://x.com/fr/c", [0.0, 0.0, 1.0]),
    ]
    valid = _sets(spark, rows)
    res = run_matching(valid, "de", threshold=0.5, band=0.05, min_margin=0.02)
    m = {(r["pivot_pos"], r["other_pos"]): r for r in res.matches.collect()}
    assert set(m) == {(0, 0), (1, 0)} - {(1, 0)} | {(0, 0)}
    r = m[(0, 0)]
    assert r["method"] == "embedding" and r["reciprocal"] and r["score"] == 1.0
    assert r["second_url"] == "https://x.com/fr/c" and r["margin"] == 1.0
    stats = {x["code"]: x for x in res.stats.collect()}
    assert stats["fr"]["embedding"] == 1 and stats["fr"]["unmatched"] == 1
    assert stats["de"]["total"] == 2 and stats["de"]["unmatched"] == 1 and stats["de"]["slug"] is None


def test_preferred_pivot_and_review(spark):
    rows = [
        ("de", 0, "https://x.com/de/a", [1.0, 0.0]),
        ("de", 1, "https://x.com/de/b", [0.6, 0.8]),
        ("fr", 0, "https://x.com/fr/a", [0.8, 0.6]),
        ("fr", 1, "https://x.com/fr/b", [0.6, 0.8]),
    ]
    valid = _sets(spark, rows)
    res = run_matching(valid, "de", threshold=0.5, band=0.05, min_margin=0.02)
    m = {(r["pivot_pos"], r["other_pos"]): r for r in res.matches.collect()}
    # de/b takes fr/b (1.0); de/a gets fr/a (0.8), whose own best pivot is de/b (0.96)
    assert set(m) == {(1, 1), (0, 0)}
    r = m[(0, 0)]
    assert not r["reciprocal"] and r["confidence"] == "prüfen" and r["reason"] == "nicht reziprok"
    assert r["preferred_pivot_url"] == "https://x.com/de/b" and r["preferred_pivot_score"] == 0.96
    assert r["second_url"] == "https://x.com/fr/b" and r["margin"] == 0.2
    near = run_matching(valid, "de", threshold=0.78, band=0.05, min_margin=0.02).matches
    reason = {(x["pivot_pos"], x["other_pos"]): x["reason"] for x in near.collect()}[(0, 0)]
    assert reason == "knapp über Threshold (0.800); nicht reziprok"


def test_slug_match_first_rows(spark):
    rows = [
        ("de", 0, "https://x.com/de/p1", [1.0, 0.0]),
        ("de", 1, "https://x.com/de/p1", [0.0, 1.0]),
        ("fr", 5, "https://x.com/fr/p1", [1.0, 0.0]),
        ("fr", 6, "https://x.com/fr/p1", [0.0, 1.0]),
    ]
    valid = _sets(spark, rows)
    res = run_matching(valid, "de", threshold=0.9, use_slug=True)
    m = {(r["pivot_pos"], r["other_pos"]): (r["method"], r["score"]) for r in res.matches.collect()}
    assert m[(0, 5)] == ("slug", 1.0)
    assert m[(1, 6)][0] == "embedding"


def test_unknown_pivot(spark):
    valid = _sets(spark, [("de", 0, "https://x.com/de/a", [1.0, 0.0]), ("fr", 0, "https://x.com/fr/a", [1.0, 0.0])])
    with pytest.raises(ValueError):
        run_matching(valid, "en", codes=["de", "fr"])


def test_set_validation_sees_empty_sets_and_codes(spark):
    rows = [(0, "de", "https://a.de/0", "[1,0]"), (1, "fr", "https://a.fr/0", "[0,1]"), (2, "it", "https://a.it/0", "[0,0]"),
            (3, "not a code!!", "https://a.xx/0", "[1,1]"), (4, None, "https://a.yy/0", "[1,1]"), (5, "de", "https://a.de/5", "[1,2]")]
    df = spark.createDataFrame(rows, "pos long, code string, url string, emb string")
    valid, dropped = build_sets(df, CrawlColumns(url="url", embedding="emb"))
    assert {r["pos"]: r["reason"] for r in dropped.collect()} == {2: L.DROP_ZERO, 4: L.DROP_NO_CODE}      # no row is lost
    assert valid.count() == 4
    problems = check_sets(valid, "en", dropped)
    assert problems == [L.SETS_INVALID_CODE.format("not a code!!"), L.SETS_EMPTY, L.SETS_NO_PIVOT.format("en")]
    assert {(r["code"], r["n"]) for r in invalid_codes(df).collect()} == {("not a code!!", 1), (None, 1)}


def test_x_default_off_and_first_code(spark):
    from lingomesh.plans.pipeline import MatchParams, match_crawl

    rows = [(i, c, f"https://a.com/{c}/{i}", v) for i, (c, v) in enumerate([("de", "[1,0]"), ("de", "[0,1]"), ("en", "[1,0.1]"), ("en", "[0.1,1]")])]
    df = spark.createDataFrame(rows, "pos long, code string, url string, emb string")
    cols = CrawlColumns(url="url", embedding="emb")

    def tags(x_default):
        out = match_crawl(df, cols, MatchParams(pivot="en", threshold=0.5, include_review=True, x_default=x_default))
        return "".join(r["block"] for r in out.html.collect())

    assert "x-default" not in tags(None)
    default = match_crawl(df, cols, MatchParams(pivot="en", threshold=0.5, include_review=True))
    assert 'hreflang="x-default" href="https://a.com/de/' in "".join(r["block"] for r in default.html.collect())
