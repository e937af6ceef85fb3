"""Clusters, mapping tables and hreflang blocks."""

import pytest
from pyspark.sql import functions as F

from lingomesh.operators import report
from lingomesh.operators.match import run_matching
from lingomesh.operators.order import with_positions
from lingomesh.sources.sinks import write_table


def _run(spark):
    rows = [
        ("de", 0, "https://x.com/de/a?x=1&y=2", [1.0, 0.0, 0.0]),
        ("de", 1, "https://x.com/de/b", [0.0, 1.0, 0.0]),
        ("de", 2, "https://x.com/de/c", [0.0, 0.0, 1.0]),
        ("fr", 0, "https://x.com/fr/a", [1.0, 0.0, 0.0]),
        ("fr", 1, "https://x.com/fr/b", [0.0, 0.9, 0.43589]),
        ("en-GB", 0, "https://x.com/en/a", [1.0, 0.0, 0.0]),
    ]
    valid = spark.createDataFrame(
        [(c, p, u, u.replace("https://", ""), v) for c, p, u, v in rows],
        "code string, pos long, url string, norm_url string, vec array<float>",
    )
    res = run_matching(valid, "de", threshold=0.85, band=0.1, min_margin=0.02)
    return res, report.clusters(res, valid)


def test_clusters_and_tables(spark):
    res, cl = _run(spark)
    c = {r["pivot_pos"]: r for r in cl.collect()}
    assert len(c[0]["members"]) == 3 and c[0]["confidence"] == "sicher"
    assert len(c[1]["members"]) == 2 and c[1]["confidence"] == "prüfen"
    assert len(c[2]["members"]) == 1
    lean = report.mapping_lean(res, cl).collect()
    assert len(lean) == 3 * 2
    long = {(r["pivot_pos"], r["Sprache"]): r for r in report.mapping_long(res, cl, "en-GB").collect()}
    assert long[(2, "fr")]["Cluster-Konfidenz"] == "kein Treffer" and long[(2, "fr")]["URL"] == ""
    assert long[(1, "fr")]["x-default-Fallback"] == "ja" and long[(0, "fr")]["x-default-Fallback"] == "nein"
    wide = report.mapping_wide(res, cl, "en-GB").orderBy("pivot_pos").collect()
    assert wide[0]["URL (fr)"] == "https://x.com/fr/a" and wide[0]["URL (en-GB)"] == "https://x.com/en/a"
    counts = report.cluster_counts(cl).first()
    assert (counts["clusters"], counts["review"]) == (2, 1)


def test_html_blocks(spark):
    res, cl = _run(spark)
    blocks = report.html_blocks(res, cl, "de", "language-region", include_review=False).orderBy("pivot_pos", "code_rank").collect()
    assert [b["code"] for b in blocks] == ["de", "en-GB", "fr"]
    text = blocks[0]["block"]
    assert text.startswith("<!-- https://x.com/de/a?x=1&amp;y=2 -->\n")
    assert '<link rel="alternate" hreflang="de" href="https://x.com/de/a?x=1&amp;y=2" />' in text
    assert text.endswith('<link rel="alternate" hreflang="x-default" href="https://x.com/de/a?x=1&amp;y=2" />')
    lines = text.split("\n")[1:]
    assert [ln.split('hreflang="')[1].split('"')[0] for ln in lines] == ["de", "en-GB", "fr", "x-default"]
    with_review = report.html_blocks(res, cl, None, "language", include_review=True).collect()
    assert {b["pivot_pos"] for b in with_review} == {0, 1}
    assert 'hreflang="en"' in [b for b in with_review if b["pivot_pos"] == 0][0]["block"]


def test_code_mode_collision(spark):
    assert report.export_code_mode(["de", "de-AT"], "language") == "language-region"
    assert report.export_code_mode(["de", "fr"], None) == "language"
    assert report.export_code_mode(["de", "fr-CH"], None) == "language-region"
    codes = spark.createDataFrame([("de",), ("de-AT",), ("fr",)], "code string")
    got = report.find_language_collisions(codes).collect()
    assert [(r["language"], r["codes"]) for r in got] == [("de", ["de", "de-AT"])]


def test_positions_are_gapless_and_follow_the_order(spark):
    rows = spark.range(0, 5000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), "id", F.lit(-1).alias("ord"))
    got = sorted((r["ord"], -r["k"], r["id"]) for r in with_positions(rows, F.col("k").desc(), "id").collect())
    assert [r[0] for r in got] == list(range(5000))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)
    empty = with_positions(rows.where("id < 0"), "k", name="place")
    assert empty.columns == ["k", "id", "ord", "place"] and empty.count() == 0


def test_positions_in_a_written_table(spark, tmp_path):
    write_table(spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "k string, v int"), str(tmp_path / "t"), order=["k"], position="ord")
    assert [(r["ord"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).orderBy("ord").collect()] == [(0, 2), (1, 3), (2, 1)]


def test_two_variants_of_a_language_need_region_mode(spark):
    """Language mode would give two pages one code: an error that names both variants, before anything is written."""
    result = type("R", (), {"pivot": "de"})()
    schema = "pivot_pos long, pivot_url string, members map<string,string>, confidence string"
    both = spark.createDataFrame([(0, "u", {"de": "u", "en-gb": "v", "en-us": "w"}, "sicher")], schema)
    with pytest.raises(ValueError, match="'en-gb', 'en-us'"):
        report.html_blocks(result, both, None, "language")
    codes = [r["code"] for r in report.html_blocks(result, both, None, "language-region").orderBy("code_rank").collect()]
    assert codes == ["de", "en-gb", "en-us"]
    assert report.html_blocks(result, both.withColumn("confidence", F.lit("prüfen")), None, "language").count() == 0
    assert report.export_code_mode(["de", "en-gb", "en-us"], "language") == "language-region"
    assert report.export_code_mode(["de", "en-gb"]) == "language-region" and report.export_code_mode(["de", "en"]) == "language"
