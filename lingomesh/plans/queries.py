"""Named queries over the driver tables, one per operator family.

Every query reads the given parquet tables (or the crawl view Spark derives from them)
in full.  Matching parameters are the ones the fixtures fix for these tables: pivot
``en``, threshold 0.25, band 0.05, margin 0.02, k 5, slug join on, x-default ``en``.
Output columns are named so the DuckDB twins in :mod:`lingomesh.plans.oracle` match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import labels as L
from ..session import cut_lineage
from ..functions.urls import host_and_path, normalize_url, strip_language, with_normalized_url
from ..functions.vectors import parse_vector_text
from ..operators import detect, embed, pages, report
from ..sources.sinks import export_vectors
from ..operators.match import run_matching, similarity, slug_match, split_sides
from ..operators.quality import CrawlColumns, build_sets, invalid_codes, majority_dim, row_filter, row_filter_reason, set_metrics, set_problems
from ..sources.delimited import parse_lines
from ..sources.tables import CSV_NAMES, crawl_csv_lines, crawl_view, crawl_view_text, doc_crawl, page_log, table
from .oracle_more import SPLIT_PATTERNS
from .pipeline import MatchParams, match_crawl

PARAMS = MatchParams(pivot="en", threshold=0.25, band=0.05, min_margin=0.02, use_slug=True, k=5,
                     x_default="en", include_review=True)
CRAWL_COLS = CrawlColumns(url="url", embedding="embedding", status="status", indexability="indexability")


def _sets(spark: SparkSession, sf: str):
    return build_sets(crawl_view(spark, sf), CRAWL_COLS, PARAMS.filter_indexable)


def _run(spark: SparkSession, sf: str):
    return match_crawl(crawl_view(spark, sf), CRAWL_COLS, PARAMS)


def _matching(spark: SparkSession, sf: str):
    valid, _ = _sets(spark, sf)
    # valid feeds the slug join, the similarity join, clusters and unmatched rows: write it
    # once, which also cuts the long URL / vector expression plan from every later stage
    valid = cut_lineage(valid)
    return valid, run_matching(valid, PARAMS.pivot, PARAMS.threshold, PARAMS.band, PARAMS.min_margin,
                               PARAMS.use_slug, PARAMS.k)


def q_normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return with_normalized_url(pages, "url", "norm_url").select("page_id", "norm_url")


def q_slug_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = crawl_view(spark, sf).select("pos", "code", "url")
    return with_normalized_url(c, "url", "norm_url").select(
        "pos", "code", strip_language(F.col("norm_url"), F.col("code")).alias("slug_key")
    )


def _vector_digest(vec) -> list:
    return [
        F.when(vec.isNotNull(), F.size(vec)).cast("double").alias("n"),
        F.try_element_at(vec, F.lit(1)).cast("double").alias("first"),
        F.try_element_at(vec, F.lit(-1)).cast("double").alias("last"),
    ]


def q_parse_vector(spark: SparkSession, sf: str) -> DataFrame:
    c = crawl_view_text(spark, sf).select("pos", parse_vector_text("embedding").alias("vec"))
    return c.select("pos", *_vector_digest(F.col("vec")))


def q_parse_vector_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", parse_vector_text("text").alias("vec"))
    return d.select("doc_id", *_vector_digest(F.col("vec")))


def q_row_filter(spark: SparkSession, sf: str) -> DataFrame:
    return row_filter(crawl_view(spark, sf), CRAWL_COLS, True)


def q_language_set_valid(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = _sets(spark, sf)
    return valid.select("code", "pos", "url", "norm_url", F.size("vec").cast("long").alias("dim"),
                        F.round(F.col("vec")[0].cast("double"), 6).alias("v0"))


def q_language_set_dropped(spark: SparkSession, sf: str) -> DataFrame:
    _, dropped = _sets(spark, sf)
    return dropped.withColumn("stage", F.col("stage").cast("long"))


def q_majority_dim(spark: SparkSession, sf: str) -> DataFrame:
    c = crawl_view(spark, sf).where(row_filter_reason(CRAWL_COLS, True).isNull())
    dims = majority_dim(c.select("code", F.size("embedding").alias("n")).where("n > 0"))
    return dims.select("code", F.col("dim").cast("long").alias("dim"))


def q_set_metrics(spark: SparkSession, sf: str) -> DataFrame:
    valid, dropped = _sets(spark, sf)
    m = set_metrics(valid, dropped)
    return m.withColumn("dim", F.col("dim").cast("long"))


def q_slug_match(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = _sets(spark, sf)
    sides = split_sides(cut_lineage(valid.select("code", "pos", "url", "norm_url", F.lit(None).alias("vec"))), PARAMS.pivot)
    return slug_match(*sides, PARAMS.pivot).select("code", F.col("a").alias("pivot_pos"), F.col("b").alias("other_pos"))


def _similarity(spark: SparkSession, sf: str):
    valid, _ = _sets(spark, sf)
    return similarity(cut_lineage(valid), PARAMS.pivot, PARAMS.use_slug, PARAMS.k)


def q_topk_similarity(spark: SparkSession, sf: str) -> DataFrame:
    res = _similarity(spark, sf)
    return res.topk.select("code", "a", "b", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def q_best_pivot(spark: SparkSession, sf: str) -> DataFrame:
    res = _similarity(spark, sf)
    return res.best.select("code", "b", "a", F.round("score", 4).alias("score"))


def q_reciprocal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    res = _similarity(spark, sf)
    r1 = res.topk.where("rank = 1").select("code", "a", "b")
    return r1.join(res.best.select("code", "b", "a"), ["code", "a", "b"])


def q_greedy_assignment(spark: SparkSession, sf: str) -> DataFrame:
    _, res = _matching(spark, sf)
    return res.matches.where("method = 'embedding'").select(
        "code", F.col("pivot_pos").alias("a"), F.col("other_pos").alias("b"), "score"
    )


def q_matches(spark: SparkSession, sf: str) -> DataFrame:
    _, res = _matching(spark, sf)
    return res.matches


def q_match_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, res = _matching(spark, sf)
    # counts are NULL where a cell does not exist (pivot row); DOUBLE keeps NULL and numbers comparable
    return res.stats.select("code", *[F.col(c).cast("double").alias(c) for c in
                                      ("slug", "embedding", "sicher", "pruefen", "unmatched", "total")])


def q_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, sf)
    return out.unmatched.select("Sprache", "URL", "Grund")


def q_clusters(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, sf)
    entries = F.transform(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.clusters.select(
        "pivot_pos", "pivot_url", F.array_join(F.array_sort(entries), " | ").alias("members"),
        F.size("members").cast("long").alias("n_members"), "confidence",
    )


def q_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, sf)
    return report.cluster_counts(out.clusters)


def q_mapping_long(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).mapping.drop("pivot_pos", "code_rank")


def q_mapping_lean(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).lean.drop("pivot_pos", "code_rank")


def q_mapping_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).wide.drop("pivot_pos")


def q_html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf).html.select("pivot_pos", F.col("code_rank").cast("long").alias("code_rank"), "code", "block")


def q_language_collisions(spark: SparkSession, sf: str) -> DataFrame:
    codes = crawl_view(spark, sf).select("code")
    return report.find_language_collisions(codes).select("language", F.array_join("codes", ",").alias("codes"))


def q_code_candidates(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return detect.code_candidates(pages, "url").select("page_id", "cand")


def q_suggest_code(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    pages = pages.withColumn("host", host_and_path(F.col("url"))[0])
    return detect.suggest_code(pages, "url", "host", pos="page_id")


def q_suggest_patterns(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return detect.suggest_patterns(pages, "url", pos="page_id")


def q_split_by_patterns(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    split, _invalid = detect.split_by_patterns(pages, "url", SPLIT_PATTERNS)
    return split.select("page_id", "variant")


def pattern_table(n: int = 5000, plain: int = 300) -> list[tuple[str, str]]:
    """A long list of patterns: pages by number from the highest to the lowest, their codes in turn, and the patterns of the short list before the last
    ``plain`` numbers."""
    codes = ("de", "FR", "es", "en-gb", "it")
    numbered = [(rf"/[a-z]{{2}}/[^?#]*{k}(\D|$)", codes[k % 5]) for k in range(n, 0, -1)]
    return numbered[:-plain] + SPLIT_PATTERNS + numbered[-plain:]


def q_split_by_pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    split, _invalid = detect.split_by_pattern_table(pages, "url", pattern_table())
    return split.select("page_id", "variant")


def q_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return detect.column_profile(crawl_view_text(spark, sf), "pos")


def _csv(spark: SparkSession, sf: str):
    return parse_lines(crawl_csv_lines(spark, sf), CSV_NAMES, ",")


def q_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _csv(spark, sf)
    return rows.select("pos", F.col("Address").alias("address"), F.col("Status Code").alias("status"),
                       F.size(parse_vector_text("Embedding")).cast("double").alias("numbers"), F.col("Title").alias("title"))


def q_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = _csv(spark, sf)
    return bad.select("pos")


def q_crawl_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines → columns → detected columns → language sets."""
    rows, _ = _csv(spark, sf)
    rows = cut_lineage(rows)          # read by the detection and by the sets
    found = detect.detect_columns(rows)
    rows = rows.withColumn("code", F.regexp_extract(F.col(found.url), "^https?://[^/]+/([a-z]+)/", 1))
    valid, dropped = build_sets(rows, CrawlColumns(url=found.url, embedding=found.embedding, status=found.status))
    return (valid.select("pos", F.lit("").alias("reason")).unionByName(dropped.select("pos", "reason")))


def q_set_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Validation of sets in which one language has no code of the right shape and another has lost
    all its rows."""
    c = crawl_view(spark, sf)
    c = c.withColumn("status", F.when(F.col("code") == "fr", "404").otherwise(F.col("status")))
    c = c.withColumn("code", F.when(F.col("code") == "es", "spanish").when(F.col("pos") % 50 == 7, F.lit(None)).otherwise(F.col("code")))
    valid, dropped = build_sets(c, CRAWL_COLS)
    return set_problems(cut_lineage(valid.select("code", "vec")), dropped, "it").select("problem")


def q_invalid_codes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^./]+)", 1).alias("code"))
    return invalid_codes(p)


def q_page_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs: even pages fill the cache, then all pages read it; new rows of both runs."""
    p = table(spark, sf, "pages").select(F.lit("x").alias("code"), F.col("page_id").alias("pos"), "url", "html")
    one = p.groupBy("code", "url").agg(F.min_by(F.struct("pos", "html"), "pos").alias("s")).select("code", "url", "s.pos", "s.html")
    none = spark.createDataFrame([], "url string, text string")
    _, first = pages.cached_page_texts(one.where("pos % 2 = 0"), none)
    first = cut_lineage(first)
    _, second = pages.cached_page_texts(one, first)
    rows = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return rows.select("url", "run", F.length("text").cast("long").alias("chars"))


DOC_COLS = CrawlColumns(url="url", code="code", pos="pos")
DOC_TEXT_COLS = ["text", "source"]


def q_export_vectors(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = _sets(spark, sf)
    return export_vectors(valid)


def _doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return embed.texts_for_rows(doc_crawl(spark, sf), DOC_COLS, DOC_TEXT_COLS, filter_indexable=False)


def q_build_texts(spark: SparkSession, sf: str) -> DataFrame:
    cut = embed.texts_for_rows(doc_crawl(spark, sf), DOC_COLS, DOC_TEXT_COLS, max_chars=L.EMBED_MAX_CHARS, filter_indexable=False)
    return cut.select(F.col("pos").alias("doc_id"), "text", "error")


def q_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return embed.text_stats(_doc_texts(spark, sf), "text")


def q_embed_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs: the English documents fill a cache, then every document is embedded with
    that cache (hits are not requested again).  The vectors are the same either way."""
    texts = _doc_texts(spark, sf).where(F.col("error").isNull())
    fn = embed.sha1_embedder(8)
    first = embed.embed_texts(texts.where(F.col("code") == "en"), "text", fn, model="sha1-8")
    run = embed.embed_texts(texts, "text", fn, model="sha1-8", cache=first.new_cache)
    v = F.col("vector")
    return run.rows.select(
        F.col("pos").alias("doc_id"), "key", F.size(v).cast("long").alias("dim"),
        F.round(v[0].cast("double"), 6).alias("v0"), F.round(v[7].cast("double"), 6).alias("v7"), "error",
    )


def _text_sets(spark: SparkSession, sf: str):
    crawl = doc_crawl(spark, sf)
    texts = embed.texts_for_rows(crawl, DOC_COLS, DOC_TEXT_COLS, filter_indexable=False)
    return embed.sets_from_texts(crawl, DOC_COLS, texts, embed.sha1_embedder(8), filter_indexable=False, model="sha1-8")


def q_text_sets_valid(spark: SparkSession, sf: str) -> DataFrame:
    valid, _, _ = _text_sets(spark, sf)
    return valid.select("code", "pos", "url", "norm_url", F.size("vec").cast("long").alias("dim"),
                        F.round(F.col("vec")[0].cast("double"), 6).alias("v0"))


def q_text_sets_dropped(spark: SparkSession, sf: str) -> DataFrame:
    _, dropped, _ = _text_sets(spark, sf)
    return dropped.withColumn("stage", F.col("stage").cast("long"))


def q_main_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "html")
    return p.select("page_id", pages.main_text("html").alias("text"))


def q_main_text_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of pages that carry tables, navigation and asides nested one to fifty deep inside their article."""
    p = table(spark, sf, "pages").select("page_id", "html")
    depth = (F.col("page_id") % 50 + 1).cast("int")
    name = F.when(F.col("page_id") % 3 == 0, "table").when(F.col("page_id") % 3 == 1, "nav").otherwise("aside")
    start, end = F.concat(F.lit("<"), name, F.lit(" class=x>menu ")), F.concat(F.lit("</"), name, F.lit("> rest "))
    block = F.concat(F.repeat(start, depth), F.repeat(end, depth - 1), F.lit("</"), name, F.lit(">"))
    nested = F.replace("html", F.lit("</article>"), F.concat(block, F.lit("</article>")))
    return p.select("page_id", pages.main_text(nested).alias("text"))


def q_response_reasons(spark: SparkSession, sf: str) -> DataFrame:
    log = page_log(spark, sf)
    t = pages.page_texts(log)
    return t.select(F.col("pos").alias("page_id"), F.col("error").alias("reason"), F.length("text").cast("long").alias("chars"))


def _host_ips(spark: SparkSession, sf: str) -> DataFrame:
    """Resolution table derived from the page hosts: every host gets one or two addresses
    chosen by its lowest page id (public, private, loopback, link-local, IPv6), and hosts
    whose lowest id ends the cycle get none (unresolvable)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    hosts = p.select("page_id", F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]*)", 1)).alias("host"))
    h = hosts.groupBy("host").agg(F.min("page_id").alias("m"))
    m = F.col("m")
    octet = (m % 250 + 1).cast("string")
    ip1 = (
        F.when(m % 7 == 0, F.lit("127.0.0.1"))
        .when(m % 7 == 1, F.concat(F.lit("10.0."), octet, F.lit(".1")))
        .when(m % 7 == 2, F.lit("169.254.169.254"))
        .when(m % 7 == 3, F.concat(F.lit("192.168.1."), octet))
        .otherwise(F.concat(F.lit("93.184."), octet, F.lit(".34")))
    )
    ip2 = F.when(m % 5 == 0, F.lit("::ffff:10.1.2.3")).when(m % 5 == 1, F.lit("2606:4700::6810:84e5"))
    rows = h.where(m % 11 != 10).select("host", F.explode(F.array_compact(F.array(ip1, ip2))).alias("ip"))
    return rows


def q_url_guard(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    return pages.url_guard(p, "url", _host_ips(spark, sf)).select("page_id", "guard_reason")


def q_resolve_redirects(spark: SparkSession, sf: str) -> DataFrame:
    log = page_log(spark, sf)
    one = log.groupBy("url").agg(F.min_by(F.struct("status", "location"), "pos").alias("s")).select(
        "url", "s.status", "s.location")
    starts = log.select("pos", "url")
    res = pages.resolve_redirects(starts.select("url").distinct(), one)
    return starts.join(res, "url").select(F.col("pos").alias("page_id"), "final_url", F.col("hops").cast("long").alias("hops"),
                                          F.col("status").cast("double").alias("status"), "reason")


PAGE_COLS = CrawlColumns(url="url", code="code", pos="pos")


def _page_sets(spark: SparkSession, sf: str):
    """Page mode: stored responses → main text (or reason) → embeddings → language sets."""
    log = page_log(spark, sf)
    texts = pages.page_texts(log)
    return embed.sets_from_texts(log, PAGE_COLS, texts, embed.sha1_embedder(8), filter_indexable=False, model="sha1-8")


def q_page_sets_valid(spark: SparkSession, sf: str) -> DataFrame:
    valid, _, _ = _page_sets(spark, sf)
    return valid.select("code", "pos", "url", "norm_url", F.size("vec").cast("long").alias("dim"),
                        F.round(F.col("vec")[0].cast("double"), 6).alias("v0"))


def q_page_sets_dropped(spark: SparkSession, sf: str) -> DataFrame:
    _, dropped, _ = _page_sets(spark, sf)
    return dropped.withColumn("stage", F.col("stage").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_url": q_normalize_url,
    "slug_keys": q_slug_keys,
    "parse_vector": q_parse_vector,
    "parse_vector_text": q_parse_vector_text,
    "row_filter": q_row_filter,
    "language_set_valid": q_language_set_valid,
    "language_set_dropped": q_language_set_dropped,
    "majority_dim": q_majority_dim,
    "set_metrics": q_set_metrics,
    "slug_match": q_slug_match,
    "topk_similarity": q_topk_similarity,
    "best_pivot": q_best_pivot,
    "reciprocal_pairs": q_reciprocal_pairs,
    "greedy_assignment": q_greedy_assignment,
    "matches": q_matches,
    "match_stats": q_match_stats,
    "unmatched": q_unmatched,
    "clusters": q_clusters,
    "cluster_counts": q_cluster_counts,
    "mapping_long": q_mapping_long,
    "mapping_lean": q_mapping_lean,
    "mapping_wide": q_mapping_wide,
    "html_blocks": q_html_blocks,
    "language_collisions": q_language_collisions,
    "code_candidates": q_code_candidates,
    "suggest_code": q_suggest_code,
    "suggest_patterns": q_suggest_patterns,
    "split_by_patterns": q_split_by_patterns,
    "split_by_pattern_table": q_split_by_pattern_table,
    "column_profile": q_column_profile,
    "csv_scan": q_csv_scan,
    "bad_lines": q_bad_lines,
    "crawl_from_csv": q_crawl_from_csv,
    "set_problems": q_set_problems,
    "invalid_codes": q_invalid_codes,
    "page_cache": q_page_cache,
    "export_vectors": q_export_vectors,
    "build_texts": q_build_texts,
    "text_stats": q_text_stats,
    "embed_cached": q_embed_cached,
    "text_sets_valid": q_text_sets_valid,
    "text_sets_dropped": q_text_sets_dropped,
    "main_text": q_main_text,
    "main_text_nested": q_main_text_nested,
    "response_reasons": q_response_reasons,
    "url_guard": q_url_guard,
    "resolve_redirects": q_resolve_redirects,
    "page_sets_valid": q_page_sets_valid,
    "page_sets_dropped": q_page_sets_dropped,
}

__all__ = ["QUERIES", "PARAMS", "CRAWL_COLS"]
