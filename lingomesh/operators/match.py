"""Matching of every language against the pivot.

All languages are matched in one plan: the slug join and the similarity join run keyed by
``code`` (pivot vectors are packed once for all languages; slug-matched pivot rows are passed
to the kernel as a list of excluded positions), and the greedy assignment handles all languages
in the same rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.urls import strip_language
from ..session import cut_lineage
from .assign import greedy_assign
from .similarity import best_pivot_from_scores, block_scores, topk_from_scores


@dataclass
class MatchResult:
    pivot: str
    codes: list[str]
    matches: DataFrame
    unmatched: DataFrame
    stats: DataFrame
    topk: DataFrame
    best: DataFrame
    slug: DataFrame


MATCH_COLUMNS = [
    "code", "pivot_pos", "other_pos", "pivot_url", "other_url", "score", "method", "reciprocal",
    "second_url", "second_score", "margin", "confidence", "reason", "preferred_pivot_url", "preferred_pivot_score",
]


def set_codes(valid: DataFrame) -> list[str]:
    """Language codes present (one small aggregate; the number of languages is tiny)."""
    return sorted(r["code"] for r in valid.select("code").distinct().collect())


def slug_match(pivot_rows: DataFrame, other_rows: DataFrame, pivot: str) -> DataFrame:
    """Exact path join after removing the language segment (J1, W4): ``code, a, b``.

    Only the first row (lowest position) per key on each side takes part, so the join is
    one-to-one per key and hot keys collapse in the map-side aggregate.
    """
    okey = (
        other_rows.select("code", "b", strip_language("norm_url", F.col("code")).alias("key"))
        .groupBy("code", "key").agg(F.min("b").alias("b"))
    )
    pkey = (
        pivot_rows.select("a", strip_language("norm_url", F.lit(pivot)).alias("key"))
        .groupBy("key").agg(F.min("a").alias("a"))
    )
    return okey.join(pkey, "key").select("code", "a", "b")


def review_reason(score, reciprocal, margin, threshold: float, band: float, min_margin: float):
    """``; ``-joined review reasons (X16); empty means sure."""
    parts = F.array(
        F.when(score < F.lit(threshold + band), F.format_string(L.REASON_NEAR_THRESHOLD, score)),
        F.when(~reciprocal, F.lit(L.REASON_NOT_RECIPROCAL)),
        F.when(margin.isNotNull() & (margin < F.lit(min_margin)), F.format_string(L.REASON_AMBIGUOUS, margin)),
    )
    return F.array_join(F.array_compact(parts), L.REASON_SEPARATOR)


def embedding_matches(
    topk: DataFrame, best: DataFrame, assigned: DataFrame,
    threshold: float, band: float, min_margin: float,
) -> DataFrame:
    """Grade assigned pairs: reciprocity, second best, margin, preferred pivot, reasons.

    Second best, reciprocity and preferred pivot use the unfiltered top-k and best-pivot
    tables; only the assignment edges were cut at the threshold (F10).
    """
    rank1 = topk.where(F.col("rank") == 1).select("code", "a", F.col("b").alias("b1"))
    second = (
        topk.join(assigned.select("code", "a", F.col("b").alias("ab")), ["code", "a"])
        .where(F.col("b") != F.col("ab"))
        .groupBy("code", "a")
        .agg(F.min(F.struct("rank", "b", "score")).alias("s"))
        .select("code", "a", F.col("s.b").alias("sb"), F.col("s.score").alias("sscore"))
    )
    bp = best.select("code", "b", F.col("a").alias("pa"), F.col("score").alias("pscore"))
    m = (
        assigned.join(rank1, ["code", "a"], "left")
        .join(bp, ["code", "b"], "left")
        .join(second, ["code", "a"], "left")
    )
    reciprocal = F.coalesce((F.col("b1") == F.col("b")) & (F.col("pa") == F.col("a")), F.lit(False))
    margin = F.col("score") - F.col("sscore")
    reason = review_reason(F.col("score"), reciprocal, margin, threshold, band, min_margin)
    return m.select(
        "code", F.col("a").alias("pivot_pos"), F.col("b").alias("other_pos"),
        F.round("score", 4).alias("score"),
        F.lit(L.METHOD_EMBEDDING).alias("method"),
        reciprocal.alias("reciprocal"),
        F.col("sb").alias("second_pos"),
        F.round("sscore", 4).alias("second_score"),
        F.round(margin, 4).alias("margin"),
        F.when(reason == "", L.CONF_SURE).otherwise(L.CONF_REVIEW).alias("confidence"),
        reason.alias("reason"),
        F.when(F.col("pa") != F.col("a"), F.col("pa")).alias("preferred_pos"),
        F.when(F.col("pa") != F.col("a"), F.round("pscore", 4)).alias("preferred_pivot_score"),
    )


@dataclass
class Similarity:
    """The parts of a run before the assignment."""

    others: list[str]
    pivot_rows: DataFrame
    other_rows: DataFrame
    slug: DataFrame
    topk: DataFrame
    best: DataFrame


def split_sides(valid: DataFrame, pivot: str) -> tuple[DataFrame, DataFrame]:
    """Pivot rows ``a, pivot_url, norm_url, vec`` and other rows ``code, b, other_url, norm_url, vec``."""
    p = valid.where(F.col("code") == pivot).select(F.col("pos").alias("a"), F.col("url").alias("pivot_url"), "norm_url", "vec")
    o = valid.where(F.col("code") != pivot).select("code", F.col("pos").alias("b"), F.col("url").alias("other_url"), "norm_url", "vec")
    return p, o


def similarity(valid: DataFrame, pivot: str, use_slug: bool = False, k: int = L.DEFAULT_K, codes: list[str] | None = None) -> Similarity:
    """Slug pairs, then the cosine top-k and best pivots of the rows that are left."""
    codes = set_codes(valid) if codes is None else list(codes)
    if pivot not in codes:
        raise ValueError(f"Pivot-Sprache '{pivot}' nicht in den Sprachsets.")
    others = [c for c in codes if c != pivot]
    spark = valid.sparkSession
    pivot_rows, other_rows = split_sides(valid, pivot)
    none = spark.createDataFrame([], "code string, a long, b long")
    slug = cut_lineage(slug_match(pivot_rows, other_rows, pivot)) if use_slug and others else none
    if not others:
        topk = spark.createDataFrame([], "code string, a long, b long, score double, rank int")
        best = spark.createDataFrame([], "code string, b long, a long, score double")
        return Similarity(others, pivot_rows, other_rows, slug, topk, best)
    rem_o = other_rows.select("code", "b", "vec")
    if use_slug:
        rem_o = rem_o.join(slug.select("code", "b"), ["code", "b"], "left_anti")
    # the O(n·m) kernel output is written once (reliable checkpoint): an executor lost
    # later never re-runs the similarity work; the reductions over it are cheap
    scores = cut_lineage(block_scores(pivot_rows.select("a", "vec"), rem_o, k, slug.select("code", "a") if use_slug else None))
    return Similarity(others, pivot_rows, other_rows, slug, topk_from_scores(scores, k), best_pivot_from_scores(scores))


def run_matching(
    valid: DataFrame,
    pivot: str,
    threshold: float = L.DEFAULT_THRESHOLD,
    band: float = L.DEFAULT_BAND,
    min_margin: float = L.DEFAULT_MIN_MARGIN,
    use_slug: bool = False,
    k: int = L.DEFAULT_K,
    codes: list[str] | None = None,
) -> MatchResult:
    """Match every non-pivot language to the pivot language (L3)."""
    codes = set_codes(valid) if codes is None else list(codes)
    sim = similarity(valid, pivot, use_slug, k, codes)
    pivot_rows, other_rows, slug, topk, best = sim.pivot_rows, sim.other_rows, sim.slug, sim.topk, sim.best
    emb = None
    if sim.others:
        edges = topk.where(F.col("score") >= F.lit(threshold)).select("code", "a", "b", "score")
        assigned = greedy_assign(edges)
        emb = embedding_matches(topk, best, assigned, threshold, band, min_margin)

    slug_rows = slug.select(
        "code", F.col("a").alias("pivot_pos"), F.col("b").alias("other_pos"),
        F.lit(1.0).alias("score"), F.lit(L.METHOD_SLUG).alias("method"), F.lit(True).alias("reciprocal"),
        F.lit(None).cast("long").alias("second_pos"), F.lit(None).cast("double").alias("second_score"),
        F.lit(None).cast("double").alias("margin"), F.lit(L.CONF_SURE).alias("confidence"), F.lit("").alias("reason"),
        F.lit(None).cast("long").alias("preferred_pos"), F.lit(None).cast("double").alias("preferred_pivot_score"),
    )
    core = slug_rows if emb is None else slug_rows.unionByName(emb)

    # URL lookups by position; every side is renamed so no join depends on column lineage
    purl = pivot_rows.select(F.col("a").alias("a1"), "pivot_url")
    ourl = other_rows.select(F.col("code").alias("c1"), F.col("b").alias("b1"), "other_url")
    matches = (
        core.join(purl, F.col("pivot_pos") == F.col("a1"), "left")
        .join(ourl, (F.col("code") == F.col("c1")) & (F.col("other_pos") == F.col("b1")), "left")
        .join(ourl.select(F.col("c1").alias("c2"), F.col("b1").alias("b2"), F.col("other_url").alias("second_url")),
              (F.col("code") == F.col("c2")) & (F.col("second_pos") == F.col("b2")), "left")
        .join(purl.select(F.col("a1").alias("a3"), F.col("pivot_url").alias("preferred_pivot_url")),
              F.col("preferred_pos") == F.col("a3"), "left")
        .select(*MATCH_COLUMNS)
    )
    # read by the unmatched rows, the statistics and every report: written once
    matches = cut_lineage(matches)

    other_unmatched = other_rows.join(
        matches.select("code", F.col("other_pos").alias("b")), ["code", "b"], "left_anti"
    ).select("code", F.col("b").alias("pos"), F.col("other_url").alias("url"))
    pivot_unmatched = pivot_rows.join(
        matches.select(F.col("pivot_pos").alias("a")).distinct(), "a", "left_anti"
    ).select(F.lit(pivot).alias("code"), F.col("a").alias("pos"), F.col("pivot_url").alias("url"))
    unmatched = other_unmatched.unionByName(pivot_unmatched)

    stats = match_stats(matches, unmatched, valid, pivot)
    return MatchResult(pivot, codes, matches, unmatched, stats, topk, best, slug)


def match_stats(matches: DataFrame, unmatched: DataFrame, valid: DataFrame, pivot: str) -> DataFrame:
    """Per other code slug / embedding / sicher / prüfen / unmatched; pivot total / unmatched."""
    per_code = valid.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    m = matches.groupBy("code").agg(
        F.count_if(F.col("method") == L.METHOD_SLUG).alias("slug"),
        F.count_if(F.col("method") == L.METHOD_EMBEDDING).alias("embedding"),
        F.count_if(F.col("confidence") == L.CONF_SURE).alias("sicher"),
        F.count_if(F.col("confidence") == L.CONF_REVIEW).alias("pruefen"),
    )
    u = unmatched.groupBy("code").agg(F.count(F.lit(1)).alias("unmatched"))
    is_pivot = F.col("code") == pivot

    def other_only(c: str):
        return F.when(is_pivot, F.lit(None).cast("long")).otherwise(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)

    return per_code.join(m, "code", "left").join(u, "code", "left").select(
        "code", other_only("slug"), other_only("embedding"), other_only("sicher"), other_only("pruefen"),
        F.coalesce("unmatched", F.lit(0)).cast("long").alias("unmatched"),
        F.when(is_pivot, F.col("n")).cast("long").alias("total"),
    )
