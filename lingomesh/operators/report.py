"""Result tables: clusters, mapping tables, unmatched list, hreflang blocks
(J6, J7, J8, U1–U6, A5, A8, A9, A13, F11, F12, X14, X15, O3, O5).

A cluster is one row per pivot URL; the mapping grid is pivot rows × other languages,
built with an ``explode`` over the short code list.  Everything grows with
(#pivot rows × #languages), never with the similarity work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.codes import language_of, normalize_code
from ..functions.text import html_escape, link_tag
from .match import MatchResult


def clusters(result: MatchResult, valid: DataFrame) -> DataFrame:
    """One row per valid pivot URL, with or without matches.

    ``pivot_pos, pivot_url, members map<code,url> (pivot included), matches array<struct>,
    n_matches, confidence`` — confidence ``prüfen`` if any match needs review.
    """
    pv = valid.where(F.col("code") == result.pivot).select(F.col("pos").alias("pivot_pos"), F.col("url").alias("pivot_url"))
    m = result.matches
    grouped = m.groupBy("pivot_pos").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "other_url"))).alias("mm"),
        F.collect_list(F.struct(*[c for c in m.columns if c != "pivot_pos"])).alias("matches"),
        F.count(F.lit(1)).alias("n_matches"),
        F.bool_or(F.col("confidence") == L.CONF_REVIEW).alias("any_review"),
    )
    return pv.join(grouped, "pivot_pos", "left").select(
        "pivot_pos", "pivot_url",
        F.map_concat(F.create_map(F.lit(result.pivot), F.col("pivot_url")),
                     F.coalesce("mm", F.create_map().cast("map<string,string>"))).alias("members"),
        "matches",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.when(F.coalesce("any_review", F.lit(False)), L.CONF_REVIEW).otherwise(L.CONF_SURE).alias("confidence"),
    )


def x_default_fallback(members: F.Column, x_default: str | None) -> F.Column:
    """x-default wanted, at least two members and the x-default language missing."""
    if not x_default:
        return F.lit(False)
    return (F.size(members) >= 2) & ~F.map_contains_key(members, F.lit(x_default))


def mapping_long(result: MatchResult, cl: DataFrame, x_default: str | None) -> DataFrame:
    """Pivot URL × other language, one row even without a match.

    Columns carry the contract's labels; ``pivot_pos`` and ``code_rank`` give the output order.
    """
    g = _grid_rows(result, cl, x_default)
    return g.select(
        "pivot_pos", "code_rank",
        F.col("pivot_url").alias(L.COL_PIVOT_URL.format(result.pivot)),
        F.col("code").alias(L.COL_LANGUAGE),
        F.coalesce("other_url", F.lit("")).alias(L.COL_URL),
        F.col("score").alias(L.COL_SCORE),
        F.coalesce("method", F.lit("")).alias(L.COL_METHOD),
        F.coalesce("m_conf", F.lit("")).alias(L.COL_CONFIDENCE),
        F.coalesce("reason", F.lit("")).alias(L.COL_REASON),
        F.coalesce("second_url", F.lit("")).alias(L.COL_SECOND_URL),
        F.col("second_score").alias(L.COL_SECOND_SCORE),
        F.coalesce("preferred_pivot_url", F.lit("")).alias(L.COL_PREF_URL),
        F.col("preferred_pivot_score").alias(L.COL_PREF_SCORE),
        F.col("cluster_conf").alias(L.COL_CLUSTER_CONF),
        F.col("fallback").alias(L.COL_FALLBACK),
    )


def _grid_rows(result: MatchResult, cl: DataFrame, x_default: str | None) -> DataFrame:
    others = [c for c in result.codes if c != result.pivot]
    rows = cl.select(
        "pivot_pos", "pivot_url", "n_matches", F.col("confidence").alias("cl_conf"), "members",
        F.posexplode(F.array(*[F.lit(c) for c in others])).alias("code_rank", "code"),
    )
    m = result.matches.select(
        "pivot_pos", "code", "other_url", "score", "method", F.col("confidence").alias("m_conf"), "reason",
        "second_url", "second_score", "preferred_pivot_url", "preferred_pivot_score",
    )
    return rows.join(m, ["pivot_pos", "code"], "left").withColumn(
        "cluster_conf", F.when(F.col("n_matches") > 0, F.col("cl_conf")).otherwise(L.NO_MATCH_CONFIDENCE)
    ).withColumn(
        "fallback", F.when(x_default_fallback(F.col("members"), x_default), L.FALLBACK_YES).otherwise(L.FALLBACK_NO)
    )


def mapping_lean(result: MatchResult, cl: DataFrame) -> DataFrame:
    """Four columns: pivot URL, language, URL, score."""
    g = _grid_rows(result, cl, None)
    return g.select(
        "pivot_pos", "code_rank",
        F.col("pivot_url").alias(L.COL_PIVOT_URL.format(result.pivot)),
        F.col("code").alias(L.COL_LANGUAGE),
        F.coalesce("other_url", F.lit("")).alias(L.COL_URL),
        F.col("score").alias(L.COL_SCORE),
    )


def mapping_wide(result: MatchResult, cl: DataFrame, x_default: str | None) -> DataFrame:
    """One row per pivot URL, nine columns per other language in fixed order (U4)."""
    others = [c for c in result.codes if c != result.pivot]
    g = _grid_rows(result, cl, x_default)
    fields = [
        ("URL", F.coalesce("other_url", F.lit(""))), ("Score", F.col("score")),
        ("Methode", F.coalesce("method", F.lit(""))), ("Konfidenz", F.coalesce("m_conf", F.lit(""))),
        ("Grund", F.coalesce("reason", F.lit(""))), ("Zweitbeste URL", F.coalesce("second_url", F.lit(""))),
        ("Zweitbester Score", F.col("second_score")),
        ("Bevorzugte Pivot-URL", F.coalesce("preferred_pivot_url", F.lit(""))),
        ("Score bevorzugte Pivot-URL", F.col("preferred_pivot_score")),
    ]
    aggs = [
        F.first(F.when(F.col("code") == c, expr), ignorenulls=True).alias(f"{name} ({c})")
        for c in others for name, expr in fields
    ]
    wide = g.groupBy("pivot_pos", "pivot_url", "cluster_conf", "fallback").agg(*aggs)
    return wide.select(
        "pivot_pos", F.col("pivot_url").alias(L.COL_PIVOT_URL.format(result.pivot)),
        *[f"{name} ({c})" for c in others for name, _ in fields],
        F.col("cluster_conf").alias(L.COL_CLUSTER_CONF), F.col("fallback").alias(L.COL_FALLBACK),
    )


def unmatched_table(result: MatchResult, dropped: DataFrame) -> DataFrame:
    """``Sprache, URL, Grund``: per set the dropped rows, then the unmatched ones.

    Order columns ``set_rank, part, stage, pos`` travel along for the sink.
    """
    rank = F.create_map(*[x for i, c in enumerate(result.codes) for x in (F.lit(c), F.lit(i))])
    d = dropped.select(F.col("code"), "url", "reason", F.lit(0).alias("part"), "stage", "pos")
    u = result.unmatched.select("code", "url", F.lit(L.NO_MATCH_REASON).alias("reason"), F.lit(1).alias("part"),
                                F.lit(0).alias("stage"), "pos")
    return d.unionByName(u).select(
        F.coalesce(F.try_element_at(rank, F.col("code")), F.lit(len(result.codes))).alias("set_rank"),
        "part", "stage", "pos",
        F.col("code").alias(L.COL_LANGUAGE), F.col("url").alias(L.COL_URL), F.col("reason").alias(L.COL_REASON),
    )


def find_language_collisions(codes: DataFrame) -> DataFrame:
    """Languages with more than one code (A5); ``codes`` has a ``code`` column."""
    return (
        codes.select("code").distinct()
        .groupBy(language_of("code").alias("language"))
        .agg(F.array_sort(F.collect_list("code")).alias("codes"))
        .where(F.size("codes") > 1)
    )


def export_code_mode(codes: list[str], requested: str | None = None) -> str:
    """Code mode of the export (A13): collisions force ``language-region``; the default is
    ``language-region`` when any code has a region, else ``language``."""
    languages = {c.strip().partition("-")[0].lower() for c in codes}
    if len(languages) < len(codes):
        return "language-region"
    if requested:
        return requested
    return "language-region" if any("-" in c for c in codes) else "language"


def html_blocks(
    result: MatchResult,
    cl: DataFrame,
    x_default: str | None,
    code_mode: str = "language-region",
    include_review: bool = False,
) -> DataFrame:
    """One tag block per member page of every exported cluster.

    ``pivot_pos, code_rank, code, block``; the text file is the blocks in
    ``(pivot_pos, code_rank)`` order separated by a blank line.
    """
    pivot = result.pivot
    c = cl.where(F.size("members") >= 2)
    if not include_review:
        c = c.where(F.col("confidence") != L.CONF_REVIEW)
    ordered = F.concat(F.array(F.lit(pivot)), F.array_sort(F.filter(F.map_keys("members"), lambda k: k != pivot)))
    c = c.withColumn("ordered", ordered).withColumn(
        "fmt", F.transform("ordered", language_of if code_mode == "language" else normalize_code)
    )
    if code_mode == "language":
        clash = c.where(F.size(F.array_distinct("fmt")) < F.size("fmt")).select("ordered", "fmt").limit(1).collect()
        if clash:
            codes, fmt = clash[0]["ordered"], clash[0]["fmt"]
            dup = [o for o, f in zip(codes, fmt) if fmt.count(f) > 1]
            names = ", ".join(f"'{x}'" for x in dup)
            raise ValueError(f"Mehrere Varianten derselben Sprache ({names}) – bitte Modus 'Sprache-Region' verwenden.")
    tags = F.transform(F.arrays_zip("ordered", "fmt"), lambda z: link_tag(z["fmt"], F.element_at(F.col("members"), z["ordered"])))
    if x_default:
        xd_url = F.coalesce(F.try_element_at(F.col("members"), F.lit(x_default)), F.col("pivot_url"))
        tags = F.concat(tags, F.array(link_tag(F.lit(L.X_DEFAULT), xd_url)))
    c = c.withColumn("tag_text", F.array_join(tags, "\n"))
    return c.select(
        "pivot_pos", "members", "tag_text", F.posexplode("ordered").alias("code_rank", "code")
    ).select(
        "pivot_pos", "code_rank", "code",
        F.concat(F.lit("<!-- "), html_escape(F.element_at(F.col("members"), F.col("code"))), F.lit(" -->\n"), F.col("tag_text")).alias("block"),
    )


def cluster_counts(cl: DataFrame) -> DataFrame:
    """Clusters with more than one member, and of these the ones to review."""
    return cl.agg(
        F.count_if(F.size("members") > 1).alias("clusters"),
        F.count_if((F.size("members") > 1) & (F.col("confidence") == L.CONF_REVIEW)).alias("review"),
    )
