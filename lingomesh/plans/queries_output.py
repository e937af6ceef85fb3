"""Named queries over the variants of the outputs: row order, x-default, review, collisions, empty texts, detected columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, embed, report
from ..operators.order import with_positions
from ..session import cut_lineage
from ..sources.delimited import parse_lines
from ..sources.tables import CSV_NAMES, crawl_csv_lines, crawl_view, doc_crawl, table
from . import queries as Q

OTHER_X_DEFAULT = "fr"          # a language that is not the pivot


def _clusters(spark: SparkSession, sf: str):
    valid, result = Q._matching(spark, sf)
    return result, cut_lineage(report.clusters(result, valid))


def q_mapping_long_order(spark: SparkSession, sf: str) -> DataFrame:
    """The long mapping with the position of each row in the table."""
    result, cl = _clusters(spark, sf)
    rows = report.mapping_long(result, cl, Q.PARAMS.x_default)
    return with_positions(rows, "pivot_pos", "code_rank").select("ord", "pivot_pos", "Sprache", "URL")


def q_html_blocks_order(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every tag block in the file."""
    result, cl = _clusters(spark, sf)
    blocks = report.html_blocks(result, cl, Q.PARAMS.x_default, include_review=True)
    return with_positions(blocks, "pivot_pos", "code_rank").select("ord", "pivot_pos", "code")


def q_suggest_patterns_order(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern suggestions with their rank (count descending, pattern)."""
    rows = detect.suggest_patterns(table(spark, sf, "pages").select("page_id", "url"), "url", pos="page_id")
    return with_positions(rows, F.col("count").desc(), "pattern").select("ord", "pattern", "code", "count")


def q_x_default_other(spark: SparkSession, sf: str) -> DataFrame:
    """Fallback column of the long mapping with an x-default that is not the pivot: ``ja`` where a
    cluster of two or more pages lacks that language."""
    result, cl = _clusters(spark, sf)
    rows = report.mapping_long(result, cl, OTHER_X_DEFAULT)
    return rows.select("pivot_pos", F.col("Sprache").alias("code"), F.col("x-default-Fallback").alias("fallback"))


def q_html_review_off(spark: SparkSession, sf: str) -> DataFrame:
    """Tag blocks without the clusters to review, with an x-default that is not the pivot."""
    result, cl = _clusters(spark, sf)
    blocks = report.html_blocks(result, cl, OTHER_X_DEFAULT, include_review=False)
    return blocks.select("pivot_pos", F.col("code_rank").cast("long").alias("code_rank"), "code", "block")


def q_region_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Languages with several codes in a crawl whose pages fall into region variants."""
    region = F.when(F.col("pos") % 3 == 0, "-AT").when((F.col("pos") % 3 == 1) & (F.col("code") != "es"), "-ch").otherwise("")
    codes = crawl_view(spark, sf).where("code <> 'es' OR pos % 3 <> 0").select(F.concat("code", region).alias("code"))
    return report.find_language_collisions(codes).select("language", F.array_join("codes", ",").alias("codes"))


def _blank_texts(spark: SparkSession, sf: str):
    blank = F.col("pos") % 7 == 3
    crawl = doc_crawl(spark, sf).withColumns({c: F.when(~blank, F.col(c)) for c in Q.DOC_TEXT_COLS})
    texts = embed.texts_for_rows(crawl, Q.DOC_COLS, Q.DOC_TEXT_COLS, filter_indexable=False)
    return embed.sets_from_texts(crawl, Q.DOC_COLS, texts, embed.sha1_embedder(8), filter_indexable=False, model="sha1-8")


def q_blank_texts_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Text mode where every seventh row has no text: the rows that got a vector."""
    valid, _, _ = _blank_texts(spark, sf)
    return valid.select("code", "pos", "url", F.round(F.col("vec")[0].cast("double"), 6).alias("v0"))


def q_blank_texts_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the same run that were left out, with their reason."""
    _, dropped, _ = _blank_texts(spark, sf)
    return dropped.select("code", "pos", F.col("stage").cast("long").alias("stage"), "url", "reason")


def q_detect_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns found in a scanned export by role, each with its number of filled rows."""
    rows, _ = parse_lines(crawl_csv_lines(spark, sf), CSV_NAMES, ",")
    rows = cut_lineage(rows)
    found = detect.detect_columns(rows)
    roles = [("url", found.url), ("embedding", found.embedding), ("status", found.status), ("indexability", found.indexability)]
    roles += [("text", c) for c in detect.suggest_text_columns(rows.drop("pos"))]
    one = rows.agg(*[F.count_if(F.col(c) != "").alias(f"n{i}") if c else F.lit(0).cast("long").alias(f"n{i}") for i, (_, c) in enumerate(roles)])
    cells = [F.struct(F.lit(role).alias("role"), F.lit(c).cast("string").alias("column"), F.col(f"n{i}").alias("filled")) for i, (role, c) in enumerate(roles)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


QUERIES_OUTPUT: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mapping_long_order": q_mapping_long_order,
    "html_blocks_order": q_html_blocks_order,
    "suggest_patterns_order": q_suggest_patterns_order,
    "x_default_other": q_x_default_other,
    "html_review_off": q_html_review_off,
    "region_collisions": q_region_collisions,
    "blank_texts_valid": q_blank_texts_valid,
    "blank_texts_dropped": q_blank_texts_dropped,
    "detect_columns": q_detect_columns,
}
