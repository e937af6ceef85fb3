"""Queries of this subpackage over the driver tables: one ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, fingerprints, html_text, ngram_join, packing, quality_rules, random_indexing, sentencepiece_viterbi, sharding, source_divergence,
               substring_dedup, toxicity, warc)
from .common import table
from .oracle import ORACLE  # noqa: F401


def op1_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encoded(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op6_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the distances stay in the operator's own result: the same sums in another order differ in the last bit
    return quality_rules.metrics(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance", "common_distance")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), warc.shared_folder(spark))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op8_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sharding.placement(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op11_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_indexing.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sentencepiece_viterbi, op2_fingerprints, op3_warc_zip, op4_counterfactual_toxicity, op5_substring_dedup, op6_template_deduction, op7_quality_rules, op8_min_cost_flow_sharding, op9_pattern_packing, op10_ngram_join,
        op11_random_indexing_quality, op12_phrase_collocations, op13_source_divergence,
    )
}
