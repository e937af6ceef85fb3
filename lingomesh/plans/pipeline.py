"""Full run (L4): crawl → language sets → matching → result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import labels as L
from ..session import cut_lineage
from ..operators import report
from ..operators.match import MatchResult, run_matching
from ..operators.quality import CrawlColumns, build_sets, check_sets


FIRST_CODE = "(first code)"       # x-default: the first code of the sets; None turns x-default off


@dataclass
class MatchParams:
    pivot: str
    threshold: float = L.DEFAULT_THRESHOLD
    band: float = L.DEFAULT_BAND
    min_margin: float = L.DEFAULT_MIN_MARGIN
    use_slug: bool = False
    k: int = L.DEFAULT_K
    filter_indexable: bool = True
    include_review: bool = False
    x_default: str | None = FIRST_CODE
    code_mode: str | None = None


@dataclass
class RunOutput:
    valid: DataFrame
    dropped: DataFrame
    result: MatchResult
    clusters: DataFrame
    mapping: DataFrame
    lean: DataFrame
    wide: DataFrame
    unmatched: DataFrame
    html: DataFrame
    stats: DataFrame


def match_crawl(crawl: DataFrame, cols: CrawlColumns, params: MatchParams, codes: list[str] | None = None) -> RunOutput:
    """Everything the matcher produces for one crawl table holding all languages."""
    valid, dropped = build_sets(crawl, cols, params.filter_indexable)
    # valid feeds the slug join, the similarity join, clusters and unmatched rows: write it
    # once, which also cuts the long URL / vector expression plan from every later stage
    valid = cut_lineage(valid)
    problems = check_sets(valid, params.pivot, dropped)
    if problems:
        raise ValueError(" ".join(problems))
    result = run_matching(
        valid, params.pivot, params.threshold, params.band, params.min_margin, params.use_slug, params.k, codes=codes,
    )
    cl = report.clusters(result, valid)
    x_default = result.codes[0] if params.x_default == FIRST_CODE else params.x_default
    mode = report.export_code_mode(result.codes, params.code_mode)
    return RunOutput(
        valid=valid, dropped=dropped, result=result, clusters=cl,
        mapping=report.mapping_long(result, cl, x_default),
        lean=report.mapping_lean(result, cl),
        wide=report.mapping_wide(result, cl, x_default),
        unmatched=report.unmatched_table(result, dropped),
        html=report.html_blocks(result, cl, x_default, mode, params.include_review),
        stats=result.stats,
    )
