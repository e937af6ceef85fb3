"""The driver contract: every registered query runs on the smallest tables and every
oracle key names a registered query."""

import duckdb
import pytest

import __spark_entry__ as E
from lingomesh.plans.queries import QUERIES
from lingomesh.sources.tables import TABLES

from .conftest import SF


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - {"crawl_from_csv"} <= set(o)     # that one is held to the crawl it was made from


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["Pivot-URL (en)", "Sprache", "URL", "Score"]
    assert df.count() > 0 and df.where("URL <> ''").count() > 0


@pytest.mark.parametrize("name", ["matches", "mapping_long", "suggest_patterns", "main_text", "embed_cached", "resolve_redirects",
                                  "page_sets_dropped", "x_default_other", "html_review_off", "blank_texts_dropped", "mapping_long_order", "detect_columns"])
def test_query_equals_oracle_smoke(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    s = E.queries()[name](spark, SF).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    cols = sorted(s.columns)
    cell = lambda v: "" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    key = lambda df: sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert key(s) == key(d)
    if name == "x_default_other":
        assert set(s["fallback"]) == {"ja", "nein"}


def test_crawl_from_csv_equals_the_crawl(spark):
    """The sets built from the export's lines are those of the crawl that the lines were made from,
    but for what short lines and missing words take away."""
    from lingomesh.operators.quality import CrawlColumns, build_sets
    from lingomesh.sources.tables import crawl_view
    from pyspark.sql import functions as F

    c = crawl_view(spark, SF).where("NOT (pos % 13 = 6 AND pos % 17 <> 5)")
    c = c.withColumn("status", F.when((F.col("pos") % 17 == 5) | (F.col("pos") % 7 == 3), F.lit(None)).otherwise(F.col("status")))
    c = c.withColumn("embedding", F.when(F.col("pos") % 17 != 5, F.col("embedding"))).withColumn("code", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1))
    valid, dropped = build_sets(c, CrawlColumns(url="url", embedding="embedding", status="status"))
    want = sorted([(r["pos"], "") for r in valid.collect()] + [(r["pos"], r["reason"]) for r in dropped.collect()])
    got = sorted((r["pos"], r["reason"]) for r in E.queries()["crawl_from_csv"](spark, SF).collect())
    assert got == want and any(not r for _, r in got)
