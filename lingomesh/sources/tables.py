"""Driver tables and the crawl views derived from them.

``crawl_view`` turns the raw ``pages`` and ``embeddings`` tables into a crawl table of
the shape the matcher consumes (one row per page, URL, status, indexability and a vector
column).  Everything is a DataFrame plan over the parquet scans, so its work grows with
the tables; only ``page_id`` and ``url`` of ``pages`` are read (the HTML column is pruned).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crawl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl rows ``pos, code, url, status, indexability, vec_kind, embedding``.

    Status, indexability, empty URLs, duplicates and broken vectors are derived from
    ``page_id`` by fixed arithmetic; the vector comes from ``embeddings`` by id.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding"))
    pid = F.col("p.page_id")
    src_id = F.when(pid % 19 == 18, pid - 4).otherwise(pid)
    joined = (
        pages.alias("p").select("page_id", src_id.alias("src_id"))
        .join(pages.alias("s"), F.col("src_id") == F.col("s.page_id"))
        .select(F.col("src_id"), F.col("s.url").alias("s_url"), F.col("p.page_id").alias("pos"))
        .join(emb, F.col("vec_id") == F.col("pos"), "left")
    )
    pos = F.col("pos")
    url = F.when(pos % 41 == 40, F.lit("")).otherwise(
        F.regexp_replace("s_url", "/[0-9]+", F.concat(F.lit("/p"), (F.col("src_id") % 97).cast("string")))
    )
    vec_kind = (
        F.when(pos % 37 == 36, "short").when(pos % 43 == 42, "zero")
        .when((pos % 47 == 46) | F.col("vec_id").isNull(), "none").otherwise("ok")
    )
    vec = (
        F.when(vec_kind == "ok", F.col("embedding"))
        .when(vec_kind == "short", F.slice("embedding", 1, 32))
        .when(vec_kind == "zero", F.array_repeat(F.lit(0.0).cast("float"), 64))
    )
    return joined.select(
        pos.alias("pos"),
        F.regexp_extract("s_url", r"^https?://[^/]+/([a-z]+)/", 1).alias("code"),
        url.alias("url"),
        F.when(pos % 29 == 28, "404").otherwise("200").alias("status"),
        F.when(pos % 31 == 30, "Non-Indexable").otherwise("Indexable").alias("indexability"),
        vec_kind.alias("vec_kind"),
        vec.alias("embedding"),
    )


def crawl_view_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl with the vector as JSON-like text, the way crawl exports carry it."""
    c = crawl_view(spark, sf_dir)
    text = F.when(
        F.col("embedding").isNotNull(),
        F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", "), F.lit("]")),
    )
    return c.withColumn("embedding", text)


def doc_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a text crawl: ``pos, code, url, text, source`` (text mode input)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    return d.select(
        F.col("doc_id").alias("pos"), F.col("lang").alias("code"),
        F.concat(F.lit("https://example.com/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("url"),
        "text", "source",
    )


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a stored crawl log: ``pos, code, url, html, status, content_type, bytes,
    location``.  Status, content type and redirect targets are derived from ``page_id`` by
    fixed arithmetic; a 301 points to the path of the page five ids below (resolved against
    the current host), a 302 points back to the page itself (a redirect loop)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    target = table(spark, sf_dir, "pages").select(F.col("page_id").alias("tid"), F.col("url").alias("turl"))
    pid = F.col("page_id")
    status = F.when(pid % 29 == 28, 404).when(pid % 23 == 22, 301).when(pid % 67 == 66, 302).otherwise(200)
    ctype = F.when(pid % 53 == 52, "application/pdf").when(pid % 59 == 58, "").otherwise("Text/HTML; charset=UTF-8")
    j = p.join(target, pid - 5 == F.col("tid"), "left")
    location = (
        F.when(status == 301, F.regexp_extract("turl", r"^https?://[^/]+(/[^#]*)", 1))
        .when(status == 302, F.col("url"))
    )
    return j.select(
        pid.alias("pos"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("code"),
        "url", "html", status.alias("status"), ctype.alias("content_type"),
        F.octet_length("html").cast("long").alias("bytes"), location.alias("location"),
    )


CSV_NAMES = ["Address", "Status Code", "Embedding", "Title"]


def crawl_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl as lines of a delimited export, ``pos, line``: quoted addresses and vectors,
    doubled quotes in the title, words for missing values; some lines are short, some have a field
    too many."""
    c = crawl_view_text(spark, sf_dir)
    pos = F.col("pos")

    def quoted(x):
        return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))

    status = F.when(pos % 7 == 3, "N/A").otherwise(F.col("status"))
    title = F.concat(F.lit('page "'), pos.cast("string"), F.lit('", '), F.col("vec_kind"))
    short = quoted(F.col("url"))
    full = F.concat_ws(",", short, status, F.coalesce(quoted(F.col("embedding")), F.lit("NULL")), quoted(title))
    line = F.when(pos % 17 == 5, short).when(pos % 13 == 6, F.concat(full, F.lit(",more"))).otherwise(full)
    return c.select("pos", line.alias("line"))
