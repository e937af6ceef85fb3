"""Row cleaning and language sets.

All languages are cleaned in one plan: ``code`` is a column, never a loop.  The result is
two DataFrames, ``valid`` (L2-normalized vectors) and ``dropped`` (every rejected row with
its reason and the stage that orders the reasons).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import labels as L
from ..functions.codes import is_valid_code
from ..functions.text import col_of, is_blank, text_or_empty, trim_ws
from ..functions.urls import with_normalized_url
from ..functions.vectors import as_vector, l2_normalize, norm_invalid, sum_squares


@dataclass
class CrawlColumns:
    """Which source columns carry what.  ``None`` means the column does not exist."""

    url: str
    embedding: str | None = None
    code: str = "code"
    pos: str = "pos"
    status: str | None = None
    indexability: str | None = None
    note: str | None = None


def is_indexable(value: Column | str) -> Column:
    """Starts with 'indexable' or 'indexierbar' after strip + lower (F2)."""
    v = F.lower(trim_ws(col_of(value).cast("string")))
    return F.coalesce(v.startswith("indexable") | v.startswith("indexierbar"), F.lit(False))


def stripped_url(url: Column | str) -> Column:
    return trim_ws(text_or_empty(col_of(url)))


def row_filter_reason(cols: CrawlColumns, filter_indexable: bool) -> Column:
    """Reason a row is dropped before its vector is looked at, NULL when kept (F1)."""
    url = stripped_url(cols.url)
    chain = F.when(url == "", F.lit(L.DROP_EMPTY_URL)).when(col_of(cols.code).isNull(), F.lit(L.DROP_NO_CODE))
    if filter_indexable and cols.status is not None:
        num = trim_ws(col_of(cols.status).cast("string")).try_cast("double")
        as_int = num.try_cast("long")
        msg = F.when(as_int.isNull(), F.lit(L.DROP_STATUS)).otherwise(
            F.concat(F.lit(L.DROP_STATUS + " "), as_int.cast("string"))
        )
        chain = chain.when(as_int.isNull() | (as_int != 200), msg)
    if filter_indexable and cols.indexability is not None:
        raw = F.coalesce(col_of(cols.indexability).cast("string"), F.lit("nan"))
        chain = chain.when(~is_indexable(cols.indexability), F.format_string(L.DROP_NOT_INDEXABLE.replace("{}", "%s"), raw))
    return chain


def row_filter(df: DataFrame, cols: CrawlColumns, filter_indexable: bool = True) -> DataFrame:
    """``code, pos, url, reason`` for every row; reason NULL means kept."""
    return df.select(
        col_of(cols.code).alias("code"), col_of(cols.pos).alias("pos"),
        stripped_url(cols.url).alias("url"), row_filter_reason(cols, filter_indexable).alias("reason"),
    )


def _missing_reason(cols: CrawlColumns) -> Column:
    if cols.note is None:
        return F.lit(L.DROP_EMB_MISSING)
    note = trim_ws(text_or_empty(cols.note))
    with_note = F.format_string(L.DROP_EMB_MISSING_NOTE.replace("{}", "%s"), F.lit(cols.note), note)
    return F.when(is_blank(cols.note), F.lit(L.DROP_EMB_MISSING)).otherwise(with_note)


def _finalize(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Majority dimension, first-wins dedupe, zero-vector check, normalization.

    ``rows``: ``code, pos, url, vec`` of rows that passed the row filter and have a vector.
    """
    # parsed, normalized rows feed three passes (majority dimension, URL owners, the rows
    # themselves): materialize once instead of re-scanning and re-parsing the crawl
    rows = with_normalized_url(rows, "url").select(
        "code", "pos", "url", "vec", "norm_url", F.size("vec").alias("n"), sum_squares("vec").alias("sumsq"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    # one row per code; the planner broadcasts it only while it is measured to be small
    dims = majority_dim(rows)
    rows = rows.join(dims, "code").withColumn("dim_ok", F.col("n") == F.col("dim")).withColumn("bad_norm", norm_invalid(F.col("sumsq")))
    owners = (
        rows.where(F.col("dim_ok") & ~F.col("bad_norm"))
        .groupBy("code", "norm_url")
        .agg(F.min(F.struct(F.col("pos").alias("opos"), F.col("url").alias("ourl"))).alias("owner"))
    )
    rows = rows.join(owners, ["code", "norm_url"], "left")
    reason = (
        F.when(~F.col("dim_ok"), F.format_string(L.DROP_DIMENSION.replace("{}", "%d"), F.col("n"), F.col("dim")))
        .when(F.col("owner.opos") < F.col("pos"), F.format_string(L.DROP_DUPLICATE.replace("{}", "%s"), F.col("owner.ourl")))
        .when(F.col("bad_norm"), F.lit(L.DROP_ZERO))
    )
    rows = rows.withColumn("reason", reason)
    valid = rows.where(F.col("reason").isNull()).select(
        "code", "pos", "url", "norm_url", l2_normalize("vec", F.col("sumsq")).alias("vec"),
    )
    dropped = rows.where(F.col("reason").isNotNull()).select("code", "pos", F.lit(3).alias("stage"), "url", "reason")
    return valid, dropped


def majority_dim(rows: DataFrame) -> DataFrame:
    """Most frequent vector length per code, ties to the larger length (A1). ``rows`` has ``code, n``."""
    return (
        rows.groupBy("code", "n").agg(F.count(F.lit(1)).alias("cnt"))
        .groupBy("code").agg(F.max(F.struct("cnt", "n"))["n"].alias("dim"))
    )


def build_sets(
    df: DataFrame,
    cols: CrawlColumns,
    filter_indexable: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Language sets of a crawl with the vectors in a column (L1).

    Returns ``valid(code, pos, url, norm_url, vec)`` and
    ``dropped(code, pos, stage, url, reason)``; stage 1 = row filter, 2 = missing or
    unreadable vector, 3 = dimension / duplicate / zero vector.
    """
    dtype = df.schema[cols.embedding].dataType
    base = df.select(
        col_of(cols.code).alias("code"), col_of(cols.pos).alias("pos"), stripped_url(cols.url).alias("url"),
        row_filter_reason(cols, filter_indexable).alias("r1"),
        col_of(cols.embedding).alias("emb"),
        _missing_reason(cols).alias("missing"),
    )
    blank = F.col("emb").isNull() if isinstance(dtype, ArrayType) else is_blank("emb")
    staged = base.withColumn("vec", F.when(F.col("r1").isNull() & ~blank, as_vector(F.col("emb"), dtype)))
    staged = staged.withColumn(
        "r2",
        F.when(F.col("r1").isNotNull(), F.lit(None).cast("string"))
        .when(blank, F.col("missing"))
        .when(F.col("vec").isNull(), F.lit(L.DROP_EMB_UNREADABLE)),
    )
    d1 = staged.where(F.col("r1").isNotNull()).select("code", "pos", F.lit(1).alias("stage"), "url", F.col("r1").alias("reason"))
    d2 = staged.where(F.col("r2").isNotNull()).select("code", "pos", F.lit(2).alias("stage"), "url", F.col("r2").alias("reason"))
    rows = staged.where(F.col("r1").isNull() & F.col("r2").isNull()).select("code", "pos", "url", "vec")
    valid, d3 = _finalize(rows)
    return valid, d1.unionByName(d2).unionByName(d3)


def sets_from_vectors(
    df: DataFrame,
    cols: CrawlColumns,
    vectors: DataFrame,
    filter_indexable: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Language sets from vectors computed outside the crawl.

    ``vectors``: ``code, pos, vector array<float>, error string``; an error wins over a
    vector, an empty vector is invalid, no row at all means the vector is missing.
    """
    base = df.select(
        col_of(cols.code).alias("code"), col_of(cols.pos).alias("pos"), stripped_url(cols.url).alias("url"),
        row_filter_reason(cols, filter_indexable).alias("r1"),
    )
    v = vectors.select("code", "pos", F.col("vector").alias("vvec"), F.col("error").alias("verr"), F.lit(True).alias("has_row"))
    staged = base.join(v, ["code", "pos"], "left")
    staged = staged.withColumn(
        "r2",
        F.when(F.col("r1").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("verr").isNotNull(), F.col("verr"))
        .when(F.col("vvec").isNotNull() & (F.size("vvec") == 0), F.lit(L.DROP_EMB_INVALID))
        .when(F.col("vvec").isNull(), F.lit(L.DROP_EMB_MISSING)),
    )
    d1 = staged.where(F.col("r1").isNotNull()).select("code", "pos", F.lit(1).alias("stage"), "url", F.col("r1").alias("reason"))
    d2 = staged.where(F.col("r2").isNotNull()).select("code", "pos", F.lit(2).alias("stage"), "url", F.col("r2").alias("reason"))
    rows = staged.where(F.col("r1").isNull() & F.col("r2").isNull()).select(
        "code", "pos", "url",
        F.transform("vvec", lambda x: F.coalesce(x.cast("float"), F.lit(float("nan")).cast("float"))).alias("vec"),
    )
    valid, d3 = _finalize(rows)
    return valid, d1.unionByName(d2).unionByName(d3)


def set_metrics(valid: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per code: valid rows, dimension, dropped rows (A2)."""
    v = valid.groupBy("code").agg(F.count(F.lit(1)).alias("valid_rows"), F.max(F.size("vec")).alias("dim"))
    d = dropped.groupBy("code").agg(F.count(F.lit(1)).alias("dropped_rows"))
    return (
        v.join(d, "code", "full")
        .select("code", F.coalesce("valid_rows", F.lit(0)).alias("valid_rows"), "dim",
                F.coalesce("dropped_rows", F.lit(0)).alias("dropped_rows"))
    )


def invalid_codes(rows: DataFrame) -> DataFrame:
    """Codes of ``rows`` that are no language code (F9), with their rows: ``code, n``; a row without
    any code counts under NULL."""
    bad = F.col("code").isNull() | ~is_valid_code("code")
    return rows.where(bad).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def set_problems(valid: DataFrame, dropped: DataFrame | None = None, pivot: str | None = None) -> DataFrame:
    """Set validation (A11, A12) as a table ``ord, problem``, one row per problem.

    A language whose rows were all dropped counts as a set without valid URLs, which is why the
    dropped rows belong to the check; rows without a code belong to no set.
    """
    spark = valid.sparkSession
    sets = valid.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("dmin"), F.max(F.size("vec")).alias("dmax"))
    if dropped is not None:
        gone = dropped.where(F.col("code").isNotNull()).select("code").distinct().join(sets.select("code"), "code", "left_anti")
        none = F.lit(None).cast("int")
        sets = sets.unionByName(gone.select("code", F.lit(0).cast("long").alias("n"), none.alias("dmin"), none.alias("dmax")))
    rows = sets.withColumn("ok", is_valid_code("code")).collect()                   # one row per code
    usable = {r["code"] for r in rows if r["ok"]}
    filled = [r for r in rows if r["n"]]
    found = [(0, L.SETS_INVALID_CODE.format(r["code"])) for r in sorted(rows, key=lambda r: r["code"] or "") if not r["ok"]]
    found += [(1, L.SETS_TOO_FEW)] if len(usable) < 2 else []
    found += [(2, L.SETS_EMPTY)] if len(filled) < len(rows) else []
    found += [(3, L.SETS_NO_PIVOT.format(pivot))] if pivot is not None and pivot not in usable else []
    widths = {d for r in filled for d in (r["dmin"], r["dmax"])}
    if len(widths) > 1:
        found.append((4, L.SETS_DIMENSIONS.format(", ".join(f"{r['code']}: {r['dmax']}" for r in sorted(filled, key=lambda r: r["code"])))))
    return spark.createDataFrame(found, "ord int, problem string")


def check_sets(valid: DataFrame, pivot: str | None = None, dropped: DataFrame | None = None) -> list[str]:
    """The problems of :func:`set_problems` in order; an empty list means runnable."""
    return [r["problem"] for r in set_problems(valid, dropped, pivot).orderBy("ord").collect()]
