"""Result sinks (S7–S9): vector export, mapping / unmatched tables, hreflang tag file.

Parquet is the default table format; CSV with a header row is the exchange format of
crawl tools.  Sinks sort only at the very end (output order is part of the contract),
with a range-partitioned sort, so part files are written in order by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_json
from ..operators.order import with_positions


def export_vectors(valid: DataFrame, decimals: int = 6) -> DataFrame:
    """``code, pos, Address, Embedding`` with the vector as ``[x,…]`` text (S7, X18);
    re-readable by the crawl scan and the vector parser."""
    return valid.select(
        "code", "pos", F.col("url").alias("Address"), vector_json("vec", decimals).alias("Embedding"),
    )


BOM = "\ufeff"


def _csv(df: DataFrame, writer_mode: str, path: str, partition_by: list[str] | None = None) -> None:
    """CSV with a header whose first name carries a byte-order mark, as spreadsheet programs expect;
    the scan takes it off again."""
    data = [c for c in df.columns if c not in (partition_by or [])]
    marked = df.withColumnRenamed(data[0], BOM + data[0]) if data else df
    w = marked.write.mode(writer_mode).option("header", "true").option("encoding", "UTF-8").option("escape", '"')
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", order: list[str] | None = None,
                drop: list[str] | None = None, mode: str = "overwrite", position: str | None = None) -> None:
    """Write a result table (S8); ``order`` columns sort the rows and are then dropped
    unless they are data columns the caller keeps.  ``position`` names a column that carries
    each row's gapless number in that order."""
    if position and order:
        df, order = with_positions(df, *order, name=position), [position]
    out = df.orderBy(*order) if order else df
    if drop:
        out = out.drop(*drop)
    if fmt == "csv":
        _csv(out, mode, path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def write_html(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The tag file (S9): blocks in ``(pivot_pos, code_rank)`` order with a blank line between two
    and one line feed at the end (the part files, one after another, are the file)."""
    order = F.struct("pivot_pos", "code_rank")
    first = blocks.agg(F.min(order).alias("k")).first()["k"]
    is_first = (F.col("pivot_pos") == first["pivot_pos"]) & (F.col("code_rank") == first["code_rank"]) if first else F.lit(True)
    text = F.when(is_first, F.col("block")).otherwise(F.concat(F.lit("\n"), F.col("block")))
    blocks.orderBy("pivot_pos", "code_rank").select(text.alias("block")).write.mode(mode).text(path)


def write_embeddings_csv(valid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV per language code (``code=<c>`` folders) with ``Address, Embedding``."""
    _csv(export_vectors(valid).orderBy("code", "pos").drop("pos"), mode, path, ["code"])


__all__ = ["export_vectors", "write_table", "write_html", "write_embeddings_csv"]
