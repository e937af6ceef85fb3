"""Positions of the rows of an ordered result (O2, O5): a gapless number that a row carries itself.

A DataFrame's order is lost with the next shuffle and is invisible in a file; ``with_positions``
turns it into a column.  The rows are range-partitioned and sorted by many tasks, written once by a
reliable checkpoint, and numbered by the count of rows in the partitions before their own: no row
passes a single task, only one count per partition does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW_BITS = 33          # fixed value: the share of monotonically_increasing_id that counts rows


def with_positions(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """``df`` plus ``name``: 0, 1, 2 … in the given order.  Rows that tie get different numbers in an
    order of their own; a column of that name is replaced.  An empty table stays empty."""
    rows = df.drop(name).sort(*order)
    placed = cut_lineage(rows).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", _ROW_BITS)
    # one row per partition: the window over them is as small as the number of tasks
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__part"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + within).drop("__part", "__at", "__before")
