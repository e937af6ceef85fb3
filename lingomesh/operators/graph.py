"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the undirected edges; root is its component's smallest node.

    Alternating star contraction: in each round every node hands its larger neighbours, then
    its smaller ones, to its smallest neighbour, until nothing changes.  Each round is two
    aggregates with map-side combine and two joins over one edge list, cut by a checkpoint;
    the driver only sees a count and a checksum.  Works for hubs of any degree: the joins are
    on (node, its smallest neighbour), one row per node on one side.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = cut_lineage(edges.select(lo.alias("v"), hi.alias("u")).where("u > v").distinct())
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = large.join(least, F.col("u") == F.col("w"))
        small = (moved.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(moved.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small)
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (row["n"], row["s"]):
            break
        state = (row["n"], row["s"])
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
