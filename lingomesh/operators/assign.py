"""Distributed greedy one-to-one assignment.

The sequential rule: walk the edges by (score desc, a asc, b asc) and take an edge when
both ends are still free.  Over a strict total order this equals repeating rounds of
*take every edge that is the best remaining edge of both its ends; drop all edges that
touch a taken node*.

``ROUNDS`` such rounds run over the edges of all languages together; they settle all but
chains of nearly equal choices.  What is left falls apart into small connected components,
and edges of different components never meet, so each component is walked on its own in a
grouped task: work is split by component, never by language.  A component too large for one
task (more than ``max_component`` edges) stays in the rounds until it has fallen apart; a
strict greedy order is sequential in the worst case, so a single descending chain of more
than that many edges takes many rounds.

One round is two aggregates and three joins, written once by a reliable checkpoint; its
edge counts come from one aggregate over that checkpoint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import components

EDGE_SCHEMA = "code string, a long, b long, score double"
ROUNDS = 3
MAX_COMPONENT = 500_000


def _key() -> F.Column:
    return F.struct((-F.col("score")).alias("ns"), F.col("a"), F.col("b"))


def _one_round(edges: DataFrame) -> DataFrame:
    """The edges with ``state``: 1 = best remaining edge of both its ends, 0 = still open,
    -1 = touches a node that was taken."""
    best_a = edges.groupBy("code", "a").agg(F.min(_key()).alias("k"))
    best_b = edges.groupBy("code", "b").agg(F.min(_key()).alias("k"))
    taken = best_a.join(best_b.select("code", "k"), ["code", "k"]).select("code", "k.a", "k.b")
    ta = taken.select("code", "a", F.col("b").alias("partner"))
    tb = taken.select("code", "b", F.lit(True).alias("b_taken"))
    state = (
        F.when(F.col("partner") == F.col("b"), 1)
        .when(F.col("partner").isNotNull() | F.col("b_taken").isNotNull(), -1).otherwise(0)
    )
    return (edges.join(ta, ["code", "a"], "left").join(tb, ["code", "b"], "left")
            .select("code", "a", "b", "score", state.alias("state")))


def _walk(edges: pa.Table) -> pa.Table:
    """The sequential rule over one component."""
    a, b, score = (edges.column(c).to_numpy() for c in ("a", "b", "score"))
    order = np.lexsort((b, a, -score))
    ia, ib = (np.unique(x, return_inverse=True)[1][order] for x in (a, b))
    taken_a, taken_b = bytearray(len(order)), bytearray(len(order))
    chosen = np.zeros(len(order), bool)
    for i, x, y in zip(order, ia, ib):
        if not (taken_a[x] or taken_b[y]):
            taken_a[x] = taken_b[y] = 1
            chosen[i] = True
    return edges.select(["code", "a", "b", "score"]).filter(pa.array(chosen))


def _with_component(edges: DataFrame) -> DataFrame:
    node_a = F.concat_ws("|", F.lit("a"), "code", F.col("a").cast("string"))
    node_b = F.concat_ws("|", F.lit("b"), "code", F.col("b").cast("string"))
    named = edges.withColumn("na", node_a).withColumn("nb", node_b)
    roots = components(named.select("na", "nb"), "na", "nb")
    return named.join(roots, F.col("na") == F.col("node")).select("code", "a", "b", "score", "root")


def greedy_assign(edges: DataFrame, rounds: int = ROUNDS, max_component: int = MAX_COMPONENT) -> DataFrame:
    """Greedy 1:1 matching per ``code`` of ``edges(code, a, b, score)``."""
    taken: list[DataFrame] = []
    left = edges.select("code", "a", "b", "score")
    while True:
        n_open = 0
        for _ in range(max(rounds, 1)):
            done = cut_lineage(_one_round(left))
            taken.append(done.where("state = 1").select("code", "a", "b", "score"))
            left = done.where("state = 0").select("code", "a", "b", "score")
            n_open = done.agg(F.count_if(F.col("state") == 0)).first()[0]
            if n_open == 0:
                break
        if n_open == 0:
            break
        parts = cut_lineage(_with_component(left))
        sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        small = parts.join(sizes.where(F.col("n") <= max_component).select("root"), "root", "left_semi")
        taken.append(cut_lineage(small.groupBy("root").applyInArrow(_walk, EDGE_SCHEMA)))
        if sizes.where(F.col("n") > max_component).isEmpty():
            break
        left = parts.join(sizes.where(F.col("n") > max_component).select("root"), "root", "left_semi").select("code", "a", "b", "score")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out
