"""Sharding: minimum-cost-flow resharding under the law ``rows``.

Documents lie in ``old_shards`` shards by a hash of their id; they shall lie in ``new_shards``
whose row counts differ by one at most.  Old shard i is new shard i too, so a row that stays
costs nothing; a row that moves costs its bytes.

1. Spark counts rows and bytes per block: old shard x size class (powers of two, two classes
   each); a table of at most old_shards x ~128 rows, whatever the number of documents.
2. The driver solves the transfer as a minimum-cost flow: every row of every block enters it.  A
   row of a block costs nothing on the arc to its own shard and the block's mean bytes on the arc
   to the pool, from which all shards are reached.  A shard passes ``base`` rows on, and one more
   through a gate that is open as often as there are rows left over.  So the flow decides what
   stays, what moves where, and which shards take the extra row.
3. Spark ranks the rows of each block (``common.gapless_rank``, salted), and the flow's ranges of
   ranks say where a row goes.  Slots are ranks within the new shard.
4. ``rewrite`` writes only the files of shards that gain or lose rows.

Groups of equal texts are dealt like any other rows: under this law a group larger than a shard
cannot lie in one, so equal texts may lie in different shards.

Edge cases: null text has size 16; a null id is in old shard 0; ids may repeat, rows are placed one
by one.  Fewer rows than shards leaves shards empty.  Extra columns are ignored by ``placement``
and kept by ``rewrite``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gapless_rank

OLD_SHARDS = 32
NEW_SHARDS = 40


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, float]], supplies: list[tuple[int, int]], sink: int) -> list[int]:
    """Amounts on ``arcs`` (``tail, head, capacity, cost`` of 0 or more) that bring all supplies (``node, amount``) to
    the sink at the least cost.  Successive shortest paths with potentials; a path takes as much as its arcs allow,
    so the number of paths follows the size of the network and not the amounts."""
    head, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for tail, to, capacity, price in arcs:                    # arc k is edge 2k, its way back edge 2k + 1
        for u, v, c, w in ((tail, to, capacity, float(price)), (to, tail, 0, -float(price))):
            out[u].append(len(head))
            head.append(v)
            room.append(c)
            cost.append(w)
    potential = [0.0] * nodes
    for start, left in supplies:
        while left > 0:
            dist, via, heap, done = {start: 0.0}, {}, [(0.0, start)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                if u == sink:
                    break
                for e in out[u]:
                    v = head[e]
                    if room[e] > 0 and v not in done:
                        reach = d + max(cost[e] + potential[u] - potential[v], 0.0)
                        if reach < dist.get(v, float("inf")):
                            dist[v], via[v] = reach, e
                            heapq.heappush(heap, (reach, v))
            if sink not in done:
                raise ValueError("the network cannot take all supplies")
            path, v = [], sink
            while v != start:
                path.append(via[v])
                v = head[via[v] ^ 1]
            amount = min(left, *(room[e] for e in path))
            for e in path:
                room[e] -= amount
                room[e ^ 1] += amount
            left -= amount
            for v in done:                                    # nodes beyond the sink keep their distance to it
                potential[v] += dist[v] - dist[sink]
    return [room[2 * k + 1] for k in range(len(arcs))]


def transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int, int]]:
    """``old, class, first_rank, n, shard`` for blocks ``(old, class, rows, bytes)``: new shards whose
    row counts differ by one at most, with the fewest moved bytes over all choices of the larger ones."""
    blocks = sorted(blocks)
    total, nb = sum(b[2] for b in blocks), len(blocks)
    base, more = divmod(total, new_shards)
    shard, pool = range(nb, nb + new_shards), nb + new_shards
    gate, sink = pool + 1, pool + 2
    arcs = []
    for i, (old, _, rows, size) in enumerate(blocks):
        if old < new_shards:
            arcs.append((i, shard[old], rows, 0.0))
        arcs.append((i, pool, rows, size / rows))
    arcs += [arc for s in shard for arc in ((pool, s, total, 0.0), (s, sink, base, 0.0), (s, gate, 1, 0.0))]
    arcs.append((gate, sink, more, 0.0))
    flow = min_cost_flow(sink + 1, arcs, [(i, b[2]) for i, b in enumerate(blocks)], sink)
    stays, leaves, wanted = [0] * nb, [0] * nb, [0] * new_shards
    for (tail, to, _, _), amount in zip(arcs, flow):
        if tail < nb:
            if to == pool:
                leaves[tail] = amount
            else:
                stays[tail] = amount
        elif tail == pool:
            wanted[to - nb] = amount
    out = [(old, cls, 0, n, old) for (old, cls, _, _), n in zip(blocks, stays) if n]
    at = 0                                                    # what the pool holds is dealt in order
    for (old, cls, _, _), first, n in zip(blocks, stays, leaves):
        while n:
            while not wanted[at]:
                at += 1
            part = min(n, wanted[at])
            out.append((old, cls, first, part, at))
            first, n, wanted[at] = first + part, n - part, wanted[at] - part
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, old_shards: int) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16
    old = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(old_shards)), F.lit(0)).cast("int")
    return docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
                       old.alias("old_shard"), F.floor(F.log2(size.cast("double")) * 2).cast("int").alias("class"))


def placement(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old_shards: int = OLD_SHARDS,
              new_shards: int = NEW_SHARDS) -> DataFrame:
    """Per row: id, ``size, text_crc32, old_shard, shard, slot``."""
    rows = checkpointed(_sized(docs, id_col, text_col, old_shards))
    blocks = rows.groupBy("old_shard", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()    # <= old_shards x 128
    plan = transfers([(b["old_shard"], b["class"], b["n"], b["bytes"]) for b in blocks], new_shards)
    table = docs.sparkSession.createDataFrame(plan, "o int, c int, first_rank long, n long, shard int")
    moves = table.groupBy("o", "c").agg(F.collect_list(F.struct("first_rank", "n", "shard")).alias("moves"))
    ranked = gapless_rank(rows, ["old_shard", "class"], ["id", "text_crc32"], "rank")
    hit = F.filter("moves", lambda m: (m["first_rank"] <= F.col("rank")) & (F.col("rank") < m["first_rank"] + m["n"]))
    put = ranked.join(F.broadcast(moves), (F.col("old_shard") == F.col("o")) & (F.col("class") == F.col("c"))).withColumn("shard", F.get(hit, F.lit(0))["shard"])
    put = checkpointed(put.select("id", "size", "text_crc32", "old_shard", "shard"))
    out = gapless_rank(put, ["shard"], ["id", "text_crc32"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard", "slot")


def rewrite(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", old_shards: int = OLD_SHARDS,
            new_shards: int = NEW_SHARDS) -> DataFrame:
    """Write the files of every shard that gains or loses rows as ``path/shard=N`` (Parquet, rows in
    slot order) and return ``shard, rows, bytes`` of what was written.  Other shards keep their
    files.  Ids must be unique here, since rows are found again by id."""
    place = checkpointed(placement(docs, id_col, text_col, old_shards, new_shards))
    lost = place.where("old_shard <> shard").select(F.col("old_shard").alias("s"))
    gained = place.where("old_shard <> shard").select(F.col("shard").alias("s"))
    touched = [r["s"] for r in lost.union(gained).distinct().collect() if r["s"] < new_shards]            # <= new_shards
    where = place.where(F.col("shard").isin(touched)).select(F.col(id_col).alias("__id"), "shard", "slot")
    body = docs.join(where, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    body.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return place.where(F.col("shard").isin(touched)).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
