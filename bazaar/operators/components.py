"""Connected components of an edge table, and the scratch tables its rounds are written to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.ids import drop_checkpoint, write_checkpoint

#: A node with more than 1 / HUB of all edges is a hub: there are 2 * HUB of them at most.
HUB = 500


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component = smallest node reachable.

    Alternating large-star / small-star: every round hangs each node's
    larger, then its smaller neighbours on the smallest one, until nothing
    changes (O(log n) rounds on chains, two on stars).  A hub's edges never
    meet in one task: the smallest neighbour is an aggregate, and the few
    hubs (see HUB; bounded by their definition) are handed to the edges as a
    broadcast, the other nodes by an equi-join.  Every round is written
    under the checkpoint folder, and the round before deleted.
    """
    both = [F.greatest(F.col(src), F.col(dst)).alias("u"), F.least(F.col(src), F.col(dst)).alias("v")]
    cur = write_checkpoint(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*both).distinct(), "cc")
    loops, star = cur.where("u = v").select("u", "v"), cur.where("u != v")
    first, mark = cur, _signature(star)
    previous = None
    while mark[0]:
        nxt = write_checkpoint(_small_star(_large_star(star, mark[0]), mark[0]), "cc")
        new = _signature(nxt)
        if previous is not None:
            drop_checkpoint(previous)
        star, previous = nxt, nxt
        if new == mark:
            break
        mark = new
    linked = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = write_checkpoint(nodes.unionByName(alone).groupBy("node").agg(F.min("component").alias("component")), "cc")
    for used in [first] + ([previous] if previous is not None else []):
        drop_checkpoint(used)
    return out


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
    return (r[0], r[1], r[2])


def _with_low(e: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """``e`` with ``m`` of its ``u`` from ``low`` (u, m, degree): hubs by broadcast, the others by a join."""
    hubs = low.where(F.col("degree") * F.lit(HUB) > F.lit(edges)).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = e.join(F.broadcast(hubs), e["u"] == hubs["hub"], "left")
    rest = marked.where("hub is null").select("u", "v").join(low.select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Every neighbour larger than u is hung on u's smallest neighbour (u included)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    return _with_low(both.where("v > u"), low, edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    """u and its smaller neighbours are hung on the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    hung = (_with_low(e, low, edges).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))))
    return hung.where("u != v").distinct()
