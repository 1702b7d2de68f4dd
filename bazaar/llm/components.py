"""Connected components as a distributed union-find over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import cut, drop_scratch, scratch_mark, scratch_since


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component = smallest node reachable.

    Alternating large-star / small-star (each round hangs every node's
    larger, then its smaller neighbours on the smallest one) until the edge
    set no longer changes; ends in O(log n) rounds on long chains and in two
    on stars.  The smallest neighbour is an aggregate with partial sums in
    every map task, and the join back to the edges is an equi-join that AQE
    splits at hub nodes, so no node's neighbours meet in one task.  Every
    round is written to the shared folder, and the round before deleted.

    Self loops and repeated edges are allowed, null ends are ignored; an
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    e = (edges.select(F.greatest(F.col(src), F.col(dst)).alias("u"), F.least(F.col(src), F.col(dst)).alias("v"))
         .where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct())
    cur = cut(e, "cc")
    loops = cur.where("u = v")
    star = cur.where("u != v")
    state = _signature(star)
    previous: list[str] = []
    while state[0]:
        mark = scratch_mark(spark)
        nxt = cut(_small_star(_large_star(star)), "cc")
        written = scratch_since(spark, mark)
        new_state = _signature(nxt)
        drop_scratch(spark, previous)
        star, previous = nxt, written
        if new_state == state:
            break
        state = new_state
    linked = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _signature(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    r = e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first()
    return (r[0], r[1], r[2])


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than u is hung on u's smallest neighbour (u included)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are hung on the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = (e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))))
    return hung.where("u != v").distinct()
