"""Conflict-constrained best-fit packing of documents into token bins."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import cut, map_runs

#: Tokens that one packing shard gets on average (a memory bound of a task; shards are packed independently).
SHARD_TOKENS = 1_000_000


def word_count(text: Column) -> Column:
    """Tokens of a text for packing: runs of non-white-space."""
    return F.coalesce(F.array_size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each item, taken in the order given.

    Bins are kept ordered by residual; each carries the bitmap of its
    sources and of its duplicate clusters.  An item looks up the smallest
    residual that holds it and walks to the next larger ones until a bin
    without its source and cluster is found (the tightest compatible bin);
    without one, it opens a bin.  A null source or cluster conflicts with
    nothing.
    """
    source_bit: dict = {}
    cluster_bit: dict = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    source_map: list[int] = []
    cluster_map: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_map[order[at][1]] & s or cluster_map[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        source_map[b] |= s
        cluster_map[b] |= c
        if residual > size:
            insort(order, (residual - size, b))
        out.append(b)
    return out


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", tokens: Column | None = None,
         source: Column | None = None, cluster: Column | None = None, shard_tokens: int = SHARD_TOKENS,
         clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, tokens, bin, position): where every token of every document goes.

    No bin holds more than ``capacity`` tokens, two documents of one
    ``source`` or two of one duplicate ``cluster``.  A document longer than
    the capacity is cut into full pieces, each a bin of its own, and a rest
    that is packed like a document.  Documents without tokens need no bin
    (bin and position null); null sources and clusters conflict with
    nothing.  Repeated rows are separate documents.

    Documents are dealt out to shards of about ``shard_tokens`` tokens by a
    hash of id, so a source with a third of all rows spreads over all of
    them; each shard is packed on its own, larger items first (ties by id).
    Bins are numbered shard * 2^32 + bin.  Defaults: words as tokens, the
    columns ``source`` and, as cluster, the trimmed text without case and
    white space runs (exact copies).  ``clusters`` (id_col, cluster) names
    clusters by id, such as the components of a near-duplicate search;
    documents it leaves out keep the default.  An empty table gives an empty result.
    """
    text = F.col("text")
    tokens = word_count(text) if tokens is None else tokens
    source = F.col("source") if source is None else source
    cluster = F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))) if cluster is None else cluster
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.cast("long").alias("n"),
                        source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    if clusters is not None:
        named = clusters.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(F.col("cluster").cast("string")).alias("__named"))
        small = small.join(named, small.doc_id == named["__id"], "left").select(
            "doc_id", "n", "source", F.coalesce(F.concat(F.lit("c"), "__named"), "cluster").alias("cluster"))
    small = cut(small, "pack")
    total = small.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    items = (small.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards)).cast("long"))
             .select("shard", "doc_id", "n", "source", "cluster"))
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "tokens", "bin", "position")])
    packed = map_runs(items, ["shard"], lambda key, cols: _pack_shard(key[0], cols, capacity),
                      "doc_id long, piece long, tokens long, bin long, position long", out)
    none = small.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.col("n").alias("tokens"),
                                       F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("position"))
    return packed.unionByName(none)


def _pack_shard(shard: int, cols: dict, capacity: int) -> dict:
    """Rows of one shard: full pieces in bins of their own after the shared bins."""
    rows = list(zip(*(cols[c].to_pylist() for c in ("doc_id", "n", "source", "cluster"))))
    rest = sorted((r for r in rows if r[1] % capacity),
                  key=lambda r: (-(r[1] % capacity), -1 if r[0] is None else r[0], r[2] or "", r[3] or ""))
    bins = best_fit([r[1] % capacity for r in rest], [r[2] for r in rest], [r[3] for r in rest], capacity)
    filled: dict[int, int] = {}
    placed = []
    for (doc, n, _, _), b in zip(rest, bins):
        at = filled.get(b, 0)
        filled[b] = at + 1
        placed.append((doc, n // capacity, n % capacity, b, at))
    used = len(filled)
    for doc, n, _, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        for piece in range(n // capacity):
            placed.append((doc, piece, capacity, used, 0))
            used += 1
    doc, piece, size, b, at = zip(*placed)
    return {"doc_id": doc, "piece": piece, "tokens": size, "bin": [(shard << 32) + x for x in b], "position": at}
