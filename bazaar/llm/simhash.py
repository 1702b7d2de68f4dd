"""SimHash near duplicates: majority fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import cut
from bazaar.llm.components import connected_components

SEED = 42


def _fingerprint(text: bytes | None, width: int) -> int:
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    if n < width:
        spans = [b" ".join(words)]
    else:
        buf = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = [buf[a:b] for a, b in zip(starts[:n - width + 1].tolist(), (ends[width - 1:] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in spans], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a:a + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprints(text: Column, width: int = 3) -> Column:
    """Signed 64-bit SimHash of a text: bit set where over half of the shingle hashes have it.

    A-Z are lower-cased, words are runs of non-white-space (ASCII), shingles
    are ``width`` words joined by one space, repeats counted; a shorter text
    is one shingle; null, empty and blank texts have fingerprint zero.
    """
    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([_fingerprint(t, width) for t in s], dtype="int64")

    return fp(text.cast("binary"))


def hex64(col: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def hamming_links(prints: DataFrame, col: str = "fp", max_bits: int = 3) -> DataFrame:
    """All pairs (src < dst) of different fingerprints at ``max_bits`` or fewer differing bits.

    Multi-index hashing: the 64 bits are cut into two 32-bit segments.  Two
    fingerprints within 3 bits agree in one of them but for at most
    ``max_bits // 2`` = 1 bit, so each fingerprint looks up, per segment,
    the Hamming ball of that radius around its segment in the table of
    segments, and full distances are verified inside the join.  The
    ball is enumerated towards set bits only: of two segments that differ in
    one bit, just one has the zero, so a pair is met once per segment.
    32-bit segments keep a lookup selective (rows / 2^32 chance hits), and
    the join is an equi-join without a hot bucket unless the fingerprints
    themselves are near.  ``prints`` must be distinct.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments cover distances up to 3 bits")
    fp = F.col(col)
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    segments = F.array(low, F.shiftleft(F.lit(1).cast("long"), 32).bitwiseOR(high))
    table = prints.select(fp.alias("b"), F.explode(segments).alias("key"))
    seg = prints.select(fp.alias("a"), F.explode(segments).alias("seg"))
    if max_bits >= 2:
        masks = F.array([F.lit(0).cast("long")] + [F.lit(1 << i).cast("long") for i in range(32)])
        probes = (seg.select("a", "seg", F.explode(masks).alias("mask"))
                  .where("mask = 0 or (seg & mask) = 0")
                  .select("a", F.expr("seg | mask").alias("key"), (F.col("mask") == 0).alias("plain")))
    else:
        probes = seg.select("a", F.col("seg").alias("key"), F.lit(True).alias("plain"))
    near = ((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
            & (F.col("a") != F.col("b")) & (~F.col("plain") | (F.col("a") < F.col("b"))))
    t = table.withColumnRenamed("key", "bkey")
    return (probes.join(t, (F.col("key") == F.col("bkey")) & near)
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``.

    Rows with equal fingerprints are one point of the link graph, so copies
    are never paired; the component of a group of linked points is the
    smallest id of all their rows (null ids count only if there is no
    other).  Repeated rows give repeated result rows, an empty table none.
    Only the two named columns are read.
    """
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp")), "simhash")
    points = prints.groupBy("fp").agg(F.min("id").alias("low"))
    comp = connected_components(hamming_links(points.select("fp"), "fp", max_bits))
    named = points.join(comp, points.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    smallest = named.groupBy("c").agg(F.min("low").alias("component"))
    named = named.join(smallest, "c").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                       max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) whose id is the smallest of its group.

    Rows that repeat the surviving id all stay (they are one document), and
    so do rows without an id: no decision can be tied to them.
    """
    g = simhash_groups(docs, id_col, text_col, width, max_bits)
    gone = g.where("id != component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
