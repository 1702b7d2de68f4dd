"""T1 / T2 on large snapshots: only key ranges whose digests differ are compared row by row.

A digest per key range is an aggregate with partial sums in every map task,
one narrow row per range; it can be written along with a snapshot, so a later
comparison reads the digests instead of the snapshot.  Ranges are grouped
under parents (a hash tree of two levels), which are compared first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of one range, and ranges under one parent.
WIDTH = 1024
FANOUT = 256

_DIGEST = ["rows", "mix", "total"]


def _range(key: str, width: int):
    return F.floor(F.col(key) / F.lit(width)).cast("long")


def range_digests(df: DataFrame, key: str, cols: list[str], width: int = WIDTH) -> DataFrame:
    """(range, rows, mix, total): row count, xor and sum of the rows' 64-bit hashes per range of an integer key (not null)."""
    h = F.xxhash64(F.lit(7), F.col(key), *[F.col(c) for c in cols])
    return df.groupBy(_range(key, width).alias("range")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("mix"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("total"))


def _parents(digests: DataFrame, fanout: int) -> DataFrame:
    return digests.groupBy(_range("range", fanout).alias("range")).agg(
        F.sum("rows").alias("rows"), F.bit_xor(F.xxhash64("range", *_DIGEST)).alias("mix"), F.sum("total").alias("total"))


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("range", F.struct(*_DIGEST).alias("a"))
    y = b.select("range", F.struct(*_DIGEST).alias("b"))
    return x.join(y, "range", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("range")


def differing_ranges(old: DataFrame, new: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The ranges whose digests differ or that one side lacks; only children of differing parents are compared."""
    parents = _unequal(_parents(old, fanout), _parents(new, fanout)).withColumnRenamed("range", "parent")

    def below(d: DataFrame) -> DataFrame:
        return d.withColumn("parent", _range("range", fanout)).join(parents, "parent", "left_semi").drop("parent")

    return _unequal(below(old), below(new))


def changed_rows(old: DataFrame, new: DataFrame, key: str, cols: list[str], width: int = WIDTH, fanout: int = FANOUT,
                 old_digests: DataFrame | None = None, new_digests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots in the ranges that differ.

    Digests made before (with the same ``cols`` and ``width``) may be given.
    The list of differing ranges is met by a semi join: few ranges are
    broadcast by their real size, so rows of unchanged ranges leave their
    tasks at the scan.
    """
    a = old_digests if old_digests is not None else range_digests(old, key, cols, width)
    b = new_digests if new_digests is not None else range_digests(new, key, cols, width)
    ranges = differing_ranges(a, b, fanout).withColumnRenamed("range", "__range")

    def picked(df: DataFrame) -> DataFrame:
        return df.withColumn("__range", _range(key, width)).join(ranges, "__range", "left_semi").drop("__range")

    return picked(old), picked(new)


def audit_by_range(audit: Callable[..., DataFrame], old: DataFrame, new: DataFrame, key: str, cols: list[str], actor_id, as_of,
                   **how) -> DataFrame:
    """``audit`` (T1 or T2) of the rows in differing ranges only: the same log rows as of the whole snapshots.

    ``cols`` are the columns that the audit compares.
    """
    o, n = changed_rows(old, new, key, cols, **how)
    return audit(o, n, actor_id, as_of)
