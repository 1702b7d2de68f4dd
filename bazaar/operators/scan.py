"""Running totals per key without a window over the whole key.

``running_total`` adds, to every row, the sum of ``value`` over the rows of
its key up to and including itself in ``order``.  A window partitioned by
the key would hold a hot key whole in one task; instead the rows are
range-partitioned on (key, order), so a hot key is cut into several
contiguous slices:

1. each slice gets its local running sum (a window over (slice, key),
   bounded by the slice size);
2. the total of every (slice, key) goes into a small table (one row per
   slice a key touches), whose per-key running sum over the slices gives
   each slice's offset;
3. offset + local sum is the running total.

The slices are written under the checkpoint folder before steps 1-2, so
both steps see the same cut even if a task is re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.ids import write_checkpoint


def running_total(df: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same ``key`` with an
    ``order`` position up to this row's (``order`` must be a total order
    within a key)."""
    return running_totals(df, key, order, {out: value})


def running_totals(df: DataFrame, key: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``running_total`` of several columns over the same slices (``sums``: result -> summed column)."""
    sliced = write_checkpoint(df.repartitionByRange(*key, *order).withColumn("__slice", F.spark_partition_id()), "scan")
    upto = Window.partitionBy("__slice", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(upto).alias(f"__local_{o}") for o, v in sums.items()])
    totals = sliced.groupBy("__slice", *key).agg(*[F.sum(v).alias(f"__total_{o}") for o, v in sums.items()])
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__slice", *key, *[F.coalesce(F.sum(f"__total_{o}").over(before), F.lit(0)).alias(f"__offset_{o}")
                                               for o in sums])
    joined = local.join(offsets, ["__slice", *key], "inner")
    return (joined.withColumns({o: F.col(f"__offset_{o}") + F.col(f"__local_{o}") for o in sums})
            .drop("__slice", *[f"__local_{o}" for o in sums], *[f"__offset_{o}" for o in sums]))
