"""Join helpers: the document-style ``lookup`` / ``unwind`` pair.

Broadcast policy: joins are written plainly.  Spark broadcasts a side by its own size
bound (``autoBroadcastJoinThreshold``; for parquet scans, literal rows and
filters of them an upper bound), and AQE by real sizes once a stage has run,
otherwise it shuffles and splits skewed partitions
(``spark.sql.adaptive.skewJoin.enabled``).  No job runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def literal_dimension(df: DataFrame) -> DataFrame:
    """Broadcast a frame built from literal rows (its size is its source)."""
    return F.broadcast(df)


def lookup(left: DataFrame, right: DataFrame, local_field: str, foreign_field: str,
           as_: str, null_matches_null: bool = False, fields: list[str] | None = None,
           split_docs: int | None = None) -> DataFrame:
    """Document ``$lookup`` for a one-to-many key: every left row gets the
    array of matching right rows (``[]`` when none).

    The right side is grouped by its key first -- ``collect_list`` runs
    as a partial aggregate in every map task, then one shuffle -- and the
    left join then meets a unique key, so the left side never fans out.
    Arrays are sorted (struct order = ``fields`` order) for stable output.
    With ``null_matches_null`` a missing local key matches a missing
    foreign key, as ``$lookup`` does.

    ``split_docs=n`` bounds document size for a hot key: each left row's
    matches are spread over up to ``n`` rows (column ``part``) by a hash
    of the matched row, so no single array holds a hot key's whole group.
    Nothing is dropped; the union of the parts is the full array.
    """
    fields = fields or [c for c in right.columns if c != foreign_field]
    elem = F.struct(*[F.col(c) for c in fields])
    keys = [F.col(foreign_field).alias("__lk")]
    if split_docs:
        keys.append(F.pmod(F.xxhash64(*[F.col(c) for c in fields]), F.lit(split_docs)).alias("part"))
    grouped = (right.groupBy(*keys)
               .agg(F.sort_array(F.collect_list(elem)).alias("__docs")))
    cond = (F.col(local_field).eqNullSafe(F.col("__lk")) if null_matches_null
            else F.col(local_field) == F.col("__lk"))
    joined = left.join(grouped, cond, "left")
    empty = F.array().cast(grouped.schema["__docs"].dataType)
    return joined.drop("__lk").withColumn(as_, F.coalesce(F.col("__docs"), empty)).drop("__docs")


def unwind(df: DataFrame, col: str, keep_empty: bool = False) -> DataFrame:
    """Document ``$unwind``: one row per array element (``keep_empty``
    keeps rows whose array is empty or null, with a null element)."""
    fn = F.explode_outer if keep_empty else F.explode
    return df.withColumn(col, fn(F.col(col)))
