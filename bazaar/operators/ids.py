"""Identity values for new rows, numbered in a total order.

``row_number()`` over an unpartitioned window would pull every new row
into one task.  Instead the rows are range-partitioned on the order
columns and sorted inside each partition; each row's id is the count of
rows in earlier partitions (a table with one row per partition, so its
broadcast is bounded by the partition count) plus its index inside its
own partition.  The tagged rows are written as a parquet table under
the reliable checkpoint folder before counting (one pass; a Dataset
checkpoint would compute its input twice), so a lost executor cannot
renumber them.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.session import ensure_checkpoint_dir


def write_checkpoint(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as a parquet table under the reliable checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.checkpoint_path = path
    return back


def drop_checkpoint(table: DataFrame) -> None:
    """Delete the folder behind a frame as ``write_checkpoint`` returned it (nothing may read it any more)."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.checkpoint_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def max_id(df: DataFrame, col: str) -> int:
    """Largest existing id (0 for an empty table): one scalar to the driver."""
    row = df.agg(F.max(col).alias("m")).first()
    return int(row["m"]) if row is not None and row["m"] is not None else 0


def next_ids(df: DataFrame, order_by: list[str], start: int, id_col: str,
             checkpoint: bool = True) -> DataFrame:
    """Number ``df`` as start+1, start+2, ... in ``order_by`` order.

    ``order_by`` must be a total order (a unique key) for the numbering
    to be reproducible.
    """
    # Range partitioning samples its input in a job of its own before the
    # write runs it again: keep the input for the two passes.
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if checkpoint else df
    ranked = src.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    tagged = (ranked.withColumn("__pid", F.spark_partition_id())
              .withColumn("__row", F.monotonically_increasing_id()))
    if checkpoint:
        tagged = write_checkpoint(tagged, "ids")
        src.unpersist()
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", "__first",
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = tagged.join(F.broadcast(offsets), "__pid", "inner")
    new_id = (F.lit(start) + F.col("__off") + (F.col("__row") - F.col("__first")) + F.lit(1)).cast("long")
    return out.withColumn(id_col, new_id).drop("__pid", "__row", "__first", "__off")
