"""A1 kept up to date: best sellers from a feed of order-line changes.

Per product, Spark's streaming aggregation keeps three sums that merge and
can be taken back: quantity, revenue in cents, and lines.  A change adds its
line (``insert``) or takes it out again (``delete``); an update is a delete
and an insert.  After every micro-batch the top list is taken from the sums,
one row per product instead of every order line, and written as one version
per batch; a replayed batch writes its version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import SUM_MONEY, money_cents
from bazaar.sources.tables import ORDER_ITEMS, Shop

LINE_CHANGES = T.StructType([T.StructField("op", T.StringType()), *ORDER_ITEMS.fields])


def sales(changes: DataFrame) -> DataFrame:
    """(ProductID, TotalSold, Cents, Lines): signed sums over line changes; works on a stream and on a table alike."""
    sign = F.when(F.col("op") == "delete", F.lit(-1)).otherwise(F.lit(1)).cast("long")
    quantity = F.coalesce(F.col("Quantity"), F.lit(0)).cast("long")
    cents = F.coalesce(quantity * money_cents("UnitPrice"), F.lit(0).cast("long"))
    return changes.groupBy("ProductID").agg(F.sum(sign * quantity).alias("TotalSold"), F.sum(sign * cents).alias("Cents"),
                                            F.sum(sign).alias("Lines"))


def merged(states: list[DataFrame]) -> DataFrame:
    """One state out of several: sums of parts of the feed add up."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("ProductID").agg(*[F.sum(c).alias(c) for c in ("TotalSold", "Cents", "Lines")])


def top_of(state: DataFrame, shop: Shop, n: int = 100) -> DataFrame:
    """A1's rows from a state: products that still have lines, ties by ProductID."""
    revenue = (F.col("Cents").cast(T.DecimalType(38, 0)) / F.lit(100)).cast(SUM_MONEY).alias("TotalRevenue")
    named = shop.named_products.select("ProductID", "ProductName", "Description", "ImageURL", "Price", "StockQuantity", "CategoryName")
    return (state.where("Lines > 0").join(named, "ProductID")
            .select("ProductID", "ProductName", "Description", "ImageURL", "Price", "StockQuantity", "CategoryName", "TotalSold", revenue)
            .orderBy(F.col("TotalSold").desc(), "ProductID").limit(n))


def _version(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/top/v={batch_id:012d}"


def run_top_stream(spark: SparkSession, source_dir: str, root: str, shop: Shop, n: int = 100,
                   max_files_per_trigger: int | None = 1) -> list[str]:
    """Take in every new parquet file of line changes; returns the folders of the lists written, in order.

    Run again later, it goes on where it stopped.
    """
    written: list[str] = []

    def keep(state: DataFrame, batch_id: int) -> None:
        top_of(state, shop, n).coalesce(1).write.mode("overwrite").parquet(_version(root, batch_id))   # n rows
        written.append(_version(root, batch_id))

    reader = spark.readStream.schema(LINE_CHANGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (sales(reader.parquet(source_dir)).writeStream.outputMode("complete").foreachBatch(keep)
         .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return written
