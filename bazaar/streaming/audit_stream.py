"""The audit log over a change feed, batch or Structured Streaming.

A change row is (op, Key, before, after, actor, ts) with ``before`` /
``after`` structs of the audited columns.  ``audit_changes`` is a
stateless select, so the same function serves a batch DataFrame and a
streaming one; ``run_audit_stream`` runs it from a parquet file source
to a parquet sink (append mode, ``availableNow``: every file present is
processed, then the query stops).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import MONEY, as_timestamp, product_audit_text, promo_audit_text
from bazaar.operators.audit import ARROW, DELETE_PRODUCT, DELETE_PROMO, INSERT_PRODUCT, INSERT_PROMO, UPDATE_PRODUCT
from bazaar.session import ensure_checkpoint_dir

PRODUCT_STATE = T.StructType([
    T.StructField("ProductName", T.StringType()), T.StructField("Description", T.StringType()),
    T.StructField("CategoryID", T.LongType()), T.StructField("Price", MONEY),
    T.StructField("StockQuantity", T.IntegerType()), T.StructField("ImageURL", T.StringType()),
])
PROMO_STATE = T.StructType([
    T.StructField("Code", T.StringType()), T.StructField("DiscountPercent", T.IntegerType()),
])


def change_schema(state: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("op", T.StringType()), T.StructField("Key", T.LongType()),
        T.StructField("before", state), T.StructField("after", state),
        T.StructField("actor", T.LongType()), T.StructField("ts", T.TimestampType()),
    ])


CHANGE_SCHEMA = change_schema(PRODUCT_STATE)
PROMO_CHANGE_SCHEMA = change_schema(PROMO_STATE)


def change_feed(old: DataFrame, new: DataFrame, key: str, state: T.StructType, actor_id, as_of) -> DataFrame:
    """Change rows between two snapshots of a table (insert / update /
    delete), with the audited columns of ``state`` before and after."""
    cols = [f.name for f in state.fields]
    o = old.select(F.col(key).alias("Key"), F.struct(*cols).alias("before"))
    n = new.select(F.col(key).alias("Key"), F.struct(*cols).alias("after"))
    d = o.join(n, "Key", "full_outer")
    op = (F.when(F.col("before").isNull(), F.lit("insert"))
          .when(F.col("after").isNull(), F.lit("delete")).otherwise(F.lit("update")))
    return (d.filter(~F.col("before").eqNullSafe(F.col("after")))
            .select(op.alias("op"), "Key", F.col("before").cast(state).alias("before"),
                    F.col("after").cast(state).alias("after"),
                    F.lit(actor_id).cast("long").alias("actor"), as_timestamp(as_of).alias("ts")))


def product_change_feed(old: DataFrame, new: DataFrame, actor_id, as_of) -> DataFrame:
    return change_feed(old, new, "ProductID", PRODUCT_STATE, actor_id, as_of)


def promo_change_feed(old: DataFrame, new: DataFrame, actor_id, as_of) -> DataFrame:
    return change_feed(old, new, "PromoID", PROMO_STATE, actor_id, as_of)


def audit_changes(changes: DataFrame, kind: str = "product") -> DataFrame:
    """Log rows for a change feed (``kind`` 'product' or 'promo'); rows
    without an actor log nothing, and promo updates are not logged."""
    if kind == "product":
        b = product_audit_text("before.ProductName", "before.Price", "before.StockQuantity")
        a = product_audit_text("after.ProductName", "after.Price", "after.StockQuantity")
        action = (F.when(F.col("op") == "insert", F.concat(F.lit(INSERT_PRODUCT), a))
                  .when(F.col("op") == "delete", F.concat(F.lit(DELETE_PRODUCT), b))
                  .otherwise(F.concat(F.lit(UPDATE_PRODUCT), b, F.lit(ARROW), a)))
        logged = changes
    elif kind == "promo":
        action = (F.when(F.col("op") == "insert",
                         F.concat(F.lit(INSERT_PROMO), promo_audit_text("after.Code", "after.DiscountPercent")))
                  .otherwise(F.concat(F.lit(DELETE_PROMO),
                                      promo_audit_text("before.Code", "before.DiscountPercent"))))
        logged = changes.filter(F.col("op") != "update")
    else:
        raise ValueError(f"unknown change kind {kind!r}")
    return (logged.filter(F.col("actor").isNotNull())
            .select(F.col("actor").alias("UserID"), action.alias("Action"),
                    F.col("ts").alias("Timestamp"), "Key"))


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the reliable checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_audit_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     max_files_per_trigger: int | None = None, kind: str = "product", replayed_within: str | None = None) -> None:
    """Parquet change files -> audit rows appended to a parquet sink.

    ``replayed_within``: a feed may deliver a change again, no later than this
    after the newest change seen (an interval, e.g. "1 day"); it is then
    logged once.  A change is known by all its fields, so two equal changes of
    one moment are one.  Spark keeps the changes of that span as state,
    across restarts; changes older than that are left out as late.
    """
    reader = spark.readStream.schema(CHANGE_SCHEMA if kind == "product" else PROMO_CHANGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = reader.parquet(source_dir)
    if replayed_within is not None:
        identity = F.sha2(F.to_json(F.struct(*changes.columns)), 256)
        changes = (changes.withColumn("change", identity).withWatermark("ts", replayed_within)
                   .dropDuplicatesWithinWatermark(["change"]).drop("change"))
    q = (audit_changes(changes, kind)
         .writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start(sink_dir))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
