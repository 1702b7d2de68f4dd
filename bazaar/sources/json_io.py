"""JSON sources and sinks: S2 read_logs_json, S3 import_logs, S4
export_logs, S5 export_products, S6 import_products.

The shop's own files are one JSON array per file; those are read by byte
ranges over many tasks (``json_array``).  Large feeds may also be JSON lines
(one object per line), which Spark splits itself.  Schemas are always
explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import MONEY, to_number
from bazaar.operators.ids import max_id, next_ids
from bazaar.sources.json_array import read_json_array, write_json_array

LOG_JSON_SCHEMA = T.StructType([
    T.StructField("LogID", T.LongType()), T.StructField("UserID", T.LongType()),
    T.StructField("Action", T.StringType()), T.StructField("Timestamp", T.StringType()),
])

PRODUCT_JSON_SCHEMA = T.StructType([
    T.StructField("ProductID", T.LongType()), T.StructField("ProductName", T.StringType()),
    T.StructField("Description", T.StringType()), T.StructField("CategoryID", T.LongType()),
    T.StructField("Price", T.StringType()), T.StructField("StockQuantity", T.StringType()),
    T.StructField("ImageURL", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])


# S2 -------------------------------------------------------------------------
def read_logs_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Audit-log JSON: an array per file (``multi_line``, read over many tasks) or JSON lines.
    A leading byte-order mark is tolerated; Timestamp strings with or
    without fraction digits become timestamps."""
    raw = (read_json_array(spark, path, LOG_JSON_SCHEMA) if multi_line
           else spark.read.schema(LOG_JSON_SCHEMA).option("mode", "PERMISSIVE").json(path))
    return raw.select("LogID", "UserID", "Action", F.to_timestamp("Timestamp").alias("Timestamp"))


# S3 -------------------------------------------------------------------------
def import_logs(existing: DataFrame, incoming: DataFrame, dedup: bool = False) -> DataFrame:
    """Append imported log rows with fresh LogIDs after the existing ones
    (incoming ids are not trusted).  ``dedup`` drops rows equal to an
    existing or earlier row on (UserID, Action, Timestamp)."""
    keys = ["UserID", "Action", "Timestamp"]
    inc = incoming.select(F.col("LogID").alias("SourceLogID"), *keys)
    if dedup:
        have = existing.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:      # an audit text may be null: null equals null here
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        inc = inc.groupBy(*keys).agg(F.min("SourceLogID").alias("SourceLogID")).join(have, same, "left_anti")
    numbered = next_ids(inc, ["Timestamp", "SourceLogID", "Action"], max_id(existing, "LogID"), "LogID")
    return existing.select("LogID", *keys).unionByName(numbered.select("LogID", *keys))


# S4 -------------------------------------------------------------------------
def export_logs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Logs as JSON lines, ISO timestamps with microseconds (nothing is cut off)."""
    (df.select("LogID", "UserID", "Action", "Timestamp")
     .write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))


# S5 -------------------------------------------------------------------------
def normalize_image_url(url) -> Column:
    """Backslashes to slashes, drop a drive letter, cut everything before
    the last '/images/'; null or empty stays as is."""
    u = F.col(url) if isinstance(url, str) else url
    slashed = F.regexp_replace(u, r"\\", "/")
    no_drive = F.regexp_replace(slashed, "^[A-Za-z]:", "")
    cut = F.regexp_replace(no_drive, "^.*/images/", "/images/")
    return F.when(u.isNull() | (u == ""), u).otherwise(cut)


def export_frame(products: DataFrame) -> DataFrame:
    return products.select("ProductID", "ProductName", "Description", "CategoryID", "Price",
                           "StockQuantity", normalize_image_url("ImageURL").alias("ImageURL"))


def export_products(products: DataFrame, path: str, mode: str = "overwrite") -> None:
    export_frame(products).write.mode(mode).json(path)


def export_products_array(products: DataFrame, path: str) -> None:
    """Products as JSON array files, the form that the client sends back."""
    write_json_array(export_frame(products), path, ["ProductID"])


# S6 -------------------------------------------------------------------------
def import_products(spark: SparkSession, existing: DataFrame, path: str, multi_line: bool = True,
                    order: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load product JSON (an array per file, as the client sends it, or JSON lines) and append it with new ProductIDs.

    Returns (new products table, added rows, rejects).  A row is rejected
    when it is not valid JSON, or a required field is missing or not a
    number where one is expected.
    """
    raw = (read_json_array(spark, path, PRODUCT_JSON_SCHEMA) if multi_line
           else spark.read.schema(PRODUCT_JSON_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    # Lenient numbers, as the shop's API parses them (F12): blank or
    # non-numeric -> null (then rejected below); "12.0" is a valid 12.
    price = to_number("Price").try_cast(MONEY)
    stock = F.when(to_number("StockQuantity") == F.floor(to_number("StockQuantity")),
                   to_number("StockQuantity")).cast("int")
    typed = raw.select("ProductID", "ProductName", "Description", "CategoryID", price.alias("Price"),
                       stock.alias("StockQuantity"), "ImageURL", "_corrupt_record")
    bad = (F.col("_corrupt_record").isNotNull() | F.col("ProductName").isNull() | F.col("CategoryID").isNull()
           | F.col("Price").isNull() | F.col("StockQuantity").isNull())
    rejects = typed.filter(bad).select(
        "ProductID", "ProductName", "_corrupt_record",
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed JSON"))
        .otherwise(F.lit("missing or invalid field")).alias("reason"))
    cols = ["ProductName", "Description", "CategoryID", "Price", "StockQuantity", "ImageURL"]
    good = typed.filter(~bad).select(F.col("ProductID").alias("SourceID"), *cols)
    added = next_ids(good, order or ["SourceID", "ProductName"], max_id(existing, "ProductID"), "ProductID")
    added = added.select("ProductID", *cols)
    return existing.select("ProductID", *cols).unionByName(added), added, rejects
