"""A reader for files that hold one JSON array of objects, split over many tasks.

Spark reads such a file with ``multiLine`` in one task.  Here the file is
read by byte ranges as text cut at every ``}``; which of the cuts end an
object is found with running totals over the pieces in file order: the
quotes before a piece tell whether it starts inside a string, the braces
outside strings give the depth, and an object ends where the depth returns
to zero.  The totals carry a few numbers per piece, never its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.operators.ids import write_checkpoint
from bazaar.operators.scan import running_total

_PLACE = ["block", "idx"]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, idx, value, brace, quotes, opens_out, opens_in): the pieces, written once so that their numbers stay.

    ``brace``: whether a ``}`` follows (not after the last piece of a file that ends otherwise);
    ``opens_out`` / ``opens_in``: opening braces outside strings if the piece starts outside / inside one.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("idx"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")          # escaped signs decide nothing
    marked = raw.withColumn("parts", F.split(plain, '"'))
    outside, inside = (F.array_join(F.expr(f"filter(parts, (part, i) -> i % 2 = {k})"), "") for k in (0, 1))
    pieces = write_checkpoint(marked.select(
        "file", "size", *_PLACE, "value", (F.size("parts") - 1).cast("long").alias("quotes"),
        _count(outside, "{").cast("long").alias("opens_out"), _count(inside, "{").cast("long").alias("opens_in")), "pieces")
    ends = pieces.groupBy("file").agg(F.max(F.struct(*_PLACE)).alias("last"),
                                      (F.sum(F.octet_length("value") + 1) == F.max("size")).alias("closed"))
    at = F.struct(*_PLACE)
    return pieces.join(ends, "file").withColumn("brace", F.when(at == F.col("last"), F.col("closed").cast("long")).otherwise(F.lit(1).cast("long"))) \
        .drop("last", "closed", "size")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text): the text of every object of the array files under ``path``.

    ``number`` counts the objects of a file.  Quotes, escapes, braces inside
    strings, nested objects, line breaks and a leading byte-order mark are
    understood.  What is left at the end of a broken file comes as one last
    text, for the parser to report.  An empty array gives nothing.
    """
    pieces = _pieces(spark, path)
    totals = running_total(pieces.select("file", *_PLACE, "quotes", "opens_out", "opens_in", "brace"), ["file"], _PLACE, "quotes", "upto")
    after = F.col("upto") % 2
    opens = F.when((F.col("upto") - F.col("quotes")) % 2 == 0, F.col("opens_out")).otherwise(F.col("opens_in"))
    closes = F.when(after == 0, F.col("brace")).otherwise(F.lit(0).cast("long"))
    steps = totals.select("file", *_PLACE, closes.alias("closes"), (opens - closes).alias("step"))
    deep = running_total(steps, ["file"], _PLACE, "step", "depth")
    ended = (F.col("closes") * (F.col("depth") == 0).cast("long")).alias("ended")
    numbered = running_total(deep.select("file", *_PLACE, ended), ["file"], _PLACE, "ended", "done")
    named = numbered.select("file", *_PLACE, (F.col("done") - F.col("ended")).alias("number"))
    part = F.concat("value", F.when(F.col("brace") == 1, "}").otherwise(""))
    whole = (pieces.join(named, ["file", *_PLACE]).groupBy("file", "number")
             .agg(F.sort_array(F.collect_list(F.struct(*_PLACE, part.alias("part")))).alias("parts")))
    text = F.regexp_replace(F.array_join(F.col("parts.part"), ""), r"^\x{FEFF}?[\s,\[]*", "")
    return whole.select("file", "number", text.alias("text")).where(~F.col("text").rlike(r"^[\s\]]*$"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON array files with an explicit schema.

    An object that does not parse has nulls, and its text in the schema's
    ``_corrupt_record`` column if there is one.
    """
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return json_objects(spark, path).select(parsed.alias("row")).select("row.*")


def write_json_array(df: DataFrame, path: str, order: list[str], options: dict[str, str] | None = None) -> None:
    """``df`` as JSON array files under ``path``, one per range of ``order`` (a unique key, not null)."""
    ranged = write_checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "array")
    key = F.struct(*order)
    ends = ranged.groupBy("__part").agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"} | (options or {}))
    line = F.concat(F.when(key == F.col("__first"), "[").otherwise(""), text, F.when(key == F.col("__last"), "]").otherwise(","))
    (ranged.join(ends, "__part").repartition("__part").sortWithinPartitions("__part", *order)
     .select(line.alias("value"), "__part").write.partitionBy("__part").text(path))
