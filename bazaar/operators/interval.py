"""Point-in-interval joins: rows with a moment meet the rows valid at that moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(micros: Column, level: Column) -> Column:
    return F.call_function("shiftright", micros, level)


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` joined with the rows of ``spans`` that share ``keys`` and hold ``at`` between
    ``start`` and ``end``, both inclusive (timestamps).

    Null keys, a null moment, a null bound and a span that ends before it
    starts match nothing.  Columns of both sides stay; other names must differ.

    An equi-join on time bins instead of a range test over all pairs of a
    key: a span goes to the level whose bins (2 ** level microseconds) are
    longer than it is, so it touches one or two of them; a point looks into
    one bin of every level in use.  The levels in use, 63 at most, are read
    in a job when the plan is built.  Each pair meets once; the bounds are
    verified in the join.  Short spans land in small bins, so a key with
    many of them is spread over its bins.
    """
    lo, hi = F.unix_micros(F.col(start)), F.unix_micros(F.col(end))
    sized = (spans.where(F.col(start) <= F.col(end))
             .withColumn("__level", F.least(F.length(F.bin(hi - lo)), F.lit(62)).cast("int")))
    levels = sorted(r["__level"] for r in sized.select("__level").distinct().collect())
    binned = sized.withColumn("__bin", F.explode(F.array_distinct(F.array(_bin(lo, F.col("__level")), _bin(hi, F.col("__level"))))))
    used = F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")
    probes = points.withColumn("__level", F.explode(used)).withColumn("__bin", _bin(F.unix_micros(F.col(at)), F.col("__level")))
    met = probes.join(binned, [*keys, "__level", "__bin"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("__level", "__bin")
