"""L1 at any depth: a sorted table cut into ranges, with a directory of their row counts.

``offset`` sorts or skips everything before the page.  A page directory is
written once per catalog: the rows range-partitioned and sorted, one folder
per range, and a table with one row per range (its number and row count).
A page then opens only the ranges that hold its rows, whatever its number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class PageBook:
    """``rows``: the sorted table, empty; ``path``: its folder, one subfolder per range; ``starts``: (range, rows before it, rows)."""

    rows: DataFrame
    path: str
    order: list[str]
    starts: list[tuple[int, int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.starts)


def write_pages(df: DataFrame, order: list[str], path: str, rows_per_range: int | None = None) -> PageBook:
    """Write ``df`` under ``path`` in ranges of ``order`` (a unique key; nulls first).

    ``rows_per_range`` sets the number of ranges from a count; otherwise
    Spark's shuffle settings do.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(max(1, -(-df.count() // rows_per_range)), *by) if rows_per_range else df.repartitionByRange(*by)
    (ranged.sortWithinPartitions(*by).withColumn("range", F.spark_partition_id())
     .write.partitionBy("range").parquet(f"{path.rstrip('/')}/rows"))
    return open_pages(df, order, path)


def open_pages(like: DataFrame, order: list[str], path: str) -> PageBook:
    """A book written before; ``like`` has its columns.  Brings one row per range to the driver."""
    spark = like.sparkSession
    rows = spark.read.schema(like.withColumn("range", F.lit(0)).schema).parquet(f"{path.rstrip('/')}/rows")
    starts, before = [], 0
    for r in sorted(rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["range"]):
        starts.append((r["range"], before, r["n"]))
        before += r["n"]
    return PageBook(like.limit(0), f"{path.rstrip('/')}/rows", order, starts)


def last_page(book: PageBook, size: int) -> int:
    return max(1, -(-book.total // size))


def read_page(book: PageBook, page: int, size: int) -> DataFrame:
    """The rows of a page in order; only the folders of the ranges that hold them are read."""
    first = (page - 1) * size
    wanted = [(k, before) for k, before, n in book.starts if before < first + size and before + n > first]
    by = [F.col(c).asc_nulls_first() for c in book.order]
    if not wanted:
        return book.rows
    some = book.rows.sparkSession.read.schema(book.rows.schema).parquet(*[f"{book.path}/range={k}" for k, _ in wanted])
    return some.orderBy(*by).offset(first - wanted[0][1]).limit(size)
