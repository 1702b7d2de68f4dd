"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.session import ensure_checkpoint_dir

#: Results that a task of ``map_runs`` holds before it hands them on.
EMIT_BYTES = 8_000_000

_SCRATCH: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read through Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage with files that every executor can read, so a lost
    executor costs a re-read and not a re-run.  ``release`` deletes them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders written by ``cut``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    known = _SCRATCH.get(spark.sparkContext.applicationId, [])
    for path in paths:
        p = hadoop(path)
        p.getFileSystem(conf).delete(p, True)
        if path in known:
            known.remove(path)


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch folders there are now (see ``scratch_since``)."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def scratch_since(spark: SparkSession, mark: int) -> list[str]:
    return list(_SCRATCH.get(spark.sparkContext.applicationId, [])[mark:])


def release(spark: SparkSession) -> None:
    """Delete every scratch folder of this session (after results are written)."""
    drop_scratch(spark, scratch_since(spark, 0))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs whose frames are gone.

    Its cleaner works on garbage-collected references, which on an idle
    driver may take long; called between phases that each move the corpus.
    Two rounds: the first frees the gateway's references (which it lets go
    of in the background), the second what they held.  Not needed in local
    mode, where one machine holds everything anyway.
    """
    if spark.sparkContext.master.startswith("local["):
        return
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n`` (a null key counts as empty)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[tuple, dict], dict | None], schema: str,
             out_types: pa.Schema, partitions: int | None = None) -> DataFrame:
    """Apply ``fn(key, columns)`` to every group of ``keys``, streaming over sorted partitions.

    Like ``applyInArrow``, without a Python call chain per group: rows are
    dealt out by the keys, sorted inside each partition, and runs of equal
    keys are cut out of the Arrow batches with numpy.  Only one group and
    one batch are held in memory.  Keys must be non-null integers.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).sortWithinPartitions(*keys)
    names = df.columns

    def to_cols(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(i) for i, c in enumerate(names)}

    def emit(parts: list[list[pa.Array]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(list(column)) for column in zip(*parts)], schema=out_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        held_key: tuple | None = None
        out: list[list[pa.Array]] = []
        size = 0

        def close() -> None:
            nonlocal size
            if held:
                cols = {c: (held[0][c] if len(held) == 1 else pa.concat_arrays([h[c] for h in held])) for c in names}
                held.clear()
                res = fn(held_key, cols)
                if res is not None:
                    out.append([pa.array(res[f.name], f.type) for f in out_types])
                    size += sum(a.nbytes for a in out[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys])
            starts = np.concatenate([[0], np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(axis=0)) + 1, [ks.shape[1]]])
            cols = to_cols(batch)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                key = tuple(int(x) for x in ks[:, a])
                if key != held_key:
                    close()
                    held, held_key = [], key
                    if len(out) >= 256 or size >= EMIT_BYTES:
                        yield emit(out)
                        out, size = [], 0
                held.append({c: cols[c].slice(a, b - a) for c in names})
        close()
        if out:
            yield emit(out)

    return dealt.mapInArrow(run, schema)
