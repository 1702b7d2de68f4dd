"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import cut, map_runs
from bazaar.llm.components import connected_components

#: Rows of one side of a bucket that are compared in one piece (a memory bound, not a cap: larger buckets are compared block by block).
BLOCK_ROWS = 512
ROUNDS = 3


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two long)."""
    d, h = x.shape[-1], 1
    while h < d:
        y = x.reshape(*x.shape[:-1], d // (2 * h), 2, h)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(*x.shape[:-1], d)
        h *= 2
    return x


def _codes(unit: np.ndarray, tables: int, width: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + width) bucket codes: the base bucket, then one probe per hash function.

    A hash function turns the vector by three rounds of random signs and
    Hadamard transforms and takes the signed axis nearest to it.  The probes
    replace one function's axis by its second nearest.
    """
    n, dim = unit.shape
    d = max(2, 1 << (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    padded = np.zeros((n, d))
    padded[:, :dim] = unit
    out = np.zeros((n, tables, 1 + width), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for _ in range(width):
            y = padded
            for _ in range(ROUNDS):
                y = _hadamard(y * rng.choice((-1.0, 1.0), d)) / math.sqrt(d)
            size = np.abs(y)
            first = size.argmax(axis=1)
            size[rows, first] = -1.0
            other = size.argmax(axis=1)
            best.append(first * 2 + (y[rows, first] < 0))
            second.append(other * 2 + (y[rows, other] < 0))
        base = sum(b * (2 * d) ** i for i, b in enumerate(best))
        out[:, t, 0] = base
        for i in range(width):
            out[:, t, 1 + i] = base + (second[i] - best[i]) * (2 * d) ** i
    return out


@lru_cache(maxsize=64)
def plan(points: int, dim: int, threshold: float = 0.9, recall: float = 0.995, bucket: float = 1.0,
         seed: int = 17) -> tuple[int, int]:
    """(functions per table, tables) for a number of vectors.

    Functions: the fewest with ``points / bucket`` possible buckets, so
    chance hits per lookup stay constant as the input grows.  Tables: as
    many as bring the chance that a pair at exactly ``threshold`` meets in
    one of them to ``recall``, from the meeting rate of 4,000 random pairs.
    """
    d = max(2, 1 << (dim - 1).bit_length())
    width = max(2, math.ceil(math.log(max(points, 2) / bucket) / math.log(2 * d)))
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(4000, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold ** 2)) * np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
    ca, cb = _codes(a, 1, width, seed)[:, 0], _codes(b, 1, width, seed)[:, 0]
    rate = min(max(((ca == cb[:, :1]).any(axis=1) | (cb == ca[:, :1]).any(axis=1)).mean(), 1e-3), 0.9999)
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - rate)))


def _forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index under a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    hops = linked | np.eye(n, dtype=bool)
    while True:
        low = np.where(hops, label[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _met(base_a, all_a, base_b, all_b):
    """Whether a and b meet in a table, given their base and base + probe codes."""
    return (all_a == base_b[..., None]).any(axis=-1) | (all_b == base_a[..., None]).any(axis=-1)


def _compare(key: tuple, cols: dict, threshold: float) -> dict | None:
    """Verified links of one block pair of one bucket, as per-point sums and a spanning forest."""
    table, code, left, right = key
    blk = cols["blk"].to_numpy()
    pid, copies = cols["pid"].to_numpy(), cols["copies"].to_numpy()
    n = len(pid)
    order = np.argsort(pid, kind="stable")
    unit = _unit(cols["v"].flatten().to_numpy().reshape(n, -1)[order])
    codes = cols["codes"].flatten().to_numpy().reshape(n, -1, 1 + cols["width"][0].as_py())[order]
    blk, pid, copies = blk[order], pid[order], copies[order]
    linked = unit @ unit.T >= threshold
    base = codes[:, table, 0] == code
    linked &= base[:, None] | base[None, :]
    if left != right:
        linked &= blk[:, None] != blk[None, :]
    np.fill_diagonal(linked, False)
    i, j = np.nonzero(np.triu(linked))
    if not len(i):
        return None
    fresh = np.ones(len(i), dtype=bool)  # counted at the first table, and there in the lower of two buckets
    for a in range(0, len(i), 65536):
        s = slice(a, a + 65536)
        ca, cb = codes[i[s]], codes[j[s]]
        if table:
            fresh[s] &= ~_met(ca[:, :table, 0], ca[:, :table], cb[:, :table, 0], cb[:, :table]).any(axis=1)
        ba, bb = ca[:, table, 0], cb[:, table, 0]
        both = (ca[:, table] == bb[:, None]).any(axis=1) & (cb[:, table] == ba[:, None]).any(axis=1)
        fresh[s] &= ~(both & (np.minimum(ba, bb) != code))
    i, j = i[fresh], j[fresh]
    if not len(i):
        return None
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    kept = np.zeros((n, n), dtype=bool)
    kept[i, j] = kept[j, i] = True
    root = _forest(kept)
    some = links > 0
    return {"pid": pid[some], "links": links[some], "root": pid[root[some]]}


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     threshold: float = 0.9, recall: float = 0.995, seed: int = 17) -> DataFrame:
    """(id, n_links, component, kept): one row per row of ``vectors`` (other columns are not read).

    Pairs whose vectors meet in a bucket of any table (see ``plan``) are
    verified by cosine in double precision: ``n_links`` counts the other
    rows at ``threshold`` or more, ``component`` is the smallest id
    reachable over links, ``kept`` says whether that is the row's own id.

    Equal vectors are one point with a number of copies.  Vectors travel
    only to buckets that hold a possible pair; a bucket of more than
    ``BLOCK_ROWS`` rows is dealt out as pairs of blocks, so one group of
    near copies spreads over many tasks, and comes back as one row per
    point and block (a count and a spanning-forest edge), never as pairs.
    A pair that meets in several buckets is counted in the first.

    Null or zero vectors, vectors with null or non-finite components, and
    rows without an id link with nothing; vectors of different lengths
    never link.  Repeated rows count as separate vectors.  An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    if v.schema["v"].dataType.elementType.typeName() != "float":
        v = v.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("usable", usable)
    v = v.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), F.col("v"))})
    good = v.where("usable")
    points = cut(good.groupBy("k1", "k2").agg(F.min("id").alias("pid"), F.count("*").alias("copies"),
                                              F.any_value("v").alias("v")), "vectors")
    dims = points.groupBy(F.size("v").alias("dim")).count()
    found = None
    for dim, n in sorted((r["dim"], r["count"]) for r in dims.collect()):
        part = _linked_points(points.where(F.size("v") == dim), dim, n, threshold, recall, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"),
                        F.col("id").isNotNull().alias("kept"))
    found = cut(found, "links")
    links = found.groupBy("pid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("pid").alias("src"), F.col("root").alias("dst")).distinct())
    named = (points.select("k1", "k2", "pid", "copies").join(links, "pid", "left")
             .join(comp.withColumnRenamed("node", "pid"), "pid", "left")
             .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                     F.coalesce("component", "pid").alias("c")))
    linked = (good.select("id", "k1", "k2").join(named, ["k1", "k2"])
              .select("id", F.col("n").alias("n_links"), F.col("c").alias("component"), (F.col("id") == F.col("c")).alias("kept")))
    alone = v.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"),
                                         F.col("id").isNotNull().alias("kept"))
    return linked.unionByName(alone)


def _linked_points(points: DataFrame, dim: int, n: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """(pid, links, root) partial sums and forest edges of points of one length."""
    width, tables = plan(n, dim, threshold, recall, seed=seed)
    per = 1 + width
    kind = points.schema["v"].dataType.elementType.simpleString()
    code_kind = "int" if (2 * max(2, 1 << (dim - 1).bit_length())) ** width < 2 ** 31 else "bigint"
    code_type = np.int32 if code_kind == "int" else np.int64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                x = _unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim))
                codes = _codes(x, tables, width, seed).reshape(batch.num_rows, -1).astype(code_type)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["pid", "copies", "v", "codes"])

    rows = cut(points.select("pid", "copies", "v").mapInArrow(
        hashed, f"pid long, copies long, v array<{kind}>, codes array<{code_kind}>"), "hashed")
    slots = rows.select("pid", F.posexplode("codes").alias("pos", "code")).select(
        "pid", F.expr(f"int(pos div {per})").alias("tbl"), F.col("code").cast("long").alias("code"), (F.col("pos") % per == 0).alias("base"))
    sizes = (slots.groupBy("tbl", "code").agg(F.count("*").alias("n"), F.count_if("base").alias("bases"))
             .where("n > 1 and bases > 0").select("tbl", "code", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    spots = (slots.select("pid", "tbl", "code").join(sizes, ["tbl", "code"])
             .withColumn("blk", F.pmod(F.xxhash64("pid", "tbl"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("pid", "tbl", "code", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi")))
    full = spots.join(rows, "pid").withColumn("width", F.lit(width))
    full = full.select("tbl", "code", "lo", "hi", "blk", "pid", "copies", "v", "codes", "width")
    out = pa.schema([("pid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    return map_runs(full, ["tbl", "code", "lo", "hi"], lambda k, c: _compare(k, c, threshold),
                    "pid long, links long, root long", out)
