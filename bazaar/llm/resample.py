"""Importance resampling towards a target corpus (hashed n-gram features).

Per batch, n-gram occurrences are interned in an open-addressed NumPy table
(XXH64 keys, bytes verified), whose slots carry the feature's bucket and
count; a document's weight gathers the gains of its occurrences' slots.
Counting, summing and ranking are Spark's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import cut

#: Text bytes interned at once (a memory bound: longer batches and texts are taken piece by piece).
PIECE_BYTES = 2 << 20

# Fixed values of the XXH64 hash function.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                             9650029242287828579, 2870177450012600261))

#: Lower-cased word bytes (0-9, a-z, everything beyond ASCII), zero for all that parts words.
_WORD = np.zeros(256, np.uint8)
_WORD[48:58], _WORD[97:123], _WORD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_WORD[65:91] = _WORD[97:123]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lanes(buf: np.ndarray, kind: str) -> np.ndarray:
    """A view that reads an unaligned little-endian word at every byte offset (``buf`` has 8 spare bytes)."""
    return np.ndarray((len(buf) - 7,), dtype=kind, buffer=buf.data, strides=(1,))


def xxh64_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of every span of ``buf``; spans of 32 bytes and more go through the library."""
    eight, four = _lanes(buf, "<u8"), _lanes(buf, "<u4")
    with np.errstate(over="ignore"):
        h = P5 + length.astype(np.uint64)
        at = start.copy()
        for turn in range(3):
            i = np.flatnonzero((length >= 8 * (turn + 1)) & (length < 32))
            h[i] = _rotl(h[i] ^ (_rotl(eight[at[i]] * P2, 31) * P1), 27) * P1 + P4
            at[i] += 8
        i = np.flatnonzero((length & 4 != 0) & (length < 32))
        h[i] = _rotl(h[i] ^ (four[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
        at[i] += 4
        for turn in range(3):
            i = np.flatnonzero(((length & 3) > turn) & (length < 32))
            h[i] = _rotl(h[i] ^ (buf[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    raw = buf.data
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i]:start[i] + length[i]])
    return h


class Interned:
    """Spans of one piece interned in an open-addressed table.

    ``slot`` gives each occurrence its slot; ``used`` the slots in use, with
    their representative's ``bucket`` and the ``count`` of occurrences.
    """

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int):
        n = len(start)
        size = 1 << max(4, (2 * n - 1).bit_length())
        key = xxh64_spans(buf, start, length)
        eight = _lanes(buf, "<u8")
        keep = np.minimum(length, 8).astype(np.uint64)
        short = ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - keep))
        head = eight[start] & short
        tail = eight[np.maximum(start + length - 8, start)] & short
        rep = np.full(size, -1, np.int64)
        self.slot = (key & np.uint64(size - 1)).astype(np.int64)
        open_ = np.arange(n)
        while len(open_):
            s = self.slot[open_]
            free = rep[s] < 0
            rep[s[free]] = open_[free]
            r = rep[s]
            same = ((key[r] == key[open_]) & (length[r] == length[open_]) & (head[r] == head[open_]) & (tail[r] == tail[open_]))
            long = np.flatnonzero(same & (length[open_] > 16))
            if len(long):
                same[long] = _same_bytes(buf, start[open_[long]], start[r[long]], length[open_[long]])
            open_ = open_[~same]
            self.slot[open_] = (self.slot[open_] + 1) & (size - 1)
        self.used = np.flatnonzero(rep >= 0)
        first = rep[self.used]
        self.count = np.bincount(self.slot, minlength=size)[self.used]
        raw = buf.data
        crc = zlib.crc32
        self.bucket = np.fromiter((crc(raw[a:a + k]) for a, k in zip(start[first].tolist(), length[first].tolist())),
                                  np.int64, len(first)) % buckets
        self.size = size

    def gather(self, per_bucket: np.ndarray) -> np.ndarray:
        """A value per bucket, handed to every occurrence through its slot."""
        by_slot = np.zeros(self.size, np.int64)
        by_slot[self.used] = per_bucket[self.bucket]
        return by_slot[self.slot]


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` hold the same bytes."""
    ends = np.cumsum(length)
    inside = np.arange(ends[-1]) - np.repeat(ends - length, length)
    equal = buf[np.repeat(a, length) + inside] == buf[np.repeat(b, length) + inside]
    return np.logical_and.reduceat(equal, ends - length)


def _pieces(texts: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a binary column: (bytes, document offsets, first document's overlap) of about PIECE_BYTES each.

    A text longer than a piece is cut where no word is; the next piece then
    starts with its last ``overlap`` words, told by the third part.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1, row + 1)
        a, b = int(offsets[row]), int(offsets[stop])
        if stop > row + 1 or b - a <= PIECE_BYTES:
            yield row, _WORD[data[a:b]], offsets[row:stop + 1] - a, 0
        else:
            carried = np.zeros(0, np.uint8)
            held = 0
            while a < b:
                cut_at = min(a + PIECE_BYTES, b)
                while cut_at < b and _WORD[data[cut_at]]:
                    cut_at += 1
                piece = np.concatenate((carried, _WORD[data[a:cut_at]]))
                yield row, piece, np.array([0, len(piece)]), held
                if overlap:
                    starts = np.flatnonzero((piece != 0) & np.concatenate(([True], piece[:-1] == 0)))
                    held = min(overlap, len(starts))
                    carried = np.concatenate((piece[starts[-held]:], np.zeros(1, np.uint8))) if held else np.zeros(0, np.uint8)
                a = cut_at
        row = stop


def _features(texts: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, Interned]]:
    """Per piece: the row of every word, the row of every n-gram occurrence, and the occurrences interned.

    Words carried over from the piece before are not reported again, nor are
    n-grams that end in them.
    """
    for row, low, offsets, held in _pieces(texts, order - 1):
        inside = low != 0
        starts_text = np.zeros(len(low) + 1, bool)
        starts_text[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | starts_text[1:-1]
        at = np.flatnonzero(begins)
        if not len(at):
            continue
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | starts_text[1:-1]
        length = np.flatnonzero(ends) + 1 - at
        words = len(at)
        total = int(length.sum())
        buf = np.full(total + words + 8, 32, np.uint8)
        buf[np.arange(total) + np.repeat(np.arange(words), length)] = low[inside]
        at_text = np.searchsorted(offsets, at, "right") - 1
        start = np.cumsum(length + 1) - length - 1
        rank = np.arange(words)
        all_start, all_length, all_row = [], [], []
        for n in range(1, order + 1):
            last = rank[n - 1:]
            whole = (at_text[last] == at_text[last - n + 1]) & (last >= held) if n <= words else np.zeros(0, bool)
            last = last[whole]
            all_start.append(start[last - n + 1])
            all_length.append(start[last] + length[last] - start[last - n + 1])
            all_row.append(at_text[last] + row)
        spans = np.concatenate(all_start), np.concatenate(all_length)
        yield at_text[held:] + row, np.concatenate(all_row), Interned(buf, *spans, buckets)


def _no_nulls(col: pa.Array) -> pa.Array:
    return col.fill_null(b"") if col.null_count else col


def bucket_counts(df: DataFrame, text_col: str = "text", order: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII;
    features all runs of 1 to ``order`` words, joined by one space, repeats
    counted; the bucket is their crc32 modulo ``buckets``.  Each task sums its
    own rows, so at most ``buckets`` rows per task are shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, spans in _features(_no_nulls(batch.column(0)), order, buckets):
                total += np.bincount(spans.bucket, weights=spans.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = df.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): floor(1000 ln of the smoothed ratio target / source), for every bucket.

    ``source`` and ``target`` as from ``bucket_counts``.
    """
    sides = [d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for d in (source, target)]
    both = (source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
            .join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left"))
    t, s = (F.coalesce(c, F.lit(0)).cast("double") + 1.0 for c in ("t", "s"))
    ratio = (t * F.lit(float(sides[0] + buckets))) / (s * F.lit(float(sides[1] + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = 1) -> DataFrame:
    """(id_col, n_words, n_features, weight) per row: the sum of the gains of its features."""
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for word_row, row, spans in _features(_no_nulls(batch.column(1)), order, buckets):
                n_words += np.bincount(word_row, minlength=rows)
                n_features += np.bincount(row, minlength=rows)
                weight += np.bincount(row, weights=spans.gather(gains), minlength=rows).astype(np.int64)  # exact: far below 2^53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))],
                                             names=[id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
            .mapInArrow(weigh, f"`{id_col}` {kind}, n_words long, n_features long, weight long"))


def gumbel(id_col: Column, seed: int = 2024) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:id") (a null id counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, order: int = 1, buckets: int = 10_000, min_words: int = 20,
             seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank): importance resampling without replacement.

    Score = weight + Gumbel noise of the id; of the N documents of at least
    ``min_words`` words the floor(percent N / 100) highest scores are drawn
    and ranked 1, 2, 3 ...; ``rank`` is null for all others.  Ties go to the
    smaller id, then to the smaller weight and number of features; a null id
    comes last among its ties.  Null and empty texts have no features and
    weight 0.  Repeated rows are documents of their own.  Empty tables give
    an empty result (or gains against an empty target).  Texts of any
    length are read whole, in pieces.  Only the named columns are read.

    All rows are range-partitioned by (drawable, score, id); a row's rank is
    its place in its partition plus the rows of the partitions before it, one row each.
    """
    source = cut(bucket_counts(docs, text_col, order, buckets), "buckets")
    table = bucket_gains(source, bucket_counts(target, target_text, order, buckets), buckets).collect()  # ``buckets`` rows
    gains = np.zeros(buckets, np.int64)
    for r in table:
        gains[r["bucket"]] = r["gain"]
    scored = weights(docs, gains, id_col, text_col, order).select(
        id_col, "n_features", "weight", (F.col("weight") + gumbel(F.col(id_col), seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("__able"))
    by = [F.col("__able").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("weight"), F.col("n_features")]
    kept = cut(scored, "scored")
    placed = cut(kept.repartitionByRange(*by).sortWithinPartitions(*by)
                 .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "ranked")
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"),
                                         F.count_if("__able").alias("able")).collect()  # one row per partition
    drawn = percent * sum(r["able"] for r in parts) // 100
    before, offsets = 0, []
    for r in sorted(parts, key=lambda r: r["__part"]):
        offsets.append((r["__part"], before - r["first"] + 1))
        before += r["n"]
    shift = docs.sparkSession.createDataFrame(offsets, "__part int, __shift long")
    rank = F.col("__at") + F.col("__shift")
    return (placed.join(F.broadcast(shift), "__part")
            .select(id_col, "n_features", "weight", "score", F.when(F.col("__able") & (rank <= drawn), rank).alias("rank")))
