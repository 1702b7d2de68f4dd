"""Stupid-backoff language-model scores from corpus-wide n-gram counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bazaar.llm.common import cut, free_shuffles, map_runs

#: Text bytes per group of documents, and per hash slice of the count tables (memory bounds of a task).
GROUP_BYTES = 8_000_000
SLICE_BYTES = 16_000_000
#: Words of one group that are scored at a time, and hashes of words remembered (memory bounds as well).
BLOCK_WORDS = 100_000
REMEMBERED = 50_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after the other, number of words of each)."""
    known = _Hashes()
    parts, sizes = [], []
    for t in texts:
        w = t.lower().split() if t else []
        parts.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
        sizes.append(len(w))
        if len(known) > REMEMBERED:
            known.clear()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(words: np.ndarray, place: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: (positions of the last word, hashes) of the n-grams that lie inside one text."""
    out = [(np.arange(len(words)), _mix(words))]
    full = out[0][1]
    for n in range(2, order + 1):
        longer = np.zeros_like(full)
        longer[1:] = _mix(full[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(n))
        full = longer
        at = np.flatnonzero(place >= n - 1)
        out.append((at, full[at]))
    return out


def _distinct(words: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the distinct hashes of the n-grams, in order."""
    return [np.unique(h) for _, h in _grams(words, place, order)]


def _place(sizes: np.ndarray) -> np.ndarray:
    """Position of each word inside its text."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _count_group(key: tuple, cols: dict, order: int, slices: int) -> dict | None:
    """Distinct n-grams of one group of documents with their counts, cut by hash slice."""
    words, sizes = _tokens(cols["text"].to_pylist())
    if not len(words):
        return None
    ns, ss, hashes, counts = [], [], [], []
    edges = (np.arange(1, slices, dtype=np.uint64) * np.uint64(2 ** 64 // slices)) if slices > 1 else np.empty(0, np.uint64)
    for n, (_, h) in enumerate(_grams(words, _place(sizes), order), 1):
        u, c = np.unique(h, return_counts=True)
        cuts = [0, *np.searchsorted(u, edges).tolist(), len(u)]
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                ns.append(n)
                ss.append(s)
                hashes.append(u[a:b].view(np.int64))
                counts.append(c[a:b])
    return {"slice": ss, "n": ns, "grp": [key[0]] * len(ns), "hashes": _lists(hashes, pa.int64()), "counts": _lists(counts, pa.int64())}


def _count_slice(key: tuple, cols: dict) -> dict:
    """Corpus counts of the n-grams of one slice, handed back to every group in the group's own order.

    Also a row for group -1 with the sum of all counts of the slice.
    """
    lengths = cols["hashes"].value_lengths().to_numpy()
    h = cols["hashes"].flatten().to_numpy()
    c = cols["counts"].flatten().to_numpy()
    u, where = np.unique(h, return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, where, c)
    back = np.split(total[where], np.cumsum(lengths)[:-1])
    groups = [*cols["grp"].to_pylist(), -1]
    return {"grp": groups, "n": [key[1]] * len(groups), "slice": [key[0]] * len(groups),
            "totals": _lists([*back, np.array([int(c.sum())])], pa.int64())}


def _score_group(cols: dict, order: int, alpha: float, corpus: int) -> dict | None:
    """Scores of one group of documents, given the corpus counts of its n-grams; documents are scored in blocks of ``BLOCK_WORDS``."""
    kind = cols["slice"].to_numpy(zero_copy_only=False)
    is_doc = kind < 0
    docs = np.flatnonzero(is_doc)
    if not len(docs):
        return None
    take = pa.array(docs)
    words, sizes = _tokens(cols["text"].take(take).to_pylist())
    ns = cols["n"].to_numpy(zero_copy_only=False)
    table = []  # per n: the group's n-grams in order, and their corpus counts
    for n, h in enumerate(_distinct(words, _place(sizes), order), 1):
        rows = np.flatnonzero(~is_doc & (ns == n))
        rows = rows[np.argsort(kind[rows], kind="stable")]
        table.append((h, cols["totals"].take(pa.array(rows)).flatten().to_numpy()))
    ends = np.cumsum(sizes)
    scores = np.zeros(len(sizes))
    first = 0
    while first < len(sizes):
        start = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, start + BLOCK_WORDS, "right")))
        scores[first:last] = _score_block(words[start:ends[last - 1]], sizes[first:last], table, order, alpha, corpus)
        first = last
    return {"doc_id": cols["doc_id"].take(take), "n_tokens": sizes, "score": scores}


def _score_block(words: np.ndarray, sizes: np.ndarray, table: list, order: int, alpha: float, corpus: int) -> np.ndarray:
    """Scores of a few documents of a group."""
    total = len(words)
    if not total:
        return np.zeros(len(sizes))
    place, doc = _place(sizes), np.repeat(np.arange(len(sizes)), sizes)
    seen = []  # per n: others' count of the n-gram ending at each word (-1: reaches over the start)
    for (at, h), (known, counts) in zip(_grams(words, place, order), table):
        u, where = np.unique(h, return_inverse=True)
        # the document's own occurrences do not count for it
        order_ = np.lexsort((where, doc[at]))
        dw = np.stack([doc[at][order_], where[order_]])
        new = np.concatenate([[True], (dw[:, 1:] != dw[:, :-1]).any(axis=0)]) if len(order_) else np.empty(0, bool)
        run = np.cumsum(new) - 1
        own = np.empty(len(at), np.int64)
        own[order_] = np.bincount(run, minlength=1)[run] if len(order_) else 0
        full = np.full(total, -1, np.int64)
        full[at] = counts[np.searchsorted(known, u)][where] - own
        seen.append(full)
    log = np.zeros(total)
    left = (corpus - sizes)[doc]
    highest = np.minimum(order, place + 1)
    open_ = np.ones(total, bool)
    for n in range(order, 1, -1):
        hit = open_ & (seen[n - 1] > 0)
        i = np.flatnonzero(hit)
        log[i] = np.log(seen[n - 1][i]) - np.log(seen[n - 2][i - 1]) + (highest[i] - n) * math.log(alpha)
        open_ &= ~hit
    one = open_ & (seen[0] > 0)
    log[one] = np.log(seen[0][one]) - np.log(left[one]) + (highest[one] - 1) * math.log(alpha)
    none = open_ & ~one
    log[none] = highest[none] * math.log(alpha) - np.log(left[none] + 1)
    return np.bincount(doc, log, len(sizes))


def score(docs: DataFrame, order: int = 2, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score): stupid-backoff log score of every row of ``docs``.

    Words are runs of non-white-space, A-Z lowered (ASCII).  A word scores
    c(n-gram) / c(its first n-1 words) for the longest n-gram up to
    ``order`` that *other* rows hold too, times ``alpha`` per order backed
    off; a single word c(word) / N; a word no other row holds
    alpha^(orders) / (N + 1).  Counts cover all rows but the one scored, N
    its words.  ``score`` is the sum of natural logs over the words (0.0 for
    null, empty and blank texts).  Repeated rows are separate documents;
    null ids are carried through; an empty table gives an empty result.

    Documents are dealt to groups of about ``GROUP_BYTES`` by a hash of their
    id.  Every group sends its distinct n-grams with counts, once each, to
    the count tables, which are partitioned by hash: a table slice sums
    what all groups sent and answers each group, and the counts are joined
    to the group's n-grams and summed per document.  The commonest n-gram is one entry
    per group, so no n-gram makes a slice large.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    total = size.b or 0
    groups = max(1, -(-total // GROUP_BYTES))
    slices = 1 << max(0, (-(-total // SLICE_BYTES) - 1).bit_length())
    d = d.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).cast("long").alias("grp"), "doc_id", "text")

    long_list = pa.list_(pa.int64())
    sent = pa.schema([("slice", pa.int64()), ("n", pa.int64()), ("grp", pa.int64()), ("hashes", long_list), ("counts", long_list)])
    told = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("slice", pa.int64()), ("totals", long_list)])
    up = map_runs(d.select("grp", "text"), ["grp"], lambda k, c: _count_group(k, c, order, slices),
                  "slice long, n long, grp long, hashes array<bigint>, counts array<bigint>", sent)
    back = cut(map_runs(up, ["slice", "n"], _count_slice, "grp long, n long, slice long, totals array<bigint>", told), "counts")
    corpus = back.where("grp = -1 and n = 1").select(F.sum(F.col("totals")[0]).alias("s")).first().s or 0
    del up
    free_shuffles(docs.sparkSession)
    both = (d.select("grp", "doc_id", "text", F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("slice"),
                     F.lit(None).cast("array<bigint>").alias("totals"))
            .unionByName(back.where("grp >= 0").select("grp", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("binary").alias("text"),
                                                        "n", "slice", "totals")))
    out = pa.schema([("doc_id", to_arrow_type(docs.schema[id_col].dataType)), ("n_tokens", pa.int64()), ("score", pa.float64())])
    return map_runs(both, ["grp"], lambda k, c: _score_group(c, order, alpha, corpus), f"doc_id {id_type}, n_tokens long, score double", out)
