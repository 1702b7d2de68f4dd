"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Most characters of test items that one pass over the documents holds in a worker; a larger benchmark takes more passes.
PASS_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space, trimmed."""
    return " ".join(text.lower().split()) if text else ""


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces of nearly equal length (offset, text)."""
    n, k = len(pattern), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    """Per character, the bit set of its positions in the pattern."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """(least edit distance of the whole pattern to any substring of ``text``, its end); distance > limit: (limit + 1, -1).

    Myers' bit-parallel recurrence with the pattern's column in one integer.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = limit + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


@dataclass
class Matcher:
    """Test items ready for matching; the automaton is built once per worker."""

    items: list[tuple[object, str]]
    error_rate: float = 0.06
    _state: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"items": self.items, "error_rate": self.error_rate, "_state": None}

    def _built(self):
        if self._state is None:
            where: dict[str, list[tuple[int, int]]] = {}
            budgets = []
            for i, (_, pattern) in enumerate(self.items):
                budget = int(len(pattern) * self.error_rate)
                budgets.append(budget)
                for offset, piece in pieces(pattern, budget):
                    where.setdefault(piece, []).append((i, offset))
            auto = ahocorasick.Automaton()
            for piece, uses in where.items():
                auto.add_word(piece, (len(piece), uses))
            auto.make_automaton()
            self._state = (auto, budgets, {})
        return self._state

    def find(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, distance, end in the normalised text) of every item within its budget; best hit of each item."""
        auto, budgets, masks = self._built()
        if not self.items or not text:
            return []
        low = normalise(text)
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, tuple[int, int]] = {}  # item -> the stretch of text verified last
        for end, (k, uses) in auto.iter(low):
            for i, offset in uses:
                if i in best and best[i][0] == 0:
                    continue
                pattern, budget = self.items[i][1], budgets[i]
                m = len(pattern)
                start = end + 1 - k - offset
                a, b = max(0, start - budget), min(len(low), start + m + budget)
                if i in seen and seen[i][0] <= a and b <= seen[i][1]:
                    continue
                # wide enough to hold the windows of the other pieces of the same copy
                a, b = max(0, a - budget), min(len(low), b + budget)
                seen[i] = (a, b)
                exact = low.find(pattern, a, b)
                if exact >= 0:
                    best[i] = (0, exact + m)
                    continue
                if not budget:
                    continue
                if i not in masks:
                    masks[i] = masks_of(pattern)
                distance, stop = myers(masks[i], m, low[a:b], budget)
                if distance <= budget and (i not in best or distance < best[i][0]):
                    best[i] = (distance, a + stop)
        return [(self.items[i][0], d, e) for i, (d, e) in best.items()]


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Normalised items in blocks of at most PASS_CHARS characters (one larger item is a block of its own)."""
    block: list[tuple[object, str]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        t = normalise(r.t)
        if not t:
            continue
        if block and size + len(t) > PASS_CHARS:
            yield block
            block, size = [], 0
        block.append((r.i, t))
        size += len(t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, doc_id: str = "doc_id", doc_text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end): test items found in documents within ``error_rate`` edits per character.

    Each item is split into budget + 1 pieces, one of which must occur
    unchanged in any text within the budget; piece hits come from one
    Aho-Corasick scan of the whole normalised document, and the window
    around a hit is verified with Myers' bit-parallel distance.  One row per
    document row and item (its best hit; ``end`` in the normalised text).
    Documents are never shuffled.  Items travel in passes of bounded size.
    Null and empty texts and items match nothing; an item id that occurs
    with several texts is matched by each (least distance kept); null ids
    are carried through.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType),
                           T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())])
    found = None
    for block in _passes(benchmark, item_id, item_text):
        part = _one_pass(docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")), Matcher(block, error_rate), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _one_pass(docs: DataFrame, matcher: Matcher, schema: T.StructType) -> DataFrame:
    types = [f.type for f in to_arrow_schema(schema)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best: dict = {}
                for i, dist, end in matcher.find(t):
                    if i not in best or dist < best[i][0]:
                        best[i] = (dist, end)
                rows += [(d, i, dist, end) for i, (dist, end) in best.items()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "distance", "end"])

    return docs.mapInArrow(scan, schema)


def contaminated(text: Column, matcher: Matcher) -> Column:
    """Whether a text holds any item of the matcher."""
    @F.pandas_udf("boolean")
    def hit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([bool(matcher.find(t)) for t in s], dtype=bool)

    return hit(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no test item within the budget; see ``matches``."""
    for block in _passes(benchmark, item_id, item_text):
        docs = docs.where(~contaminated(F.col(text_col), Matcher(block, error_rate)))
    return docs
