"""Quality classifier by co-training a text view and a page-metadata view."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import crc_bucket, cut, drop_scratch, scratch_mark, scratch_since
from bazaar.llm.linear import fit_logistic, fit_platt, sigmoid

# Byte classes of the text view: letters, capitals, digits, blanks, line ends, each ASCII punctuation mark, bytes beyond ASCII.
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = ([range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13)] + [(ord(c),) for c in _PUNCT] + [range(128, 256)])
_CLASS_OF = np.full(256, len(_CLASSES))
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i
N_TEXT = len(_CLASSES) + 9
N_META_HASH = 64
N_META = N_META_HASH + 7


def text_features(text: str | None) -> list[float]:
    """Content statistics of a whole text: byte-class shares, repetition, word shapes."""
    if not text:
        return [0.0] * (N_TEXT - 2) + [1.0, 1.0]
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(_CLASS_OF, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256),
                         minlength=len(_CLASSES) + 1)[:len(_CLASSES)] / len(raw)
    words = text.split()
    n = len(words)
    if not n:
        return [*np.sqrt(shares), *[0.0] * 7, 1.0, 1.0]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words)
    capital = sum(w.isupper() for w in words)
    chars = sum(map(len, words))
    # shares of distinct words fall with length by themselves: compare with what n words usually have
    return [*np.sqrt(shares), distinct / n ** 0.9, (pairs + 1) / n, same / n, odd / n, capital / n, min(chars / n, 40.0) / 10.0,
            math.log1p(n) / 10.0, 0.0, 1.0]


def meta_features(lang: str | None, source: str | None, n_chars: int | None, n_lines: int | None, longest: int | None) -> list[float]:
    """What a page's record says without reading its words: language, source, length and line layout."""
    out = [0.0] * N_META
    for kind, v in (("lang", lang), ("source", source)):
        if v is not None:
            out[zlib.crc32(f"{kind}={v}".encode()) % N_META_HASH] = 1.0
    n, lines, top = float(n_chars or 0), float(n_lines or 0), float(longest or 0)
    out[N_META_HASH:] = [math.log1p(n) / 10.0, math.log1p(lines) / 5.0, math.log1p(n / max(lines, 1.0)) / 10.0,
                         math.log1p(top) / 10.0, top / max(n, 1.0), float(not n), 1.0]
    return out


@dataclass
class Model:
    """Two calibrated views and the weights that combine their log-odds."""

    text_beta: np.ndarray
    meta_beta: np.ndarray
    text_scale: tuple[np.ndarray, np.ndarray]
    meta_scale: tuple[np.ndarray, np.ndarray]
    text_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    mix: np.ndarray

    def views(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        zt = ((xt - self.text_scale[0]) / self.text_scale[1]) @ self.text_beta * self.text_cal[0] + self.text_cal[1]
        zm = ((xm - self.meta_scale[0]) / self.meta_scale[1]) @ self.meta_beta * self.meta_cal[0] + self.meta_cal[1]
        return np.column_stack([np.clip(zt, -12, 12), np.clip(zm, -12, 12), np.ones(len(xt))])

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        return sigmoid(self.views(xt, xm) @ self.mix)


class ArrayPool:
    """Unlabelled rows in memory: what ``co_train`` asks of a pool."""

    def __init__(self, xt: np.ndarray, xm: np.ndarray):
        self.views, self.size = (xt, xm), len(xt)

    def moments(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(x.sum(axis=0), (x * x).sum(axis=0)) for x in self.views]

    def surest(self, asks: list[Ask]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Per ask the ids and both feature rows of the surest rows."""
        out = []
        for ask in asks:
            best = ask.best(np.arange(self.size), self.views[ask.view])[0]
            out.append((best.tolist(), self.views[0][best], self.views[1][best]))
        return out


class FramePool:
    """Unlabelled rows as a written table (id, t, m): every row is scored in every round, only the surest come to the driver."""

    def __init__(self, rows: DataFrame):
        self.rows, self.size = rows, rows.count()

    def moments(self) -> list[tuple[np.ndarray, np.ndarray]]:
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [[np.zeros(n), np.zeros(n)] for n in (N_TEXT, N_META)]
            for batch in batches:
                for x, s in zip(_arrays(batch), sums):
                    s[0] += x.sum(axis=0)
                    s[1] += (x * x).sum(axis=0)
            flat = np.concatenate([v for s in sums for v in s])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

        got = self.rows.select("t", "m").mapInArrow(add_up, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(2 * (N_TEXT + N_META))      # one row per feature
        for r in got:
            flat[r["at"]] = r["v"]
        parts = np.split(flat, np.cumsum([N_TEXT, N_TEXT, N_META]))
        return [(parts[0], parts[1]), (parts[2], parts[3])]

    def surest(self, asks: list[Ask]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, views = batch.column("id").to_numpy(), _arrays(batch)
                for i, ask in enumerate(asks):
                    best, q = ask.best(ids, views[ask.view])
                    if len(best):
                        take = pa.array(best)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i] * len(best), pa.int32()), pa.array(q), *(batch.column(c).take(take) for c in ("id", "t", "m"))],
                            names=["ask", "q", "id", "t", "m"])

        found = self.rows.select("id", "t", "m").mapInArrow(look, "ask int, q double, id long, t array<float>, m array<float>")
        place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("q"), "id"))
        most = F.element_at(F.array(*[F.lit(a.most) for a in asks]), F.col("ask") + 1)
        rows = found.withColumn("place", place).where(F.col("place") <= most).orderBy("ask", "place").collect()
        out = []
        for i in range(len(asks)):
            mine = [r for r in rows if r["ask"] == i]
            out.append(([r["id"] for r in mine], np.array([r["t"] for r in mine], dtype=float).reshape(len(mine), N_TEXT),
                        np.array([r["m"] for r in mine], dtype=float).reshape(len(mine), N_META)))
        return out


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy().astype(float).reshape(batch.num_rows, n) for c, n in (("t", N_TEXT), ("m", N_META))]


@dataclass
class Ask:
    """The rows that a fitted view is surest to have a label: ``most`` of them, none of ``taken``."""

    view: int
    label: float
    most: int
    sure: float
    scale: tuple[np.ndarray, np.ndarray]
    beta: np.ndarray
    cal: tuple[float, float]
    taken: np.ndarray

    def best(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and certainties, the surest first (ties: smaller id)."""
        p = sigmoid((x - self.scale[0]) / self.scale[1] @ self.beta * self.cal[0] + self.cal[1])
        q = p if self.label else 1 - p
        able = np.flatnonzero((q >= self.sure) & ~np.isin(ids, self.taken))
        best = able[np.lexsort((ids[able], -q[able]))][:self.most]
        return best, q[best]


def _scale(x: np.ndarray, pool: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature over the training rows and the whole pool."""
    n = len(x) + size
    mean = (x.sum(axis=0) + pool[0]) / n
    sd = np.sqrt(np.maximum(((x * x).sum(axis=0) + pool[1]) / n - mean * mean, 0.0))
    constant = sd < 1e-6 * np.maximum(1.0, np.abs(mean))
    return np.where(constant, 0.0, mean), np.where(constant, 1.0, sd)


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, pool: ArrayPool | FramePool, rounds: int = 5,
             share: float = 0.1, sure: float = 0.95, seed: int = 3, pseudo_rows: int = 2_000) -> Model:
    """Co-train on labelled rows (y 0/1) and an unlabelled pool.

    A quarter of the labelled rows is kept aside to calibrate and combine
    the views.  Each round both views are fitted; each names the rows of the whole pool
    that it is surest of (probability at least ``sure`` either way after
    calibration, at most ``share`` of the pool and ``pseudo_rows``, in the label proportions),
    and these join the *other* view's training set as pseudo-labels.
    """
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.25
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.ones(len(y), dtype=bool)
        train = np.ones(len(y), dtype=bool)
    else:
        train = ~aside
    scales = [_scale(x[train], m, pool.size) for x, m in zip((xt, xm), pool.moments())]
    full = [(x - s[0]) / s[1] for x, s in zip((xt, xm), scales)]
    more: list[list[np.ndarray]] = [[], []]        # rows and labels that each view got from the other
    told: list[list[float]] = [[], []]
    taken: list[list[int]] = [[], []]
    rate = y[train].mean()

    def fit(view: int):
        x = np.vstack([full[view][train], *more[view]])
        t = np.concatenate([y[train], told[view]])
        w = np.concatenate([np.ones(int(train.sum())), np.full(len(told[view]), 0.5)])
        beta = fit_logistic(x, t, w, ridge=0.1)
        return beta, fit_platt(full[view][aside] @ beta, y[aside])

    fitted = [fit(0), fit(1)]
    for _ in range(rounds if pool.size else 0):
        most = min(share * pool.size, pseudo_rows)
        asks = [Ask(view, label, max(1, int(most * part)), sure, scales[view], *fitted[view], np.array(taken[1 - view], dtype=np.int64))
                for view in (0, 1) for label, part in ((1.0, rate), (0.0, 1 - rate))]
        for ask, (ids, t, m) in zip(asks, pool.surest(asks)):
            other = 1 - ask.view
            new = [i for i, k in enumerate(ids) if k not in set(taken[other])]
            taken[other] += [ids[i] for i in new]
            told[other] += [ask.label] * len(new)
            more[other].append(((t, m)[other][new] - scales[other][0]) / scales[other][1])
        fitted = [fit(0), fit(1)]
    model = Model(fitted[0][0], fitted[1][0], scales[0], scales[1], fitted[0][1], fitted[1][1], np.array([1.0, 0.0, 0.0]))
    z = model.views(xt[aside], xm[aside])
    use = [0, 1, 2]
    while True:  # a calibrated view may count for nothing, but not against itself
        beta = fit_logistic(z[:, use], y[aside], ridge=0.05)
        model.mix = np.zeros(3)
        model.mix[use] = beta
        bad = [c for c in use[:-1] if model.mix[c] < 0]
        if not bad:
            return model
        use.remove(bad[0])


_PARTS = ["text", "lang", "source", "n_chars", "n_lines", "longest"]


def _inputs(docs: DataFrame) -> DataFrame:
    """The columns both views read, typed; missing metadata columns count as null."""
    have = set(docs.columns)
    col = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    lines = F.split(F.col("text"), "\n")
    return docs.select("*", F.struct(
        F.col("text").cast("string").alias("text"), col("lang", "string").alias("lang"), col("source", "string").alias("source"),
        col("n_chars", "long").alias("n_chars"), F.size(lines).cast("long").alias("n_lines"),
        F.array_max(F.transform(lines, lambda x: F.char_length(x))).cast("long").alias("longest")).alias("__bazaar_in"))


def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    none = lambda v: None if v is None or v != v else v
    xt = np.array([text_features(none(t)) for t in pdf.text], dtype=float).reshape(len(pdf), N_TEXT)
    xm = np.array([meta_features(*[none(v) for v in r]) for r in zip(*(pdf[c].tolist() for c in _PARTS[1:]))], dtype=float)
    return xt, xm.reshape(len(pdf), N_META)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, sample_rows: int = 8_000,
          rounds: int = 5, pseudo_rows: int = 2_000) -> Model | None:
    """Model from at most ``sample_rows`` labelled documents (smallest key hashes) and all unlabelled ones.

    Labelled rows with crc32(doc_id as text) mod ``folds`` = 0 are never
    read.  The features of the unlabelled rows are written once; every round scores all of them on
    Spark, and at most ``pseudo_rows`` a view become pseudo-labels.  Of rows that repeat a labelled id any one is learnt
    from; conflicting labels of an id count as the smallest.  None without
    labelled rows of both kinds.
    """
    seen = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    train = (seen.where(crc_bucket(F.col("doc_id"), folds) != 0).groupBy("doc_id")
             .agg(F.min(label_col).cast("double").alias("__y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    docs = docs.select(*[c for c in ("doc_id", *_PARTS[:4]) if c in docs.columns])
    ins = _inputs(docs)

    def views(kind: str):
        @F.pandas_udf(f"struct<t:array<{kind}>,m:array<{kind}>>")
        def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                xt, xm = _matrices(pdf)
                yield pd.DataFrame({"t": list(xt), "m": list(xm)})

        return made("__bazaar_in").alias("x")

    # broadcast: at most sample_rows rows of two numbers
    known = (ins.join(F.broadcast(train), "doc_id").select("doc_id", "__y", views("double"))
             .dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    y = np.array([float(r["__y"] > 0.5) for r in known])
    if len(set(y.tolist())) < 2:
        return None
    spark = docs.sparkSession
    mark = scratch_mark(spark)
    # features first, so that the join with the labels moves no texts
    narrow = ins.select("doc_id", views("float")).join(seen.select("doc_id").distinct(), "doc_id", "left_anti")
    pool = FramePool(cut(narrow.select(F.monotonically_increasing_id().alias("id"), "x.t", "x.m"), "pool"))
    arr = lambda k, n: np.array([r["x"][k] for r in known], dtype=float).reshape(len(known), n)
    model = co_train(arr("t", N_TEXT), arr("m", N_META), y, pool, rounds, pseudo_rows=pseudo_rows)
    drop_scratch(spark, scratch_since(spark, mark))
    return model


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` (all columns) with the probability of good quality; 1.0 for every row without a model."""
    if model is None:
        return docs.withColumn(name, F.lit(1.0))

    @F.pandas_udf("double")
    def good(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in parts:
            yield pd.Series(model.score(*_matrices(pdf)), dtype=float)

    return _inputs(docs).withColumn(name, good("__bazaar_in")).drop("__bazaar_in")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """(doc_id, held_out, score, keep) per row of ``docs``.

    Null texts count as empty, null or missing metadata as unknown; null ids
    are scored and never learnt from; without labels of both kinds every row
    is kept with score 1.  Repeated rows give repeated results.
    """
    out = score(docs.select(*[c for c in ("doc_id", *_PARTS[:4]) if c in docs.columns]), learn(docs, labels, **how))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), how.get("folds", 5)) == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier does not reject."""
    scored = score(docs, learn(docs, labels, **how), "__bazaar_score")
    return scored.where(F.col("__bazaar_score") >= threshold).drop("__bazaar_score")
