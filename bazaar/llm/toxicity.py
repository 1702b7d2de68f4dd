"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import crc_bucket
from bazaar.llm.linear import fit_logistic, sigmoid

# Word lists of the closed classes (English, German, French, Spanish).  Insults are learnt, see ``learn``.
THREAT = frozenset("kill hurt destroy beat smash burn punish strangle stab shoot crush töten verletzen schlagen vernichten "
                   "tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGET = frozenset("you your yourself he she him her they them their people du dich dein ihr euch sie er tu toi vous votre il "
                   "elle ils elles leur tú ti usted ustedes ellos ellas".split())
NEGATION = frozenset("not no never nobody nothing cannot without nicht kein keine keinen nie niemals ne pas jamais sans nunca "
                     "jamás sin".split())
REPORTED = frozenset("said says claimed claims wrote called quoted reported alleged sagte schrieb behauptet zitiert dit écrit "
                     "affirme cité dijo escribió afirma citó".split())
WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
CLAUSE_END = re.compile(r"[.!?;:\n]+")

Machine = dict[tuple[object, str], tuple[object, str]]


def compose(first: Machine, second: Machine, start: tuple = (0, 0)) -> Machine:
    """The machine that feeds each output symbol of ``first`` to ``second`` (both sequential)."""
    out: Machine = {}
    todo, seen = [start], {start}
    letters = {x for _, x in first}
    while todo:
        a, b = todo.pop()
        for x in letters:
            a2, y = first[a, x]
            b2, z = second[b, y]
            out[(a, b), x] = ((a2, b2), z)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


def _negation(scope: int = 3) -> Machine:
    """o other, I insult, H threat, T target, N negation, R reporting verb, Q quote; negated I, H become i, h."""
    m: Machine = {}
    for left in range(scope + 1):
        for x in "oIHTNRQ":
            after = scope if x == "N" else max(0, left - 1)
            y = {"I": "i", "H": "h"}.get(x, x) if left else x
            m[left, x] = (after, "o" if x == "N" else y)
    return m


def _reported() -> Machine:
    """After a reporting verb, and between quotes, a match counts one grade less."""
    lower = {"I": "i", "i": "j", "H": "h", "h": "j"}
    m: Machine = {}
    for state in range(4):  # bit 0: reporting verb seen, bit 1: inside quotes
        for x in "oIiHhTRQ":
            after = state | 1 if x == "R" else state ^ 2 if x == "Q" else state
            m[state, x] = (after, "o" if x in "RQ" else lower.get(x, x) if state else x)
    return m


def _target() -> Machine:
    """A target before a match gives an aimed match (A, K); one after it gives a bonus (B)."""
    m: Machine = {}
    for state in range(3):  # 1: target seen, 2: match seen without target
        for x in "oIiHhjT":
            if x == "T":
                m[state, x] = (1, "B" if state == 2 else "o")
            elif x in "IH":
                m[state, x] = (1, "A" if x == "I" else "K") if state == 1 else (2, x)
            else:
                m[state, x] = (state, x)
    return m


#: Weight of each symbol of the composed grammar.
WEIGHTS = {"o": 0.0, "I": 1.0, "A": 1.5, "B": 0.5, "i": 0.4, "j": 0.15, "H": 0.4, "K": 1.5, "h": 0.1}
GRAMMAR = compose(compose(_negation(), _reported()), _target(), ((0, 0), 0))
START = ((0, 0), 0)


@dataclass
class Model:
    """Learnt insult stems (stem -> weight 0..1) and the weights of the document features."""

    stems: dict[str, float] = field(default_factory=dict)
    beta: tuple[float, ...] = (1.0, 1.5, 1.0, 0.5, 0.5, -4.0)
    _found: object = None

    def __getstate__(self):
        return {"stems": self.stems, "beta": self.beta, "_found": None}

    def finder(self):
        if self._found is None:
            a = ahocorasick.Automaton()
            for s in self.stems:
                a.add_word(s, len(s))
            for s in THREAT:
                if not a.exists(s):
                    a.add_word(s, len(s))
            a.make_automaton()
            self._found = a
        return self._found

    def weight(self, word: str) -> float:
        """Weight of the longest learnt stem that the word starts with."""
        for k in range(len(word), 1, -1):
            w = self.stems.get(word[:k])
            if w is not None:
                return w
        return 0.0


def clause_score(clause: str, model: Model) -> tuple[float, set[str]]:
    """Weight that the composed grammar gives to one lower-cased clause, and the matched words."""
    state, total, hits, last = START, 0.0, set(), 0.0
    for word in WORD.findall(clause):
        w = model.weight(word)
        if w:
            x = "I"
        elif word in THREAT:
            x, w = "H", 1.0
        else:
            x = ("T" if word in TARGET else "N" if word in NEGATION else "R" if word in REPORTED
                 else "Q" if not word.isalpha() else "o")
        state, y = GRAMMAR[state, x]
        if x in "IH":
            hits.add(word)
            last = w
        total += WEIGHTS[y] * (w if x in "IH" else last)
    return total, hits


def features(text: str | None, model: Model) -> tuple[float, ...]:
    """Document features from its matched clauses: total, per 100 words, share of clauses, highest, kinds, 1."""
    if not text:
        return (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    low = text.lower()
    bounds: list[tuple[int, int]] = []
    for end, k in model.finder().iter(low):
        a = end - k + 1
        if a and low[a - 1].isalpha() or bounds and a < bounds[-1][1]:
            continue
        bounds.append(_clause(low, a, end + 1, bounds[-1][1] if bounds else 0))
    words = low.count(" ") + low.count("\n") + 1
    total, top, matched, kinds = 0.0, 0.0, 0, set()
    for a, b in bounds:
        s, hits = clause_score(low[a:b], model)
        if s:
            total += s
            top = max(top, s)
            matched += 1
            kinds |= hits
    clauses = max(matched, words / 12.0)
    return (math.log1p(total), min(100.0 * total / (words + 10.0), 20.0), matched / clauses, min(top, 5.0),
            math.log1p(len(kinds)), 1.0)


#: Longest stretch that counts as one clause on either side of a match (punctuation-free text), in characters.
CLAUSE_REACH = 400


def _clause(low: str, a: int, b: int, floor: int) -> tuple[int, int]:
    left = max(floor, a - CLAUSE_REACH)
    start = left
    for m in CLAUSE_END.finditer(low, left, a):
        start = m.end()
    m = CLAUSE_END.search(low, b, min(len(low), b + CLAUSE_REACH))
    return start, m.start() if m else min(len(low), b + CLAUSE_REACH)


def score(text: Column, model: Model) -> Column:
    """Probability (0 to 1) that a text is toxic; null counts as empty."""
    @F.pandas_udf("double")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        beta = np.asarray(model.beta)
        for s in parts:
            x = np.array([features(t, model) for t in s], dtype=float).reshape(len(s), len(beta))
            yield pd.Series(sigmoid(x @ beta))

    return toxic(text)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = 20_000, max_stems: int = 400,
          prefix: tuple[int, int] = (3, 10)) -> Model:
    """Insult stems and feature weights from labelled documents.

    At most ``sample_rows`` labelled ids are used (those of the smallest
    key hashes); half of them give the stems, half the feature weights.  A
    stem is a word or word beginning that is over-represented in toxic rows
    (log-likelihood ratio), counted once per distinct context (the word
    before and after), so copies of a text add nothing.  Rows without a
    label, id or text are left out; without rows of both labels the default
    weights stand, with no stems.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    ids = known.groupBy("doc_id").agg((F.max(label_col).cast("double") > 0.5).alias("y")).withColumn("h", F.xxhash64("doc_id"))
    ids = ids.orderBy("h", "doc_id").limit(sample_rows)
    # the ids, at most sample_rows rows of three numbers, are broadcast; the texts stay where they are read
    use = (docs.select("doc_id", F.col("text").alias("t")).where("t is not null").join(F.broadcast(ids), "doc_id")
           .select("doc_id", "t", "y", "h"))
    model = Model(_stems(use.where("h & 1 = 0"), max_stems, prefix))
    got = (use.where("h & 1 = 1").select("doc_id", "y", _features_col("t", model).alias("f"))
           .dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    x = np.array([r.f for r in got], dtype=float).reshape(len(got), len(model.beta))
    y = np.array([float(r.y) for r in got])
    if len(set(y.tolist())) == 2:
        model.beta = tuple(fit_logistic(x, y, ridge=0.02).tolist())
    return model


def _features_col(col: str, model: Model) -> Column:
    @F.pandas_udf("array<double>")
    def feats(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([list(features(t, model)) for t in s])

    return feats(col)


def _stems(use: DataFrame, max_stems: int, prefix: tuple[int, int]) -> dict[str, float]:
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, y in zip(pdf.t, pdf.y):
                w = re.findall(r"[^\W\d_]+", t.lower())
                if w:
                    yield pd.DataFrame({"w": w, "a": [""] + w[:-1], "b": w[1:] + [""], "y": y})

    each = use.select("t", "y").mapInPandas(contexts, "w string, a string, b string, y boolean")
    each = (each.select("w", "y", F.xxhash64("a", "w", "b").alias("c")).groupBy("c", "w").agg(F.max("y").alias("y"))
            .groupBy("w").agg(F.count("*").alias("n"), F.count_if("y").alias("p")))
    short, long = prefix
    cuts = F.concat(F.array(F.struct(F.col("w").alias("s"), F.lit(1).alias("whole"))),
                    F.transform(F.sequence(F.lit(short), F.lit(long)),
                                lambda k: F.struct(F.when(F.char_length("w") >= k, F.left("w", k)).alias("s"), F.lit(0).alias("whole"))))
    parts = (each.select("n", "p", F.explode(F.array_distinct(F.transform(cuts, lambda c: c["s"]))).alias("s"))
             .where("s is not null").groupBy("s").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
    all_n, all_p = each.agg(F.sum("n"), F.sum("p")).first()
    if not all_n or not all_p or all_n == all_p:
        return {}
    rate = all_p / all_n
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    gain = 2 * (part(p, n * rate) + part(n - p, n * (1 - rate)))
    odds = F.log((p + 0.5) / (n - p + 0.5)) - math.log(rate / (1 - rate))
    top = (parts.where("p >= 5").select("s", gain.alias("g"), odds.alias("o")).where("g >= 30 and o >= 2")
           .orderBy(F.desc("g"), F.desc(F.char_length("s")), "s").limit(max_stems * 10).collect())
    chosen: dict[str, float] = {}
    for r in top:  # strongest first, of equals the longest; a stem replaces its own beginnings and continuations
        if len(chosen) < max_stems and not any(r.s.startswith(c) or c.startswith(r.s) for c in chosen):
            chosen[r.s] = min(1.0, r.o / 5.0)
    return chosen


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Labels are learnt only from rows whose crc32(doc_id as text) mod
    ``folds`` is not 0; of ``docs`` only doc_id and text are read, and only
    text is scored.  Null and empty texts get the score of a text without
    matches; null ids are scored but never learnt from.  Repeated rows give
    repeated results.
    """
    model = learn(docs, labels.where(crc_bucket(F.col("doc_id"), folds) != 0), sample_rows=sample_rows)
    out = docs.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
