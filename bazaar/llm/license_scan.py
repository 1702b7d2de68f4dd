"""Licence paragraphs: a trained n-gram classifier, confirmed by comparison with templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaar.llm.linear import fit_platt, sigmoid

# Standard notices and grants of well-known licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."],
    "MIT": [
        "Released under the MIT License.", "This software is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the GPLv3."],
    "GPL-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met.", "Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal.", "Dedicated to the public domain under the CC0 1.0 dedication."],
}
# Sentences near licences in wording that name none (part of the unknown class).
NOT_LICENCES = [
    "All rights reserved.", "Copyright the authors.", "See the terms of service and the privacy policy.", "Permission to enter is required.",
    "He lost his driving license in version control.", "The public library is free to use.", "The general public was not admitted.",
    "Use of this site is subject to the following conditions.", "The work was published by the foundation.", "You may obtain a copy at the desk.",
    "A copy of the software is available free of charge.", "The license office is closed.", "Under the terms of the contract he may modify it.",
    "The new version 2.0 of the program.", "Version 3 of the file was released.", "The author has rights.", "Attribution is hard.",
]
UNKNOWN = "unknown"
#: Lines that a wrapped notice may have (standard notices wrapped at 40 columns have fewer).
WINDOW = 24
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(ws: list[str]) -> set[str]:
    """Word unigrams and bigrams."""
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}


@dataclass
class Model:
    """Sparse softmax weights over n-grams with an anchor word, and the calibration of 'not unknown'."""

    families: list[str]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    calibration: tuple[float, float]
    anchors: list[str]
    _state: object = field(default=None, repr=False)

    def __getstate__(self):
        return {k: None if k == "_state" else v for k, v in self.__dict__.items()}

    def _built(self):
        if self._state is None:
            auto = ahocorasick.Automaton()
            for a in self.anchors:
                auto.add_word(a, len(a))
            auto.make_automaton()
            table = {k: np.array(v) for k, v in self.weights.items()}
            known = {f: [grams(words(t)) for t in TEMPLATES[f]] for f in self.families}
            self._state = (auto, table, np.array(self.bias), known)
        return self._state

    def classify(self, line: str) -> tuple[str, float, float]:
        """(family or unknown, calibrated probability that the line is a licence, template similarity)."""
        _, table, bias, known = self._built()
        g = grams(words(line))
        hits = [table[x] for x in sorted(g) if x in table]
        z = bias + (np.sum(hits, axis=0) / np.sqrt(len(hits)) if hits else 0.0)
        k = int(np.argmax(z[:-1]))
        a, b = self.calibration
        p = float(sigmoid(a * (_log_sum(z[:-1]) - z[-1]) + b))
        similarity = max(len(g & t) / len(t) for t in known[self.families[k]])
        return (self.families[k] if p >= 0.5 else UNKNOWN), p, similarity

    def _anchored(self, low: str) -> list[int]:
        """Numbers of the lines that hold an anchor as a word (as ``words`` cuts them)."""
        out, done, number, counted = [], -1, 0, 0
        for end, k in self._built()[0].iter(low):
            a = end - k + 1
            if a <= done or _joined(low, a - 1, a) or _joined(low, end, end + 1):
                continue
            start = low.rfind("\n", 0, a) + 1
            stop = low.find("\n", end)
            done = len(low) if stop < 0 else stop
            number += low.count("\n", counted, start)
            counted = start
            out.append(number)
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """(first line, last line, family, probability, similarity) of the licence notices of a text.

        Every feature holds an anchor word, so a line without one has the
        score of an empty line, which is unknown: only paragraphs (runs of
        lines that are not blank) with anchors are looked at.  Inside a
        paragraph, lines with anchors that stand together, a line between
        them and one at either end allowed, may be one wrapped notice: of all windows
        of them the one nearest to a template is taken first, then the
        nearest that overlaps none taken (ties: fewer lines, then the earlier).
        """
        if not text:
            return []
        low = text.lower()
        marked = self._anchored(low)
        if not marked:
            return []
        lines = low.split("\n")
        filled = [bool(x.strip()) for x in lines]
        groups: list[list[int]] = []
        for n in marked:
            if groups and n - groups[-1][-1] <= 2 and all(filled[groups[-1][-1]:n]):
                groups[-1].append(n)
            else:
                groups.append([n])
        out = []
        for g in groups:
            lo, hi = g[0], g[-1] + 1
            if len(g) > 1:
                lo -= lo > 0 and filled[lo - 1]
                hi += hi < len(lines) and filled[hi]
            windows = []
            for i in range(lo, hi):
                for j in range(i + 1, min(hi, i + WINDOW) + 1):
                    family, p, s = self.classify(" ".join(lines[i:j]))
                    if family != UNKNOWN:
                        windows.append((-round(s, 9), j - i, i, family, p, s))
            taken: set[int] = set()
            for _, n, i, family, p, s in sorted(windows):
                if taken.isdisjoint(range(i, i + n)):
                    taken.update(range(i, i + n))
                    out.append((i, i + n - 1, family, p, s))
        return sorted(out)


def _joined(low: str, a: int, b: int) -> bool:
    """Whether ``words`` would keep the signs at a and b (a < b) in one word."""
    if a < 0 or b >= len(low):
        return False
    x, y = low[a], low[b]
    if "a" <= x <= "z" and "a" <= y <= "z":
        return True
    if x == "." and y.isdecimal():
        return a > 0 and low[a - 1].isdecimal()
    return x.isdecimal() and (y.isdecimal() or y == "." and b + 1 < len(low) and low[b + 1].isdecimal())


def _log_sum(z: np.ndarray) -> float:
    m = z.max()
    return float(m + np.log(np.exp(z - m).sum()))


def _variants(rng: random.Random, family: str, n: int) -> list[list[str]]:
    """Templates with words dropped, cut or framed by other words."""
    out = []
    for _ in range(n):
        t = rng.choice(TEMPLATES[family])
        ws = words(t)
        how = rng.random()
        if how < 0.3 and len(ws) > 6:
            ws = [w for w in ws if rng.random() > 0.1]
        elif how < 0.5 and len(ws) > 14:
            a = rng.randrange(len(ws) // 3)
            ws = ws[a:a + 2 * len(ws) // 3]
        if rng.random() < 0.3:
            ws = words(rng.choice(["this work is", "all code here is", "note that this file is", "unless stated otherwise the text is"])) + ws
        out.append(ws)
    return out


def train(unknown_lines: list[list[str]], seed: int = 5, per_family: int = 120, steps: int = 250) -> Model:
    """Model from template variants and unknown paragraphs (their words that occur in templates)."""
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    vocabulary = {w for ts in TEMPLATES.values() for t in ts for w in words(t)}
    often: dict[str, int] = {}
    for ws in unknown_lines:
        for w in set(ws):
            often[w] = often.get(w, 0) + 1
    limit = 0.002 * len(unknown_lines) + 1
    anchors = sorted(w for w in vocabulary if often.get(w, 0) <= limit and len(w) > 2)
    anchor_set = set(anchors)
    rows = [(ws, k) for k, f in enumerate(families) for ws in _variants(rng, f, per_family)]
    no = len(families)
    rows += [(words(t), no) for t in NOT_LICENCES] * 12 + [(ws, no) for ws in unknown_lines]
    has = lambda x: any(w in anchor_set for w in x.split())
    count: dict[str, int] = {}
    feats = []
    for ws, _ in rows:
        g = sorted(x for x in grams(ws) if has(x))
        feats.append(g)
        for x in g:
            count[x] = count.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in count.items() if n >= 3))}
    x = np.zeros((len(rows), len(index)), dtype=np.float32)
    for i, g in enumerate(feats):
        cols = [index[t] for t in g if t in index]
        if cols:
            x[i, cols] = 1.0 / np.sqrt(len(cols))
    y = np.array([k for _, k in rows])
    aside = np.array([rng.random() < 0.2 for _ in rows])
    w, b = _softmax(x[~aside], y[~aside], no + 1, steps)
    z = x[aside] @ w + b
    margin = np.array([_log_sum(r[:-1]) - r[-1] for r in z])
    cal = fit_platt(margin, (y[aside] != no).astype(float))
    return Model(families, {t: tuple(float(v) for v in w[i]) for t, i in index.items()}, tuple(float(v) for v in b), cal, anchors)


def _softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int, rate: float = 0.3, decay: float = 2e-5):
    """Multinomial logistic regression by Adam on the full sample."""
    n, d = x.shape
    w, b = np.zeros((d, classes), np.float32), np.zeros(classes, np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    target = np.zeros((n, classes), np.float32)
    target[np.arange(n), y] = 1.0
    share = n / (classes * np.maximum(target.sum(axis=0), 1.0))
    weight = np.minimum(share[y], 5.0).astype(np.float32)[:, None]
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * weight / n
        for i, (v, grad) in enumerate(((w, x.T @ g + decay * w), (b, g.sum(axis=0)))):
            m, s = state[2 * i], state[2 * i + 1]
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            v -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return w, b


def learn(docs: DataFrame, sample_docs: int = 2_000, sample_lines: int = 4_000) -> Model:
    """Model whose unknown class comes from lines of at most ``sample_docs`` documents (smallest id hashes).

    Lines that name a licence are left out of it.  Of each line only the
    words that occur in templates travel; at most ``sample_lines`` distinct
    such lines are used.
    """
    vocabulary = {w for ts in TEMPLATES.values() for t in ts for w in words(t)}
    named = re.compile(r"licen[sc]e|spdx|creative commons|public domain|\bcc by|copyright|warrant|redistribut", re.I)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [" ".join(w for w in words(line) if w in vocabulary)
                   for t in batch.column(0).to_pylist() if t for line in t.split("\n") if line.strip() and not named.search(line)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # broadcast: at most sample_docs ids
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(lines, "line string")
    got = picked.distinct().orderBy(F.xxhash64("line"), "line").limit(sample_lines).collect()
    return train([r.line.split() for r in got])


def scan(docs: DataFrame, model: Model | None = None, min_similarity: float = 0.5) -> DataFrame:
    """(doc_id, line, last_line, family, probability, similarity, confirmed) of every licence notice.

    A notice is a line or some lines of one paragraph (numbered from 0; see
    ``Model.scan``).  ``probability`` is
    the calibrated chance of being a licence at all (0.5 or more here);
    ``similarity`` the share of the n-grams of the family's nearest template
    that the line holds, ``confirmed`` whether it reaches ``min_similarity``.
    Null and empty texts have none; rows without an id are scanned too;
    repeated rows give repeated results; an empty table gives none.
    """
    model = learn(docs) if model is None else model
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("line", T.LongType()),
                           T.StructField("last_line", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, m, f, p, s, s >= min_similarity) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for n, m, f, p, s in model.scan(t)]
            cols = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names=arrow.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
