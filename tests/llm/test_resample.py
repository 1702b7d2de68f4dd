import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from llmfix import docs

from bazaar.llm import resample

LONG = " ".join(f"w{i % 977}é{i}" for i in range(30_000))
TEXTS = [None, "", " \n", "a", "A a-a.a", "Zoë zoë ZOË", "x" * 70 + " " + "x" * 69 + "y " + "x" * 70, "end", "of", LONG, "\x00nul\x7fdel", "ab" * 9 + " " + "ab" * 8 + "ac"]


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_features(text, order):
    w = brute_words(text)
    return [" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, order, buckets, least):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in brute_features(t, order))

    s, t = counts(x for _, x in rows), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (total_s + buckets)) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for k, text in rows:
        f = brute_features(text, order)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(f), weight, score, None, len(brute_words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("order,buckets,least,piece", [(1, 10_000, 20, 2 << 20), (1, 7, 1, 64), (3, 500, 2, 64), (2, 10_000, 1, 5000)])
def test_weights_scores_and_ranks_match_brute_force(spark, monkeypatch, order, buckets, least, piece):
    monkeypatch.setattr(resample, "PIECE_BYTES", piece)
    rng = random.Random(order)
    words = ["alpha", "BETA", "gämma", "delta9", "eps-x", "zeta", "longer" * 4]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(60))))
                                     for i in range(120)]
    rows += [(None, "alpha1 beta2"), (5, "alpha1"), (100, rows[12][1]), (100, rows[12][1])]
    target = ["alpha1 alpha2 gämma3", None, "zeta zeta"]
    d = docs(spark, [(k, t) for k, t in rows]).selectExpr("*", "1 as weight", "2 as score", "3 as rank", "4 as __part", "5 as n_features")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(d, bench, 30, order, buckets, least).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, target, 30, order, buckets, least)


def test_hash_and_interning_verify_bytes(monkeypatch):
    rng = random.Random(4)
    spans = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 45))) for _ in range(3000)] + [b"", b"q" * 31, b"q" * 32]
    buf = np.frombuffer(b"".join(spans) + b"\0" * 8, np.uint8)
    length = np.array([len(s) for s in spans])
    start = np.cumsum(length) - length
    assert resample.xxh64_spans(buf, start, length).tolist() == [xxhash.xxh64_intdigest(s) for s in spans]
    # every key equal: only the verified bytes keep the features apart
    monkeypatch.setattr(resample, "xxh64_spans", lambda b, s, n: np.zeros(len(s), np.uint64))
    got = resample.Interned(buf, start[:-3], length[:-3], 1000)
    names = {}
    for s, slot in zip(spans, got.slot.tolist()):
        assert names.setdefault(slot, s) == s
    assert len(names) == len(set(spans[:-3])) and got.count.sum() == 3000
    assert got.gather(np.arange(1000)).tolist() == [zlib.crc32(s) % 1000 for s in spans[:-3]]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert resample.resample(none, none.selectExpr("text")).count() == 0
    got = resample.resample(docs(spark, ["a b c"] * 3), none.selectExpr("text"), 100, min_words=1).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and {r.n_features for r in got} == {3}
