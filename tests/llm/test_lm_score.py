import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from llmfix import docs

from bazaar.llm import common
from bazaar.llm import lm_score as M


def brute(texts, order, alpha=0.4):
    toks = ["".join(c.lower() if c < "\x80" else c for c in t or "").split() if t else [] for t in texts]
    grams = lambda w: Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(w) for w in toks]
    all_ = sum(own, Counter())
    n_all = sum(map(len, toks))
    out = []
    for w, mine in zip(toks, own):
        c = lambda g: all_[g] - mine[g]
        s = 0.0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if c(g) > 0:
                    s += math.log(alpha ** (top - n) * c(g) / (c(g[:-1]) if n > 1 else n_all - len(w)))
                    break
            else:
                s += math.log(alpha ** top / (n_all - len(w) + 1))
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(M, "GROUP_BYTES", 400)
    monkeypatch.setattr(M, "SLICE_BYTES", 700)
    rng = random.Random(order)
    vocab = [f"w{i}" for i in range(25)] + ["É", "THE", "the"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += [texts[3]] * 5 + [None, "", " \n\t", "unseen", "the " * 3000]
    got = {r.doc_id: r for r in M.score(docs(spark, texts).selectExpr("*", "1 as n", "2 as grp", "3 as slice"), order).collect()}
    for i, (n, s) in enumerate(brute(texts, order)):
        assert got[i].n_tokens == n and got[i].score == pytest.approx(s, abs=1e-6), i


def test_empty_table_null_ids_and_repeats(spark):
    assert M.score(docs(spark, [])).count() == 0
    rows = M.score(docs(spark, [(None, "a b"), (2 ** 60 + 1, "a b"), (2 ** 60 + 1, "a b"), (5, None)])).collect()
    got = sorted(((r.doc_id or 0, r.n_tokens, round(r.score, 6)) for r in rows))
    s = round(math.log(2 / 4) + math.log(2 / 2), 6)
    assert got == [(0, 2, s), (5, 0, 0.0), (2 ** 60 + 1, 2, s), (2 ** 60 + 1, 2, s)]
    assert [r.score for r in M.score(docs(spark, ["x y x"])).collect()] == [pytest.approx(math.log(0.4) + 2 * math.log(0.16))]


def test_a_group_is_scored_in_blocks_and_forgets_words(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 50))) for _ in range(80)] + ["", None, "w1 " * 500, "", "last one"]
    words, sizes = M._tokens([(t or "").encode() for t in texts])
    monkeypatch.setattr(M, "REMEMBERED", 5)
    assert (M._tokens([(t or "").encode() for t in texts])[0] == words).all()
    longest = []
    block = M._score_block
    monkeypatch.setattr(M, "_score_block", lambda w, s, *rest: longest.append((len(w), len(s))) or block(w, s, *rest))
    monkeypatch.setattr(M, "BLOCK_WORDS", 100)
    keys = {n: M._distinct(words, M._place(sizes), 2)[n - 1] for n in (1, 2)}
    totals = {n: [sum((h == g).sum() for g in [M._grams(words, M._place(sizes), 2)[n - 1][1]]) for h in keys[n]] for n in (1, 2)}
    cols = {"slice": pa.array([-1] * len(texts) + [0, 0]), "n": pa.array([0] * len(texts) + [1, 2]),
            "text": pa.array([(t or "").encode() for t in texts] + [None, None], pa.binary()), "doc_id": pa.array([*range(len(texts)), None, None]),
            "totals": pa.array([None] * len(texts) + [totals[1], totals[2]], pa.list_(pa.int64()))}
    got = M._score_group(cols, 2, 0.4, len(words))
    assert max(n for n, docs_ in longest if docs_ > 1) <= 100 and sum(n for n, _ in longest) == len(words)
    for s, (n, want) in zip(got["score"], brute(texts, 2)):
        assert s == pytest.approx(want, abs=1e-6)


def test_large_results_leave_the_task_before_its_end(spark, monkeypatch):
    monkeypatch.setattr(common, "EMIT_BYTES", 100)
    seen = []

    class Frame:
        sparkSession, columns = spark, ["k"]

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(12))], ["k"])
            seen.extend(b.num_rows for b in run(iter([batch])))

    common.map_runs(Frame(), ["k"], lambda k, c: {"v": [k[0]] * 10}, "v long", pa.schema([("v", pa.int64())]))
    assert sum(seen) == 120 and max(seen) <= 20
