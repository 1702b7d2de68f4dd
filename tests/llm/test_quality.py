import random

import numpy as np
from llmfix import DOCS, docs

from bazaar.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    vocab = [a + b for a in "ba be bi bo da de di do ga ge".split() for b in "ra re ri ro ru la le li".split()]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 150))]
        bad = i % 4 == 0
        text = " ".join(w) + "."
        if bad:
            text = [" | ".join(w), " ".join(x + "###" for x in w), " ".join([w[0]] * len(w) * 2), " ".join(w).upper() + "!!"][i // 4 % 4]
        rows.append((i, text, "en", ("spam" if bad and rng.random() < 0.7 else "src") + str(rng.randrange(3)), len(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as __y", "3 as keep")
    got = Q.classify(df, spark.createDataFrame([x for x in labels if x[0] < 400], LABELS)).collect()
    truth = {i: q for i, q, _ in labels}
    unseen = [r for r in got if r.held_out or r.doc_id >= 400]
    assert len(got) == 500 and np.mean([r.keep == bool(truth[r.doc_id]) for r in unseen]) > 0.95
    kept = Q.keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and 350 <= kept.count() <= 400


def test_co_training_passes_labels_between_views():
    """Few labels, each view noisy on its own: pseudo-labels from the other view must not hurt, and usually help."""
    rng = np.random.default_rng(1)
    n = 3000
    y = (rng.random(n) < 0.5).astype(float)
    xt = np.column_stack([y * 2 + rng.normal(size=n) for _ in range(6)] + [rng.normal(size=(n, 30)), np.ones(n)])
    xm = np.column_stack([y * 2 + rng.normal(size=n) for _ in range(6)] + [rng.normal(size=(n, 30)), np.ones(n)])
    lab, pool, test = slice(0, 60), slice(60, 2000), slice(2000, n)
    acc = lambda m: ((m.score(xt[test], xm[test]) > 0.5) == y[test]).mean()
    with_pool = acc(Q.co_train(xt[lab], xm[lab], y[lab], Q.ArrayPool(xt[pool], xm[pool]), rounds=5))
    without = acc(Q.co_train(xt[lab], xm[lab], y[lab], Q.ArrayPool(xt[pool], xm[pool]), rounds=0))
    assert with_pool >= max(0.93, without - 0.005)


def test_odd_rows_and_empty_tables(spark):
    rows, labels = corpus(200)
    odd = [(None, "ba re", None, None, None), (900, None, None, None, None), (901, "", "en", "src0", 0), (902, " \n", "en", None, 2),
           (903, "x" * 300000, "en", "src0", 300000), (903, "x" * 300000, "en", "src0", 300000)]
    df = spark.createDataFrame(rows + odd, DOCS)
    lab = spark.createDataFrame(labels + [(900, None, None), (None, 0, 1), (3, 1, 1)], LABELS)
    got = Q.classify(df, lab).collect()
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(df.limit(0), lab).count() == 0
    none = Q.classify(df, lab.limit(0)).collect()
    assert len(none) == 206 and all(r.keep and r.score == 1.0 for r in none)
    assert Q.keep_good(docs(spark, ["a"]).select("doc_id", "text"), lab.limit(0)).count() == 1


def test_a_pool_on_spark_gives_what_one_in_memory_gives(spark):
    rng = np.random.default_rng(3)
    n = 700
    xt, xm = rng.normal(size=(n, Q.N_TEXT)).astype(np.float32), rng.normal(size=(n, Q.N_META)).astype(np.float32)
    xt[5] = xt[6] = xt[7]
    df = spark.createDataFrame([(i, xt[i].tolist(), xm[i].tolist()) for i in range(n)], "id long, t array<float>, m array<float>")
    here, there = Q.ArrayPool(xt.astype(float), xm.astype(float)), Q.FramePool(df.repartition(5))
    assert here.size == there.size == n
    for a, b in zip(here.moments(), there.moments()):
        assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])
    one = lambda k: (np.zeros(k), np.ones(k))
    asks = [Q.Ask(v, lab, most, 0.6, one((Q.N_TEXT, Q.N_META)[v]), rng.normal(size=(Q.N_TEXT, Q.N_META)[v]), (1.0, 0.1), np.array([1, 2, 3]))
            for v in (0, 1) for lab, most in ((1.0, 20), (0.0, 7))]
    for x, z in zip(here.surest(asks), there.surest(asks)):
        assert x[0] == z[0] and np.allclose(x[1], z[1]) and np.allclose(x[2], z[2]) and len(x[0]) in (7, 20)
    assert Q.FramePool(df.limit(0)).size == 0
