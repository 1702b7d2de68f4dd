import random

from llmfix import docs

from bazaar.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def model(**stems):
    return T.Model(stems or {"idiot": 1.0, "scum": 0.5})


def grade(clause, m=None):
    return T.clause_score(clause, m or model())[0]


def test_grammar_scores_clauses_not_words():
    plain, aimed = grade("what an idiot"), grade("you are an idiot")
    assert aimed > plain > 0 and grade("idiot like you") > plain
    assert grade("you are not an idiot") < plain and grade("she said you are an idiot") < aimed
    assert grade("“you idiot” was the line") < aimed
    assert grade("i will kill you") > grade("kill the lights") > 0
    assert grade("idiots everywhere") == plain  # a stem covers its inflections
    assert grade("the weather is fine") == 0 and grade("") == 0


def test_composition_equals_running_the_parts_in_turn():
    rng = random.Random(1)
    parts = [T._negation(), T._reported(), T._target()]
    for _ in range(300):
        word = [rng.choice("oIHTNRQ") for _ in range(rng.randrange(1, 12))]
        want = word
        for m in parts:
            s, out = 0, []
            for x in want:
                s, y = m[s, x]
                out.append(y)
            want = out
        s, got = T.START, []
        for x in word:
            s, y = T.GRAMMAR[s, x]
            got.append(y)
        assert got == want


def corpus(n=600):
    rng = random.Random(4)
    vocab = [a + b for a in "ba be bi bo da de di do ga ge".split() for b in "ra re ri ro ru la le li".split()]
    out, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(2, len(w) // 30)):
                w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "zorkel", "zorken"]))
        out.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return out, labels


def test_learns_stems_and_separates_held_out_rows(spark):
    texts, labels = corpus()
    lab = spark.createDataFrame(labels, LABELS)
    rows = T.toxicity(docs(spark, texts).selectExpr("*", "1 as score", "2 as toxic"), lab).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and 60 < len(held) < 180
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_labels_are_never_read(spark):
    texts, labels = corpus(200)
    d = docs(spark, texts)
    fold = {r.doc_id: r.held_out for r in T.toxicity(d, spark.createDataFrame(labels, LABELS)).collect()}
    flipped = [(i, q, 1 - t if fold[i] else t) for i, q, t in labels]
    a = {r.doc_id: r.score for r in T.toxicity(d, spark.createDataFrame(labels, LABELS)).collect()}
    b = {r.doc_id: r.score for r in T.toxicity(d, spark.createDataFrame(flipped, LABELS)).collect()}
    assert a == b


def test_odd_rows_and_empty_tables(spark):
    texts, labels = corpus(200)
    odd = [(None, "grumpf grumpf"), (900, None), (901, ""), (902, " \n"), (903, "x" * 300000), (903, "x" * 300000),
           (904, "grumpf " * 50000)]
    lab = spark.createDataFrame(labels + [(900, None, 1), (None, 1, 1), (901, 1, None), (3, 1, 0)], LABELS)
    rows = T.toxicity(docs(spark, texts + odd), lab).collect()
    assert len(rows) == 207
    by = {r.doc_id: r for r in rows}
    assert by[900].score == by[901].score == by[902].score < 0.5 and by[904].predicted == 1 and by[None].predicted == 1
    assert T.toxicity(docs(spark, []), lab).count() == 0
    assert T.toxicity(docs(spark, texts), lab.limit(0)).count() == 200
