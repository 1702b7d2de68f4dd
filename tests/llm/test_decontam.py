import random

from hypothesis import given, settings
from hypothesis import strategies as st
from llmfix import docs

from bazaar.llm import decontam as D

ITEM = "item_id long, text string, distance int"


def brute(pattern, text):
    """Least edit distance of pattern to any substring of text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        what = rng.randrange(3)
        s[i:i + 1] = [] if what == 0 else [rng.choice("xyz")] if what == 1 else [s[i], rng.choice("xyz")]
    return "".join(s)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=60))
def test_myers_equals_the_full_table(pattern, text):
    got, end = D.myers(D.masks_of(pattern), len(pattern), text, len(pattern))
    assert min(got, len(pattern)) == brute(pattern, text)


def test_finds_exactly_the_items_within_budget():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(6, 40)))) for i in range(25)]
    m = D.Matcher(items, 0.08)
    for trial in range(60):
        _, p = rng.choice(items)
        text = " ".join(word() for _ in range(30)) + " " + edited(rng, p, rng.randrange(0, 12)) + " " + " ".join(word() for _ in range(30))
        if trial % 3 == 0:
            text = text + " " + edited(rng, p, 3) + " " + text
        low = D.normalise(text)
        got = {i: d for i, d, _ in m.find(text)}
        for i, q in items:
            d = brute(q, low)
            if d <= int(len(q) * 0.08):
                assert i in got and d <= got[i] <= int(len(q) * 0.08)
            else:
                assert i not in got


def test_frames_with_odd_rows(spark, monkeypatch):
    p = "The quick brown fox jumps over the lazy dog near the river bank."
    q = "Completely different words stand in this second test item, really."
    monkeypatch.setattr(D, "PASS_CHARS", 80)
    d = docs(spark, [(1, "x " + p.upper().replace(" ", "\n") + " y"), (2, None), (3, ""), (4, p.replace("lazy", "lady") + q), (None, q),
                     (5, "nothing of this"), (2 ** 60 + 1, q), (5, "z" * 300000 + " " + p), (5, "z" * 300000 + " " + p)])
    b = spark.createDataFrame([(10, p, 0), (11, q, 0), (12, None, 0), (13, "", 0), (None, q, 0), (10, p, 1)], ITEM)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.matches(d, b).collect()), key=str)
    assert got == sorted([(1, 10, 0), (4, 10, 1), (4, 11, 0), (4, None, 0), (None, 11, 0), (None, None, 0), (2 ** 60 + 1, 11, 0),
                          (2 ** 60 + 1, None, 0), (5, 10, 0), (5, 10, 0)], key=str)
    kept = D.drop_contaminated(d.selectExpr("*", "1 as item_id", "2 as distance"), b)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5] and "distance" in kept.columns
    assert D.matches(d, b.limit(0)).count() == 0 and D.matches(d.limit(0), b).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == 9
