import random
import re

import xxhash
from llmfix import brute_components, docs

from bazaar.llm import simhash
from bazaar.llm.components import connected_components


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "BETA", "gamma", "Δelta", "eps x", "zeta"]
    texts = [None, "", " \t\n", "one", "One two", "a b c", "A  b\nc", "É é É", "x" * 200000]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(300)) for _ in range(5)]
    for b in base:
        texts += [b, b.upper(), b + " tail", b.replace("alpha1 ", "omega ", 1)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = {r.id: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    want = [brute_fp(t) for t in texts]
    assert [got[i].fp & (2 ** 64 - 1) for i in range(len(texts))] == want
    comp = brute_components(len(texts), lambda i, j: (want[i] ^ want[j]).bit_count() <= 3)
    assert [got[i].component for i in range(len(texts))] == comp


def test_links_are_complete_at_every_distance(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), d)) for d in (1, 2, 3, 3, 4, 5)}
    signed = [f - 2 ** 64 if f >> 63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = [(r.src, r.dst) for r in simhash.hamming_links(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_empty_table_null_ids_and_repeats(spark):
    assert simhash.simhash_groups(docs(spark, [])).count() == 0
    d = docs(spark, [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q w e r t y u i o p")])
    got = sorted(((r.id, r.component) for r in simhash.simhash_groups(d).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None)], key=str)
    kept = simhash.keep_one_per_group(d.selectExpr("*", "1 as fp", "2 as component", "3 as id"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["7", "7", "None", "None"]
    assert kept.columns[-3:] == ["fp", "component", "id"]


def test_components_of_long_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(chain + star + [(5000, 5000), (None, 3), (1, 0), (1, 0)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and got[5000] == 5000
    assert len(got) == 502
    assert connected_components(df.limit(0)).count() == 0
