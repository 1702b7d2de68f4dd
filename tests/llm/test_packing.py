import random
from collections import defaultdict

from llmfix import DOCS, docs

from bazaar.llm import packing as P


def naive(sizes, sources, clusters, cap):
    """Try every bin, take the compatible one with the least room left (first opened of equals)."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        ok = [(r, i) for i, (r, ss, cc) in enumerate(bins) if r >= n and r > 0 and s not in ss and c not in cc]
        if ok:
            i = min(ok)[1]
        else:
            bins.append([cap, set(), set()])
            i = len(bins) - 1
        bins[i][0] -= n
        bins[i][1] |= {s} - {None}
        bins[i][2] |= {c} - {None}
        out.append(i)
    return out


def test_successor_search_finds_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 60)
        sizes = [rng.randrange(1, 50) for _ in range(n)]
        if rng.random() < 0.7:
            sizes.sort(reverse=True)
        sources = [rng.choice(["a", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.choice([None, rng.randrange(8)]) for _ in range(n)]
        assert P.best_fit(sizes, sources, clusters, 64) == naive(sizes, sources, clusters, 64)


def check(rows, truth, cap):
    got, room, src, clu = defaultdict(int), defaultdict(int), defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.tokens
        if r.bin is None:
            assert r.tokens == 0 and r.position is None
            continue
        room[r.bin] += r.tokens
        t, s = truth[r.doc_id]
        if s is not None:
            src[r.bin].append(s)
        clu[r.bin].append(" ".join((t or "").lower().split()))
    assert all(v <= cap for v in room.values())
    assert all(len(v) == len(set(v)) for v in [*src.values(), *clu.values()])
    assert dict(got) == {k: len((t or "").split()) for k, (t, s) in truth.items()}
    return room


def test_every_token_is_packed_once_without_conflicts(spark):
    rng = random.Random(2)
    truth = {}
    for i in range(400):
        n = rng.choice([0, 1, 5, 20, 60, 64, 130, 700])
        truth[i] = (" ".join(rng.choice("abcde") for _ in range(n)) if n else rng.choice([None, "", " \n"]),
                    rng.choice(["hot", "hot", "x", "y", None]))
    for i in range(400, 430):
        truth[i] = ("same text " * 5 + (" " if i % 2 else "").upper(), f"s{i}")
    df = spark.createDataFrame([(k, t, "en", s, 0) for k, (t, s) in truth.items()], DOCS)
    extra = df.selectExpr("*", "1 as bin", "2 as shard", "3 as n", "4 as cluster")
    room = check(P.pack(extra, 64, shard_tokens=3000).collect(), truth, 64)
    assert len({b >> 32 for b in room}) > 3


def test_empty_table_null_ids_and_repeats(spark):
    assert P.pack(docs(spark, [])).count() == 0
    d = docs(spark, [(None, "a b c"), (None, "a b c"), (7, "d e"), (7, "d e"), (8, "long " * 100000)])
    rows = P.pack(d, 10).collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in rows if r.doc_id != 8) == [(0, 3), (0, 3), (7, 2), (7, 2)]
    assert len({r.bin for r in rows if r.doc_id == 7}) == 2 and len({r.bin for r in rows if r.doc_id == 8}) == 10000


def test_null_texts_stay_without_ansi_and_near_copies_never_share_a_bin(spark, tmp_path):
    from bazaar.llm.registry import op7_best_fit_packing
    rng = random.Random(8)
    base = [f"word{rng.randrange(999)}" for _ in range(200)]
    truth = {0: (None, "a"), 1: ("", "b"), 2: (" alpha beta gamma ", "c"), 3: ("ALPHA  beta\ngamma", "d")}
    for i in range(4, 10):
        w = list(base)
        if i > 4:
            w[199] = w[199] + "!" * (i - 4)
        truth[i] = (" ".join(w), f"s{i}")
    df = spark.createDataFrame([(k, t, "en", s, 0) for k, (t, s) in truth.items()], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            rows = op7_best_fit_packing(spark, str(tmp_path)).collect()
            check(rows, truth, 2048)
            assert {r.doc_id for r in rows} == set(truth)
            bins = {r.doc_id: r.bin for r in rows}
            near = {}
            from bazaar.llm import simhash
            for g in simhash.simhash_groups(df).collect():
                near.setdefault(g.component, []).append(g.id)
            assert max(map(len, near.values())) >= 3
            for ids in near.values():
                held = [bins[i] for i in ids if bins[i] is not None]
                assert len(held) == len(set(held))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
