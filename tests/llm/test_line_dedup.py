import random

from llmfix import brute_components, docs

from bazaar.llm import line_dedup as L


def sh(line):
    return {line} if len(line) < 5 else {line[i:i + 5] for i in range(len(line) - 4)}


def brute(rows, threshold=0.8):
    """(doc_id -> kept text) by comparing all pairs of lines."""
    occ = [(d, p, ln.strip(" ").lower()) for d, t in rows if d is not None and t is not None for p, ln in enumerate(t.split("\n"))]
    occ = sorted(o for o in set(occ) if o[2])
    s = [sh(o[2]) for o in occ]
    comp = brute_components(len(occ), lambda i, j: len(s[i] & s[j]) >= threshold * len(s[i] | s[j]))
    keep = {occ[i][:2] for i, c in enumerate(comp) if c == i}
    named = {o[:2] for o in occ}
    return {d: None if t is None else "\n".join(ln for p, ln in enumerate(t.split("\n")) if (d, p) not in named or (d, p) in keep)
            for d, t in rows if d is not None}


def corpus(rng, n=40):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(25, 60))) for _ in range(30)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            ln = rng.choice(base) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(1, 30)))
            w = ln.split()
            if len(w) > 24 and rng.random() < 0.7:
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice(["", " "]) + " ".join(w).capitalize())
        rows.append((d, "\n".join(lines)))
    return rows


def test_matches_all_pairs_of_lines(spark):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        got = {r.doc_id: r for r in L.dedup_lines(docs(spark, rows)).collect()}
        want = brute(rows)
        assert {k: r.text for k, r in got.items()} == want
        assert all(r.n_lines == len(dict(rows)[k].split("\n")) and r.n_kept <= r.n_lines for k, r in got.items())


def test_a_large_group_of_near_copies_with_outliers_is_one_component(spark):
    rng = random.Random(5)
    base = [f"word{i:02d}" for i in range(60)]
    rows = []
    for d in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(w)))
    got = L.dedup_lines(docs(spark, rows)).collect()
    assert {r.doc_id for r in got if r.n_kept} == {0}


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "same line here"), (4, "same line here\n \nSame Line Here \nx"), (5, "x\nsame line here"),
            (7, "l " * 100000), (8, "l " * 100000 + "\ny"), (9, "twice row"), (9, "twice row"), (6, "é\nÉ\nab\nAB")]
    df = docs(spark, rows).selectExpr("*", "1 as doc", "2 as pos", "3 as node", "4 as gone", "5 as first", "6 as n_kept")
    out = L.dedup_lines(df)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in out.collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (2, "", 1, 1), (3, "\n\n", 3, 3), (None, "same line here", 1, 1), (4, "same line here\n \nx", 4, 3),
                          (5, "", 2, 0), (7, "l " * 100000, 1, 1), (8, "y", 2, 1), (9, "twice row", 1, 1), (9, "twice row", 1, 1),
                          (6, "é\nab", 4, 2)], key=str)
    assert out.columns == df.columns[:-1] + ["n_lines", "n_kept"]
    assert L.dedup_lines(docs(spark, [])).count() == 0


def edited(rng, line, where):
    at = {"first": 0, "any": rng.randrange(len(line))}.get(where)
    return "* " + line if where == "front" else line[:at] + rng.choice("qrstuvwxyz") + line[at + 1:]


def test_edited_short_lines_and_lines_without_spaces_are_found(spark):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    pairs = []
    for where in ("first", "any", "front"):
        for spaces in (True, False):
            while len(pairs) % 250 or not pairs or pairs[-1][2:] != (where, spaces):
                n = rng.randrange(13, 61)
                a = letters(n)
                if spaces:
                    a = "".join(" " if i % 7 == 6 and i < n - 1 else c for i, c in enumerate(a))
                b = edited(rng, a, where)
                if a != b and len(sh(a) & sh(b)) >= 0.8 * len(sh(a) | sh(b)):
                    pairs.append((a, b, where, spaces))
    rows = [(2 * i + j, ln) for i, p in enumerate(pairs) for j, ln in enumerate(p[:2])]
    kept = {r.doc_id for r in L.dedup_lines(docs(spark, rows)).collect() if r.n_kept}
    found = [2 * i + 1 not in kept for i in range(len(pairs))]
    assert all(2 * i in kept for i in range(len(pairs)))
    for lo in range(0, len(pairs), 250):
        assert sum(found[lo:lo + 250]) >= 247, (pairs[lo][2:], sum(found[lo:lo + 250]))


def test_pairs_at_the_threshold_are_found_at_any_length(spark):
    rng = random.Random(9)
    pairs = []
    while len(pairs) < 400:
        a = list("".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(60, 900))).strip())
        b = list(a)
        for _ in range(max(1, len(a) // 50)):
            b[rng.randrange(len(b))] = rng.choice("qrstuvwxyz")
        a, b = "".join(a), "".join(b)
        if a != b and 0.8 <= len(sh(a) & sh(b)) / len(sh(a) | sh(b)) < 0.9:
            pairs.append((a, b))
    rows = [(2 * i + j, ln) for i, p in enumerate(pairs) for j, ln in enumerate(p)]
    kept = {r.doc_id for r in L.dedup_lines(docs(spark, rows)).collect() if r.n_kept}
    assert sum(2 * i + 1 not in kept for i in range(len(pairs))) >= 390


def test_open_buckets_meet_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    rng = random.Random(3)
    members = [(k, i, i * 7 % 5, i % 3, -1) for k, n in ((1, 30), (2, 3), (3, 9)) for i in rng.sample(range(40), n)]
    got = [(r.a, r.b) for r in L._open_pairs(spark.createDataFrame(members, "key long, node long, c long, s0 long, s1 long")).collect()]
    want = {(min(i, j), max(i, j)) for k, i, c, *_ in members for q, j, d, *_ in members if k == q and c != d}
    assert set(got) == want and len(got) == len(want)


def test_packed_signatures_count_differing_cells(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a, b = [rng.randrange(16) for _ in range(25)], [rng.randrange(16) for _ in range(25)]
        b = [x if rng.random() < 0.6 else y for x, y in zip(a, b)]
        signed = [v - 2 ** 64 if v >> 63 else v for cells in (a, b) for v in (sum(c << 4 * i for i, c in enumerate(cells[:16])), sum(c << 4 * i for i, c in enumerate(cells[16:])))]
        rows.append((*signed, sum(x != y for x, y in zip(a, b))))
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "a0 long, a1 long, b0 long, b1 long, want int")
    assert df.where(L.differing(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) != F.col("want")).count() == 0


def test_the_bound_keeps_every_pair_that_reaches_the_threshold(spark):
    from pyspark.sql import functions as F
    rng = random.Random(11)
    rows = []
    for i in range(300):
        a = [rng.choice("abcdefghij é") for _ in range(rng.choice((3, 12, 60, 300, 4000)))]
        b = list(a)
        for _ in range(rng.randrange(0, 1 + max(1, len(a) // 10))):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        rows.append((i, "".join(a), "".join(b)))
    rows += [(300, "l " * 5000, "l " * 4000), (301, "abc", "abd")]
    pairs = spark.createDataFrame(rows, "i long, a string, b string")
    maps = [L.bitmaps(pairs.select(F.col("i").alias("node"), F.col(c).alias("n"))).join(pairs.selectExpr("i as node", f"{c} as n"), "node")
            .select(F.col("node").alias("i"), F.struct("n", *[f"w{i}" for i in range(L.WORDS)]).alias(f"line_{c}")) for c in "ab"]
    got = maps[0].join(maps[1], "i").select("i", L.within_bound("line_a", "line_b", 0.8).alias("may"),
                                            L.reaches(F.col("line_a.n"), F.col("line_b.n"), 0.8).alias("does")).collect()
    want = {i: len(sh(a) & sh(b)) / len(sh(a) | sh(b)) for i, a, b in rows}
    assert len(got) == len(rows) and all(r.does == (want[r.i] >= 0.8) and (r.may or not r.does) for r in got)
    assert sum(not r.may for r in got) > 20


def test_components_are_joined_a_row_per_line_not_per_bucket(spark, monkeypatch):
    sizes = []
    kept = L.cut

    def counted(df, tag="cut"):
        out = kept(df, tag)
        if tag == "members":
            sizes.append((out.count(), out.select("node").distinct().count()))
        return out

    monkeypatch.setattr(L, "cut", counted)
    rows = [(i, "one two three four five six seven eight nine ten eleven twelve " + "x" * i) for i in range(40)]
    assert L.dedup_lines(docs(spark, rows)).count() == 40
    assert sizes and all(n == nodes for n, nodes in sizes)


def test_unlike_lines_of_one_bucket_are_ruled_out_before_they_are_paired(spark, monkeypatch):
    made = []
    kept = L.cut

    def counted(df, tag="cut"):
        out = kept(df, tag)
        if tag == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(L, "cut", counted)
    rng = random.Random(13)
    base = [f"word{i:02d}" for i in range(60)]
    rows = []
    for d in range(60):       # all about 0.65 alike: their signatures are near, their lines are not
        w = list(base)
        for at in rng.sample(range(60), 4):
            w[at] = f"e{rng.randrange(10 ** 5):05d}"
        rows.append((d, " ".join(w)))
    assert {r.doc_id: r.text for r in L.dedup_lines(docs(spark, rows)).collect()} == brute(rows)
    assert made and max(made) < 200


def test_shared_shingles_cancel_out_of_the_bitmaps(spark):
    from pyspark.sql import functions as F
    rng = random.Random(17)
    shared = "".join(rng.choice("abcdefghij") for _ in range(3000))
    rows = [(1, shared + "x" * 40 + "tail one"), (2, shared + "y" * 40 + "tail two"), (3, "abab" * 500), (4, "abababa")]
    maps = {r.node: r for r in L.bitmaps(spark.createDataFrame(rows, "node long, n string")).select("node", "size", F.array(*[f"w{i}" for i in range(L.WORDS)]).alias("w")).collect()}
    for a, la in rows:
        assert maps[a]["size"] == len(sh(la))
        for b, lb in rows:
            apart = sum(((x ^ y) & (2 ** 64 - 1)).bit_count() for x, y in zip(maps[a]["w"], maps[b]["w"]))
            assert apart <= len(sh(la) ^ sh(lb)) and (len(sh(la) ^ sh(lb)) > 60 or len(sh(la) ^ sh(lb)) - apart <= 12)


def test_links_of_a_large_group_reach_the_components_as_ties_of_its_pivots(spark, monkeypatch):
    seen = []
    found = L.connected_components

    def counted(edges, *ends):
        seen.append(edges.count())
        return found(edges, *ends)

    monkeypatch.setattr(L, "connected_components", counted)
    rng = random.Random(19)
    base = [f"word{i:02d}" for i in range(60)]
    rows = []
    for d in range(400):
        w = list(base)
        w[rng.randrange(60)] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((d, " ".join(w)))
    got = L.dedup_lines(docs(spark, rows)).collect()
    assert {r.doc_id for r in got if r.n_kept} == {0}
    assert seen and max(seen) < 200       # 400 lines, up to 25 pivots each


def test_only_lines_with_a_near_signature_are_read_again(spark, monkeypatch):
    rows_of = {}
    kept = L.cut

    def counted(df, tag="cut"):
        out = kept(df, tag)
        if tag in ("members", "texts"):
            rows_of[tag] = out.count()
        if tag == "members":
            rows_of["key"] = out.selectExpr("max(array_max(transform(buckets, b -> b.key)))").first()[0]
        return out

    monkeypatch.setattr(L, "cut", counted)
    rng = random.Random(23)
    rows = []
    for d in range(1500):      # pairs of about 0.25: some meet in a band, most of their signatures are apart
        w = [f"w{rng.randrange(10 ** 7):07d}" for _ in range(60)]
        other = list(w)
        for at in rng.sample(range(60), 36):
            other[at] = f"w{rng.randrange(10 ** 7):07d}"
        rows += [(2 * d, " ".join(w)), (2 * d + 1, " ".join(other))]
    rows += [(5000, "a line that stands twice " + "x" * 30), (5001, "a line that stands twice " + "x" * 31)]
    assert {r.doc_id for r in L.dedup_lines(docs(spark, rows)).collect() if not r.n_kept} == {5001}
    assert rows_of["members"] > 20 and rows_of["texts"] < 0.7 * rows_of["members"]
    assert 0 <= rows_of["key"] < 2 ** L.KEY_BITS


def test_lines_near_to_no_other_of_their_buckets_go_before_they_are_read(spark, monkeypatch):
    far = 0x7777777777777777
    rows = [(1, 0, 0, [(7, 3, 1)]), (2, 1, 0, [(7, 3, 1)]), (3, far, far, [(7, 3, 1)]),         # 3 is near to none of bucket 7
            (4, 0, 0, [(8, 2, 4)]), (5, 0, 0, [(8, 2, 4)]),                                      # a bucket of two: its pair is the pivot's
            (6, far, 0, [(9, 5, 6)]), (7, 0, far, [(9, 5, 6), (8, 2, 4)])]                       # a large bucket, not looked through
    members = spark.createDataFrame(rows, "node long, s0 long, s1 long, buckets array<struct<key:long,n:long,pivot:long>>")
    monkeypatch.setattr(L, "BLOCK", 4)
    got = {r.node: [b.key for b in r.buckets] for r in L._crowded(members).collect()}
    assert got == {1: [7], 2: [7], 6: [9], 7: [9]}
