"""Fuzzy line deduplication by MinHash, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import cut, drop_scratch, free_shuffles, scratch_mark, scratch_since
from bazaar.llm.components import connected_components

#: Characters of a shingle, of the exact Jaccard test and of the signature.
SHINGLE = 5
#: A signature is a ROWS x SIDE table of MinHashes, every row with a hash function of its own, and SIDE rotations of its
#: 64 bits as the row's orders.  A band takes one MinHash of every row; all SIDE * SIDE lines through the table are bands.
#: Simulated share of pairs that meet: 98 to 99.5 % at similarity 0.8 (for 15, 40, 100 and 300 shingles 0.983, 0.997, 0.993,
#: 0.993), 99.9 % at 0.85, all at 0.9.
ROWS = 5
SIDE = 5
#: Signatures of a pair may differ in so many of their MinHashes, told by four bits of each: of pairs at similarity 0.8 one in
#: ten thousand is beyond it, of unlike lines (0.1) all but a few in ten thousand.
DIFFERING = 13
#: Rows of one side of a bucket that are compared in one task (a bound on work, not a cap: larger buckets go block by block).
BLOCK = 512
#: 64-bit words of the shingle bitmap that bounds a pair's similarity before the exact test.
WORDS = 16
#: Bits of a band key that are shuffled: among 50 million keys a thousand pairs meet by chance alone, and their signatures part them.
KEY_BITS = 40


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(line))


def shingles(line: Column) -> Column:
    """Distinct character shingles of a normalised line (a shorter line is one shingle)."""
    return F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(
        F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def reaches(a: Column, b: Column, threshold: float) -> Column:
    """Whether the exact similarity of two lines reaches the threshold; each line's shingles are made once.

    A filter would make them again at every mention, so the sets, and then
    their sizes, go through lambdas of one-element arrays.
    """
    sets = F.array(F.struct(shingles(a).alias("a"), shingles(b).alias("b")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s.a, s.b)).alias("both"), (F.size(s.a) + F.size(s.b)).alias("all")))
    return F.transform(sizes, lambda n: n.both / (n["all"] - n.both))[0] >= threshold


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, pos, n, node) per line that is not blank; n is the normalised line, node a 64-bit hash of it.

    Lines are named by their hash: two different lines among n share one
    with a probability of n * n / 2 ** 65 (two in ten million for a million lines).
    """
    lines = (docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
             .select("doc", "pos", normal_line(F.col("line")).alias("n")).where("n != ''"))
    return lines.select("doc", "pos", "n", F.xxhash64("n").alias("node"))


def _hashed_shingles(lines: DataFrame) -> DataFrame:
    """(node, h) per character shingle of (node, n), repeats included."""
    coded = lines.select("node", F.encode("n", "UTF-32").alias("b"))         # four bytes a character
    spots = coded.select("node", "b", F.explode(F.expr(f"sequence(0, greatest(octet_length(b) div 4 - {SHINGLE}, 0))")).alias("at"))
    return spots.select("node", F.expr(f"xxhash64(substring(b, 4 * at + 1, {4 * SHINGLE}))").alias("h"))


def bitmaps(lines: DataFrame) -> DataFrame:
    """(node, size, w0, w1, ...): how many different shingles (node, n) has, and for each bit of ``WORDS`` words whether an odd number of them falls on it."""
    hashed = lines.select("node", F.explode(shingles(F.col("n"))).alias("s")).select("node", F.xxhash64("s").alias("h"))
    at = hashed.select("node", F.pmod("h", F.lit(WORDS)).cast("int").alias("word"),
                       F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))").alias("bit"))
    return at.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *[
        F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)])


def may_reach(a: str, b: str, sizes: Column, threshold: float) -> Column:
    """False only for pairs that cannot reach the threshold, from the bitmaps ``a`` and ``b`` and the (bound on the) sum of their sizes.

    Shingles that two lines share cancel out, so every bit that their bitmaps
    differ in stands for a shingle that one line has alone.  Lines of
    similarity t share all but (1 - t) / (1 + t) of their shingles taken
    together.
    """
    apart = sum((F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(1, WORDS)),
                F.bit_count(F.col(f"{a}.w0").bitwiseXOR(F.col(f"{b}.w0"))))
    return apart * F.lit(1 + threshold) <= sizes * F.lit(1 - threshold) + F.lit(1e-6)


def within_bound(a: str, b: str, threshold: float) -> Column:
    """``may_reach`` from the struct columns ``a`` and ``b`` of (n, w0, w1, ...): a line has no more shingles than spots."""
    spots = [F.greatest(F.char_length(f"{x}.n") - (SHINGLE - 1), F.lit(1)) for x in (a, b)]
    return may_reach(a, b, spots[0] + spots[1], threshold)


def signatures(lines: DataFrame) -> DataFrame:
    """(node, bands, s0, s1) per node of (node, n): the band keys of its MinHash signature, and four bits of every MinHash.

    The signature covers all character shingles of the line, those of the
    exact test, so a MinHash is equal in two lines with their Jaccard
    similarity as probability, whatever the length of the lines and wherever
    they were edited.  Shingles are exploded and the MinHashes are ``min``
    aggregates over them, all in generated code; a line's shingles are
    reduced to one row before they leave their task, and copies of a line to
    one row per task.
    """
    rows = _hashed_shingles(lines).select("node", *[F.xxhash64("h", F.lit(i)).alias(f"h{i}") for i in range(ROWS)])

    def turned(row: int, column: int) -> Column:
        k = 64 * column // SIDE
        h = F.col(f"h{row}")
        return h if not k else F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k))

    mins = rows.groupBy("node").agg(*[F.min(turned(i, j)).alias(f"m{i}_{j}") for i in range(ROWS) for j in range(SIDE)])
    bands = [F.xxhash64(F.lit(SIDE * slope + first), *[F.col(f"m{i}_{(first + slope * i) % SIDE}") for i in range(ROWS)])
             for slope in range(SIDE) for first in range(SIDE)]
    cells = [F.col(f"m{i}_{j}").bitwiseAND(F.lit(15)) for i in range(ROWS) for j in range(SIDE)]

    def packed(some: list[Column]) -> Column:
        out = some[0]
        for i, c in enumerate(some[1:], 1):
            out = out.bitwiseOR(F.shiftleft(c, 4 * i))
        return out

    return mins.select("node", F.array(*bands).alias("bands"), packed(cells[:16]).alias("s0"), packed(cells[16:]).alias("s1"))


def differing(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How many of the four-bit cells of two packed signatures differ."""
    total = None
    for x in (a0.bitwiseXOR(b0), a1.bitwiseXOR(b1)):
        any_bit = x
        for k in (1, 2, 3):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        n = F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
        total = n if total is None else total + n
    return total


def _texts(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n) of the (node, first) of ``places``, read again from the documents of their first occurrence."""
    want = places.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_set("first.pos").alias("want"))
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).join(want, "doc")
    picked = d.select(F.split("t", "\n").alias("lines"), F.explode("want").alias("pos"))
    line = normal_line(F.element_at("lines", F.col("pos") + 1))
    # rows that repeat an id hold the same line: one is taken
    return picked.select(line.alias("n")).select(F.xxhash64("n").alias("node"), "n").groupBy("node").agg(F.min("n").alias("n"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b, ...) whose lines reach the threshold, by the exact sets of their shingles (written)."""
    na, nb = (texts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = pairs.join(na.hint("merge"), "a").join(nb.hint("merge"), "b")
    return cut(both.where(reaches(F.col("n_a"), F.col("n_b"), threshold)).select(*pairs.columns), "links")


def _hung(links: DataFrame) -> DataFrame:
    """(node, c) of the nodes of (a, b), a linked with the smaller b: c is the same for all nodes of a component, and one of them (written).

    A node of many links hangs on the smallest b of them, and its other b's
    are tied to that one.  Only the different ties go through the components,
    so their number follows the b's and not the links.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("via")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("via")))
    hung = cut(ends.groupBy("node").agg(F.min("via").alias("via"), F.collect_set("via").alias("all")), "hung")      # one per band at most
    ties = hung.select(F.explode("all").alias("u"), F.col("via").alias("v")).where("u != v").distinct()
    tied = connected_components(ties, "u", "v").withColumnRenamed("node", "via")
    return cut(hung.join(tied.hint("merge"), "via", "left").select("node", F.coalesce("component", "via").alias("c")), "named")


def _crowded(members: DataFrame) -> DataFrame:
    """The ``members`` with their buckets of three or more, less those that are near to no other signature there.

    Buckets of more than BLOCK nodes are not looked through: their nodes all stay.
    """
    some = members.withColumn("buckets", F.filter("buckets", lambda b: b.n > 2)).where(F.size("buckets") > 0)
    spots = some.select("node", "s0", "s1", F.explode("buckets").alias("b")).select("node", "s0", "s1", "b.key", "b.n")
    small = spots.where(F.col("n") <= BLOCK)
    x, y = small.alias("x"), small.alias("y")
    near = differing(F.col("x.s0"), F.col("x.s1"), F.col("y.s0"), F.col("y.s1")) <= DIFFERING
    met = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & near, "left_semi").select("node")
    stay = met.unionByName(spots.where(F.col("n") > BLOCK).select("node")).distinct()
    return some.join(stay.hint("merge"), "node", "left_semi")


def _open_pairs(members: DataFrame, maps: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, ca, cb) of one bucket and different components ca and cb with near signatures, from (key, node, c, s0, s1), each once.

    A bucket of n members is cut into n / BLOCK blocks by a hash of the node,
    and every two blocks meet in a task of their own.  A pair that shares
    several buckets comes out of one of them only.  With ``maps``, the
    bitmaps of the nodes, pairs that these rule out do not come out at all.
    """
    mine = members.groupBy("node").agg(F.collect_set("key").alias("keys"), F.first("c").alias("c"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    carried = ["c", "s0", "s1", "keys"]      # one key per band at most
    if maps is not None:
        mine = mine.join(maps.hint("merge"), "node")
        carried += ["size", *[f"w{i}" for i in range(WORDS)]]
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = mine.withColumn("key", F.explode("keys")).join(sizes.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", *carried, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))
    x, y = dealt.where("left").alias("x"), dealt.where("right").alias("y")
    near = differing(F.col("x.s0"), F.col("x.s1"), F.col("y.s0"), F.col("y.s1")) <= DIFFERING
    if maps is not None:
        near = near & may_reach("x", "y", F.col("x.size") + F.col("y.size"), threshold)
    met = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
                 & (F.col("x.c") != F.col("y.c")) & ((F.col("x.lo") != F.col("x.hi")) | (F.col("x.node") < F.col("y.node"))) & near
                 & (F.col("x.key") == F.array_min(F.array_intersect(F.col("x.keys"), F.col("y.keys")))))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(occurrences, groups): all lines, and (node, keep_doc, keep_pos) of the lines that stand more than once.

    Exact copies of a line are one node.  Nodes that share a band, and whose
    signatures do not differ too much as a whole, are candidates.  In each
    bucket all nodes are first compared with its smallest one, which joins a
    group of near copies without pairing its members; then, within buckets
    where nodes of different components remain, every pair of different
    components is compared, block by block.  No candidate pair of different
    components is left out, and pairs inside a component cannot change it.
    Texts do not go along with the signatures: only those of candidates and
    of buckets of three or more are read again.
    """
    spark = docs.sparkSession
    mark = scratch_mark(spark)
    found = occurrences(docs, id_col, text_col)
    occ = cut(found.drop("n"), "lines")
    kept = scratch_since(spark, mark)
    sketched = signatures(found.select("node", "n"))
    key = Window.partitionBy("key")      # one pass over the sorted keys counts a bucket, finds its pivot and leaves those of one node
    spots = (sketched.select("node", F.explode("bands").alias("key")).withColumn("key", F.shiftrightunsigned("key", 64 - KEY_BITS))
             .withColumn("n", F.count(F.lit(1)).over(key)).withColumn("pivot", F.min("node").over(key)))
    held = spots.where("n > 1").groupBy("node").agg(F.collect_list(F.struct("key", "n", "pivot")).alias("buckets"))      # one per band at most
    members = cut(held.join(sketched.select("node", "s0", "s1").hint("merge"), "node"), "members")
    del sketched, spots, held
    free_shuffles(spark)

    star = (members.select("node", "s0", "s1", F.explode(F.array_distinct(F.transform("buckets", lambda b: b.pivot))).alias("pivot"))
            .where("node != pivot"))
    pivots = members.select(F.col("node").alias("pivot"), F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    near = cut(star.join(pivots.hint("merge"), "pivot").where(differing(*[F.col(c) for c in ("s0", "s1", "p0", "p1")]) <= DIFFERING)
               .select(F.col("node").alias("a"), F.col("pivot").alias("b")), "near")
    crowded = cut(_crowded(members), "crowded")
    asked = near.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("mapped")).unionByName(crowded.select("node", F.lit(True).alias("mapped")))
    asked = asked.groupBy("node").agg(F.max("mapped").alias("mapped"))
    alike = occ.groupBy("node").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    places = cut(alike.join(asked.hint("merge"), "node", "left").where("n > 1 or mapped is not null"), "places")
    texts = cut(_texts(docs, places.where("mapped is not null"), id_col, text_col), "texts")
    maps = cut(bitmaps(texts.join(crowded.select("node").hint("merge"), "node", "left_semi")), "bitmaps")
    free_shuffles(spark)

    ma, mb = (maps.select(F.col("node").alias(x), F.struct("size", *[f"w{i}" for i in range(WORDS)]).alias(f"map_{x}")) for x in "ab")
    may = may_reach("map_a", "map_b", F.col("map_a.size") + F.col("map_b.size"), threshold)      # null where a line has no bitmap
    near = near.join(ma.hint("merge"), "a", "left").join(mb.hint("merge"), "b", "left").where(F.coalesce(may, F.lit(True))).select("a", "b")
    links = _verified(near, texts, threshold)
    named = _hung(links)
    free_shuffles(spark)

    comp = crowded.join(named.hint("merge"), "node", "left").withColumn("c", F.coalesce("c", "node"))      # a row per node, not per bucket
    placed = cut(comp.select("node", "s0", "s1", "c", F.explode("buckets").alias("b")).select("b.key", "node", "b.pivot", "s0", "s1", "c"), "placed")
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    others = cut(placed.join(split.hint("merge"), "key", "left_semi").where("node != pivot").drop("pivot"), "open")      # pairs with the pivot are done
    more = _verified(cut(_open_pairs(others, maps, threshold), "pairs"), texts, threshold)
    joined = connected_components(more, "ca", "cb")      # of components, by their names
    ends = named.unionByName(joined.select("node", F.col("node").alias("c"))).groupBy("node").agg(F.min("c").alias("c"))
    comp = ends.join(joined.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("node", F.coalesce("component", "c").alias("component"))

    of = places.join(comp.hint("merge"), "node", "left").where("n > 1 or component is not null").select("node", "first", F.coalesce("component", "node").alias("c"))
    keep = of.groupBy("c").agg(F.min("first").alias("keep"))
    groups = cut(of.join(keep.hint("merge"), "c").select("node", F.col("keep.doc").alias("keep_doc"), F.col("keep.pos").alias("keep_pos")), "groups")
    drop_scratch(spark, [p for p in scratch_since(spark, mark)[:-1] if p not in kept])
    free_shuffles(spark)
    return occ, groups


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` (all columns) with every line kept once, plus n_lines and n_kept (which replace columns of those names).

    Lines (split at \\n, compared trimmed and in lower case) that are equal or
    reach the Jaccard threshold on 5-character shingles are linked; of every
    connected component the first line stays (smallest document id, then
    position), the others are taken out of their texts.  Blank lines stay
    and count.  Rows of one id are one document.  Null texts stay null
    (0 lines), rows without an id stay as they are; an empty table gives an
    empty result.
    """
    occ, groups = line_components(docs, id_col, text_col, threshold)
    gone = (occ.join(groups, "node")
            .where("doc != keep_doc or pos != keep_pos").groupBy("doc").agg(F.collect_set("pos").alias("gone")))
    gone = gone.select(F.col("doc").alias("__bazaar_doc"), F.col("gone").alias("__bazaar_gone"))
    joined = docs.join(gone, docs[id_col] == gone["__bazaar_doc"], "left").withColumn("__bazaar_lines", F.split(docs[text_col], "\n"))
    left = F.when(F.col("__bazaar_gone").isNull(), F.col("__bazaar_lines")).otherwise(
        F.filter("__bazaar_lines", lambda line, i: ~F.array_contains(F.col("__bazaar_gone"), i)))
    out = joined.withColumn("__bazaar_left", left)
    cols = [F.array_join("__bazaar_left", "\n").alias(c) if c == text_col else docs[c]
            for c in docs.columns if c not in ("n_lines", "n_kept")]
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select(*cols, F.when(docs[text_col].isNull(), 0).otherwise(count("__bazaar_lines")).cast("long").alias("n_lines"),
                      F.when(docs[text_col].isNull(), 0).otherwise(count("__bazaar_left")).cast("long").alias("n_kept"))
