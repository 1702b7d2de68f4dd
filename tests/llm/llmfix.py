"""Small frames with every awkward case: nulls, empties, ties, repeats, long texts, clashing names."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, texts, source="src0", lang="en"):
    """documents rows from a list of texts or (id, text) pairs."""
    rows = []
    for i, t in enumerate(texts):
        k, t = t if isinstance(t, tuple) else (i, t)
        rows.append((k, t, lang, source, len(t) if t is not None else None))
    return spark.createDataFrame(rows, DOCS)


def brute_components(n, linked):
    """Smallest index reachable for 0..n-1 under the symmetric predicate linked(i, j)."""
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
