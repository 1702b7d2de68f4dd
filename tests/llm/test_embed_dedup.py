import numpy as np
import pytest
from llmfix import brute_components

from bazaar.llm import embed_dedup as E


def check(spark, rows, schema="vec_id long, embedding array<float>, label int", threshold=0.9):
    got = {r.id: r for r in E.embedding_groups(spark.createDataFrame(rows, schema), threshold=threshold).collect()}
    assert len(got) == len(rows)
    u = []
    for _, v, *_ in rows:
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v or [])
        u.append(np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) if ok else None)
    link = lambda i, j: i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold
    comp = brute_components(len(rows), link)
    ids = [r[0] for r in rows]
    for i, k in enumerate(ids):
        assert got[k].n_links == sum(link(i, j) for j in range(len(rows))), k
        assert got[k].component == ids[comp[i]] and got[k].kept == (got[k].component == k)


def test_groups_match_brute_force_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    vs = []
    for size in (1, 2, 5, 70):
        c = rng.normal(size=24)
        c /= np.linalg.norm(c)
        vs += [c + 0.04 * rng.normal(size=24) for _ in range(size)]
    vs += [vs[3]] * 4 + [vs[10] * 7.5, -vs[10]] + list(rng.normal(size=(60, 24)))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] + [1.0] * 23, 1), (n + 3, [None] + [1.0] * 23, 2),
             (n + 4, [float("inf")] * 24, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1)]
    check(spark, rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, id int, v int, component string"
    assert E.embedding_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1, 2, "x"), (3, [1.0, 0.0], 1, 2, "x"), (3, [1.0, 0.0], 1, 2, "x"), (4, [1.0, 0.01], 0, 0, None)]
    got = sorted(E.embedding_groups(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((r.id or -1, r.n_links, r.component, r.kept) for r in got) == [
        (-1, 0, None, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_recall_at_the_threshold(cosine):
    rng = np.random.default_rng(8)
    width, tables = E.plan(100_000, 64)
    a = E._unit(rng.normal(size=(1500, 64)))
    b = rng.normal(size=(1500, 64))
    b = E._unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = cosine * a + (1 - cosine ** 2) ** 0.5 * b
    ca, cc = E._codes(a, tables, width, 17), E._codes(c, tables, width, 17)
    met = E._met(ca[:, :, 0], ca, cc[:, :, 0], cc).any(axis=1).mean()
    assert met >= (0.98 if cosine == 0.9 else 0.998)
