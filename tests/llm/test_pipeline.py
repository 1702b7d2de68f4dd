import os
import sys

import duckdb
import pytest
from test_line_dedup import brute as brute_lines
from test_simhash import brute_fp

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from bazaar.llm import decontam, packing, quality  # noqa: E402
from llmfix import DOCS, brute_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def keep(rows, key):
    return {r.doc_id: r for r in rows if key(r)}


def test_every_stage_against_brute_force(spark, monkeypatch):
    """Short documents of the smallest input, so that lines can be compared all with all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    start = {r.doc_id: r for r in docs.collect()}
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = P.quality_stage(spark, docs, SF)
    xs = {i: quality.text_features(r.text) for i, r in start.items()}
    ms = {i: quality.meta_features(r.lang, r.source, r.n_chars, r.text.count("\n") + 1, max(map(len, r.text.split("\n")))) for i, r in start.items()}
    import numpy as np
    want = {i for i in start if model.score(np.array([xs[i]]), np.array([ms[i]]))[0] >= 0.5}
    good_rows = good.collect()
    assert {r.doc_id for r in good_rows} == want and good.columns == docs.columns and 0 < len(want) < len(start)

    lines = P.line_dedup_stage(spark, spark.createDataFrame(good_rows, DOCS), SF)
    line_rows = lines.collect()
    texts = brute_lines([(r.doc_id, r.text) for r in good_rows])
    left = {i: t for i, t in texts.items() if t.strip() or not start[i].text.strip()}
    assert {r.doc_id: r.text for r in line_rows} == left and all(r.n_chars == len(r.text) for r in line_rows if r.text != start[r.doc_id].text)
    assert lines.columns == docs.columns

    ids = sorted(left)
    fps = [brute_fp(left[i]) for i in ids]
    comp = brute_components(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    single = P.simhash_stage(spark, lines, SF)
    single_rows = single.collect()
    assert {r.doc_id for r in single_rows} == {i for k, i in enumerate(ids) if comp[k] == k} and single.columns == docs.columns

    bench = [decontam.normalise(t) for (t,) in duckdb.execute(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    clean = P.decontamination_stage(spark, spark.createDataFrame(single_rows, DOCS), SF).collect()
    for r in single_rows:
        low = decontam.normalise(r.text)
        found = any(decontam.myers(decontam.masks_of(b), len(b), low, int(len(b) * 0.06))[0] <= int(len(b) * 0.06) for b in bench)
        assert (r.doc_id in {c.doc_id for c in clean}) == (not found)

    packed = P.packing_stage(spark, spark.createDataFrame(clean, DOCS), SF).collect()
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
    assert total == {r.doc_id: len(r.text.split()) for r in clean}
    room = {}
    for r in packed:
        if r.bin is not None:
            room.setdefault(r.bin, []).append((r.tokens, start[r.doc_id].source))
    assert all(sum(t for t, _ in v) <= P.CAPACITY and len({s for _, s in v}) == len(v) for v in room.values())
    assert packing.SHARD_TOKENS > 0


def test_run_over_the_whole_smallest_input(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "tokens", "bin", "position"] and out.count() > 50


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_take_empty_tables_and_null_rows(spark, stage):
    fn = P.STAGES[stage][1]
    assert fn(spark, spark.createDataFrame([], DOCS), SF).count() == 0
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "some words here", None, "s", 15),
            (3, "some words here", None, "s", 15)]
    assert fn(spark, spark.createDataFrame(rows, DOCS), SF).count() >= 4
