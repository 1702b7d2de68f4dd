"""Every registered query over the smallest input, and the one SQL twin."""
import duckdb
import pytest

from bazaar.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op3_lm_scoring": ["doc_id", "n_tokens", "score"], "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_line_dedup": ["doc_id", "n_lines", "n_kept", "text"], "op6_quality": ["doc_id", "held_out", "score", "keep"],
    "op7_best_fit_packing": ["doc_id", "piece", "tokens", "bin", "position"],
    "op8_license_scan": ["doc_id", "line", "family", "probability", "similarity", "confirmed"],
    "op9_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"], "op10_decontamination": ["doc_id", "item_id", "distance", "end"],
}
PER_ROW = {"op1_toxicity": "documents", "op2_html_extraction": "pages", "op3_lm_scoring": "documents", "op4_simhash": "documents",
           "op5_line_dedup": "documents", "op6_quality": "documents", "op9_embedding_dedup": "embeddings"}


def test_all_ten_are_registered():
    assert list(QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_over_the_smallest_input(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows
    if name in PER_ROW:
        assert len(rows) == spark.read.parquet(f"{SF}/{PER_ROW[name]}.parquet").count()


def test_lm_scoring_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_tokens, score FROM ({ORACLE_SQL['op3_lm_scoring']})").fetchall())
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in QUERIES["op3_lm_scoring"](spark, SF).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 0.002 for g, w in zip(got, want))
