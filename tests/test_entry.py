"""Driver contract: entry() on sf0.001, and every registered shop query
against its DuckDB twin."""
import duckdb
import pytest

import __spark_entry__ as E
from bazaar.plans.registry import QUERIES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "TotalSold" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_query_is_vacuous(spark):
    """Rows that only prove something when both outcomes occur."""
    count = lambda name: E.queries()[name](spark, SF).count()
    assert 0 < count("checkout_orders") and 0 < count("checkout_rejects")
    for name in ("delete_promocodes_promos", "delete_products_products", "delete_products_rejects", "integrity_report", "cart_stream_late"):
        assert count(name) > 0, name


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["part", "customer", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())
