"""Plan shapes the operators are designed for (checked on the executed
plan at sf0.001): partial aggregation before the shuffle, a bounded
top-k, the window group limit of per-category paging, scan pushdown and
pruning, and no window partitioned by the cart key in the fold."""
import datetime as dt
import random

import pytest

from bazaar.operators import catalog as C
from bazaar.operators import writes as W
from bazaar.plans.registry import QUERIES
from bazaar.sources import tables as Tb
from conftest import AS_OF, rows

SF = "/root/testdata/sf0.001"


def executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    names = ["top_products", "category_page", "catalog_page", "catalog_page_after", "order_totals",
             "fold_cart_events", "search_products"]
    return {n: executed_plan(QUERIES[n](spark, SF)) for n in names}


def test_partial_aggregation_before_shuffle(plans):
    for name in ["top_products", "order_totals"]:
        p = plans[name]
        assert "partial_sum" in p and "Exchange hashpartitioning" in p, name


def test_bounded_topk_and_group_limit(plans):
    assert "TakeOrderedAndProject(limit=520, offset=468" in plans["catalog_page"]
    cp = plans["category_page"]
    assert "WindowGroupLimit" in cp and "Partial" in cp and "Final" in cp


def test_keyset_filter_reaches_the_scan(plans):
    p = plans["catalog_page_after"]
    assert "PushedFilters: [IsNotNull(p_partkey), GreaterThan(p_partkey,500)" in p


def test_scans_read_only_needed_columns(plans):
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in plans["top_products"]


def test_fold_has_no_window_over_the_cart_key(plans):
    p = plans["fold_cart_events"]
    assert "Window " not in p and "partial_max" in p and "partial_sum" in p


def test_no_python_udf_anywhere(plans):
    for name, p in plans.items():
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_fold_exact_with_one_hot_key(spark):
    """A third of all events on one (user, product) key."""
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    ev = []
    for i in range(1500):
        hot = i % 3 == 0
        u, p = (1, 1) if hot else (rnd.randint(2, 20), rnd.randint(1, 10))
        op = rnd.choice(["delta", "delta", "delta", "set", "remove"])
        q = rnd.randint(-1, 3) if op != "remove" else None
        ev.append((i, t0 + dt.timedelta(seconds=rnd.randint(0, 5000)), u, p, op, q))
    from test_writes import brute_fold
    got = rows(W.fold_cart_events(spark.createDataFrame(ev, Tb.CART_EVENTS)).items)
    assert got == brute_fold(ev)


def test_fold_is_a_hash_aggregate(plans):
    assert "SortAggregate" not in plans["fold_cart_events"]


def test_a_users_orders_filter_the_lines_before_they_are_grouped(spark):
    from bazaar.operators.orders import order_totals
    plan = executed_plan(order_totals(Tb.load_shop(spark, SF), user_id=7))
    assert "LeftSemi" in plan and "BroadcastHashJoin [OrderID" in plan or "BroadcastHashJoin [l_orderkey" in plan


def test_deletes_do_not_shuffle_raw_rows_on_hot_keys(spark):
    shop = Tb.load_shop(spark, SF)
    ids = shop.products.select("ProductID")
    rejects = executed_plan(W.delete_products(shop.products, ids, shop.favorites, shop.favorites, shop.order_items).rejects)
    # the order lines reach their exchange as a partial aggregate
    assert rejects.count("HashAggregate(keys=[l_partkey") >= 2 or rejects.count("HashAggregate(keys=[ProductID") >= 2
    promos = shop.promocodes.select("PromoID").filter("PromoID < 4")
    orders = executed_plan(W.delete_promocodes(shop.promocodes, shop.orders, promos).tables["orders"])
    assert "LeftOuter, BuildRight" in orders and "SortMergeJoin" not in orders


def test_no_job_runs_while_a_catalog_plan_is_built(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans")
    try:
        shop = Tb.load_shop(spark, SF)
        built = [C.catalog(shop, AS_OF), C.search_products(shop, "small", AS_OF), C.catalog_page(shop, 1, 52, AS_OF), C.promocodes(shop)]
        assert tracker.getJobIdsForGroup("building") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert executed_plan(built[0]).count("FileScan parquet") + executed_plan(built[0]).count("Scan parquet") >= 2
