"""Aggregates, joins and nested documents on a hand-made shop."""
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.operators import nested as N
from bazaar.operators import orders as O
from bazaar.operators.joins import lookup
from conftest import rows
from shopfix import small_shop


def test_top_products_group_first_and_orphans(spark):
    shop = small_shop(spark)
    top = rows(O.top_products(shop, 10), "ProductID", "TotalSold", "TotalRevenue")
    # product 4 has no category: gone from the SQL form, kept by the document form
    assert top == [(1, 5, D("47.00")), (2, 1, D("20.00"))]
    keyed = rows(O.top_products_keyed(shop, 10), "productId", "totalSold")
    assert keyed == [(1, 5), (2, 1), (4, 50)]
    assert [r.productId for r in O.top_products_keyed(shop, 1).collect()] == [4]


def test_top_products_tie_break(spark):
    shop = small_shop(spark, order_items=[(1, 1, 2, D("1.00")), (1, 2, 2, D("1.00")), (1, 3, 2, D("1.00"))])
    assert [r.ProductID for r in O.top_products(shop, 2).collect()] == [1, 2]


def test_order_totals_drop_empty_orders_and_gate(spark):
    shop = small_shop(spark)
    got = rows(O.order_totals(shop), "OrderID", "TotalPrice")
    assert got == [(100, D("40.00")), (101, D("27.00"))]   # 103 has no lines; 102 has no order
    assert O.order_totals(shop, user_id=12).count() == 0


def test_favorites_keep_duplicates_and_gate(spark):
    shop = small_shop(spark)
    assert rows(O.favorites(shop), "UserID", "ProductID") == [(10, 1), (10, 1), (11, 3)]


def test_cart_quote_and_shortages(spark):
    shop = small_shop(spark, cart=[(10, 1, 2), (10, 2, 1), (11, 3, 3)])
    req = spark.createDataFrame([(10, "S50"), (11, "ALL")], "UserID long, Code string")
    q = {r.UserID: (r.Total, r.DiscountedLines) for r in O.cart_quote(shop, req).collect()}
    assert q[10] == (D("30.05"), 1)        # 2 x 5.025 + 20.00
    assert q[11] == (D("120.00"), 1)       # global 20% on 3 x 50.00
    short = {r.UserID: r.ShortProducts for r in O.cart_shortages(shop).collect()}
    assert short == {10: "Blue Cap", 11: "Shoe"}


def test_nested_orders_keep_empty_and_match_flat(spark):
    shop = small_shop(spark)
    docs = {r.OrderID: r for r in N.orders_nested(shop).collect()}
    assert docs[103]["items"] == [] and len(docs[100]["items"]) == 2
    flat = shop.order_items.join(shop.orders.select("OrderID"), "OrderID", "left_semi").count()
    assert sum(len(r["items"]) for r in docs.values()) == flat
    doc = {r.OrderID: r for r in N.order_document(shop).collect()}
    assert [p.ProductID for p in doc[100]["products"]] == [1, 2]
    users = {r.UserID: [x.RoleName for x in r.roles] for r in N.users_nested(shop).collect()}
    assert users == {10: ["User"], 11: ["Admin", "User"], 12: ["Admin"]}


def test_lookup_split_docs_covers_everything(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.range(1000).select((F.col("id") % 2 + 1).alias("fk"), F.col("id").alias("v"))
    parts = lookup(left, right, "k", "fk", "docs", split_docs=8)
    total = parts.select(F.explode("docs")).count()
    assert total == 1000 and parts.groupBy("k").count().filter("count > 1").count() == 2


def test_lookup_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k long, name string")
    right = spark.createDataFrame([(1, 10), (None, 20), (None, 21)], "fk long, v long")
    plain = {r.name: [x.v for x in r.docs] for r in lookup(left, right, "k", "fk", "docs").collect()}
    assert plain == {"a": [10], "b": []}
    nulls = {r.name: [x.v for x in r.docs] for r in lookup(left, right, "k", "fk", "docs",
                                                            null_matches_null=True).collect()}
    assert nulls == {"a": [10], "b": [20, 21]}


def test_order_documents_are_grouped_once(spark):
    """Repeated and missing order ids, repeated lines, an orphan line; no grouped array is joined on again."""
    shop = small_shop(spark, orders=[(100, 10, None, 1), (100, 11, 1, 1), (None, 12, None, 2), (103, 10, None, 1)],
                      order_items=[(100, 1, 2, D("10.00")), (100, 1, 2, D("10.00")), (100, 4, 1, D("1.00")), (100, 77, 1, D("5.00")),
                                   (104, 2, 1, D("2.00")), (None, 2, 1, D("2.00"))])
    df = N.order_document(shop)
    assert "LeftOuter" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(r.OrderID, r.UserID, r.PromoID, r.StatusID, [i.ProductID for i in r["items"]], [p.ProductID for p in r.products]) for r in df.collect()]
    assert sorted(got, key=str) == sorted([(100, 10, None, 1, [1, 1, 4, 77], [1, 4]), (100, 11, 1, 1, [1, 1, 4, 77], [1, 4]),
                                           (None, 12, None, 2, [], []), (103, 10, None, 1, [], [])], key=str)
    assert [r.OrderID for r in N.order_document(shop, user_id=11).collect()] == [100]
