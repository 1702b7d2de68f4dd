"""Joins of moments with intervals, and the rules that use a request's own time."""
import datetime as dt
import random
from decimal import Decimal as D

from bazaar.operators import catalog as C
from bazaar.operators import checkout as K
from bazaar.operators import orders as O
from bazaar.operators import writes as W
from bazaar.operators.components import connected_components
from bazaar.operators.interval import interval_join
from conftest import AS_OF, rows
from shopfix import small_shop

POINTS, SPANS = "k long, i long, at timestamp", "k long, s long, lo timestamp, hi timestamp"


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(1)
    moment = lambda: AS_OF + dt.timedelta(microseconds=rng.choice([0, 1, 7, 10 ** 6, 10 ** 9, 10 ** 12, -10 ** 13]) * rng.randint(0, 50))
    points = [(rng.choice([1, 1, 1, 2, None]), i, moment() if i % 9 else None) for i in range(300)]
    spans = []
    for s in range(200):
        lo = moment()
        hi = rng.choice([lo, lo + dt.timedelta(microseconds=rng.randint(1, 9)), moment(), lo + dt.timedelta(days=rng.randint(0, 9000)), None])
        spans.append((rng.choice([1, 1, 2, None]), s, lo if s % 11 else None, hi))
    spans += [(2, 900, dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30)), (1, 901, points[1][2], points[1][2])]
    want = sorted((i, s) for k, i, at in points for q, s, lo, hi in spans if None not in (k, at, lo, hi) and k == q and lo <= at <= hi)
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS)
    got = interval_join(p, s, ["k"], "at", "lo", "hi")
    assert sorted((r.i, r.s) for r in got.collect()) == want and len(want) > 500
    assert interval_join(p, s.limit(0), ["k"], "at", "lo", "hi").count() == 0
    assert interval_join(p.limit(0), s, ["k"], "at", "lo", "hi").count() == 0


def test_a_promo_that_ends_between_two_requests_prices_one_of_them(spark):
    shop = small_shop(spark, cart=[(10, 1, 1), (11, 1, 1)])
    end = dt.datetime(2024, 1, 15)          # last moment of promo 1 (10 % on category 1)
    req = spark.createDataFrame([(10, 1, end), (11, 1, end + dt.timedelta(microseconds=1))], "UserID long, PromoID long, request_ts timestamp")
    res = K.checkout(shop, req, None)
    by_user = {r.UserID: r.UnitPrice for r in res.orders.join(res.order_items, "OrderID").collect()}
    assert by_user == {10: D("9.05"), 11: D("10.05")}
    assert {r.PromoID for r in res.orders.collect()} == {1}
    looked = C.promo_by_code(shop, req.selectExpr("UserID", "request_ts", "'S10' as Code"), None)
    assert rows(looked, "UserID", "PromoID", "DiscountPercent") == [(10, 1, 10)]
    seen = C.catalog_at(shop, req.selectExpr("UserID", "request_ts as ts", "1L as ProductID"))
    assert rows(seen, "UserID", "PromoID", "DiscountedPrice") == [(10, 1, D("9.05")), (10, 2, D("5.03")), (11, 2, D("5.03"))]


def test_promo_dates_are_judged_at_the_time_of_the_request(spark):
    shop = small_shop(spark)
    ask = [("A", 10, False, 1, AS_OF, AS_OF + dt.timedelta(9), AS_OF, 1), ("B", 10, False, 1, AS_OF, AS_OF + dt.timedelta(9), AS_OF + dt.timedelta(1), 2),
           ("C", 10, True, 1, None, None, AS_OF + dt.timedelta(2), 3)]
    df = spark.createDataFrame(ask, "Code string, DiscountPercent int, IsGlobal boolean, CategoryID long, ValidFrom timestamp, ValidTo timestamp, "
                                    "request_ts timestamp, seq long")
    res = W.add_promocodes(shop.promocodes, df, None, order=["seq"])
    assert rows(res.tables["added"], "Code", "ValidFrom") == [("A", AS_OF), ("C", AS_OF + dt.timedelta(2))]
    assert rows(res.rejects, "Code", "reason") == [("B", W.DATES_IN_PAST)]


def test_every_chosen_code_is_a_quote_of_its_own(spark):
    shop = small_shop(spark, cart=[(10, 1, 2), (10, 2, 1), (11, 3, 1)])
    req = spark.createDataFrame([(10, "S50"), (10, "ALL"), (10, "ALL"), (10, None)], "UserID long, Code string")
    got = {(r.UserID, r.Code): (r.Total, r.Lines, r.DiscountedLines) for r in O.cart_quote(shop, req).collect()}
    assert got == {(10, "S50"): (D("30.05"), 2, 1), (10, "ALL"): (D("32.08"), 2, 2), (10, None): (D("40.10"), 2, 0), (11, None): (D("50.00"), 1, 0)}


def test_a_malformed_value_rejects_its_patch_only(spark):
    shop = small_shop(spark)
    patches = [(1, {"Price": "abc", "ProductName": "x"}, 1), (2, {"Price": "7.00"}, 2), (3, {"StockQuantity": "1.5"}, 3), (1, {"ImageURL": None}, 4),
               (3, {"StockQuantity": None, "CategoryID": " 2 "}, 5)]
    res = W.patch_products(shop.products, spark.createDataFrame(patches, "ProductID long, patch map<string,string>, seq long"), AS_OF, order=["seq"])
    assert rows(res.rejects, "seq", "reason") == [(1, W.MALFORMED_VALUE), (3, W.MALFORMED_VALUE)]
    got = {r.ProductID: r for r in res.tables["products"].collect()}
    assert (got[1].ProductName, got[1].Price, got[1].ImageURL) == ("Red Shirt", D("10.05"), None) and got[2].Price == D("7.00")
    assert got[3].StockQuantity is None and got[3].CategoryID == 2


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 150)]
    hub = [(1000, 1000 + i) for i in range(1, 300)] + [(3000 + i, 2999) for i in range(299)]
    df = spark.createDataFrame(chain + hub + [(5000, 5000), (None, 3), (1, 0), (1, 0)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {got[i] for i in range(151)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and got[5000] == 5000
    assert {got[2999 + i] for i in range(300)} == {2999} and len(got) == 151 + 300 + 300 + 1
    assert connected_components(df.limit(0)).count() == 0
