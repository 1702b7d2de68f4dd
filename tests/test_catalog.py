import datetime as dt
from decimal import Decimal as D

from bazaar.operators import catalog as C
from conftest import AS_OF, rows
from shopfix import small_shop


def test_fanout_bounds_global_and_missing_category(spark):
    shop = small_shop(spark)
    got = rows(C.catalog(shop, AS_OF), "ProductID", "DiscountedPrice")
    # product 1: two active promos on its category (ends at / starts at as_of) -> two rows
    # product 2: expired promo -> full price; global promo never changes the catalog
    # product 4: no category -> dropped
    assert got == [(1, D("5.03")), (1, D("9.05")), (2, D("20.00")), (3, D("50.00"))]


def test_best_policy_keeps_one_row(spark):
    got = rows(C.catalog(small_shop(spark), AS_OF, policy="best"), "ProductID", "DiscountedPrice")
    assert got == [(1, D("5.03")), (2, D("20.00")), (3, D("50.00"))]


def test_search_blank_and_raw_price(spark):
    shop = small_shop(spark)
    assert C.search_products(shop, "   ", AS_OF).count() == 0
    assert C.search_products(shop, None, AS_OF).count() == 0
    got = rows(C.search_products(shop, " SHIRT", AS_OF), "ProductID", "DiscountedPrice")
    assert got == [(1, D("5.0250")), (1, D("9.0450"))]
    # category name is searched too
    assert rows(C.search_products(shop, "caps", AS_OF), "ProductID") == [(2,)]


def test_paging_defaults_and_keyset(spark):
    shop = small_shop(spark)
    assert C.page_bounds(None, None) == (0, 52) and C.page_bounds(0, -1) == (0, 52)
    p1 = [r.ProductID for r in C.catalog_page(shop, 1, 2, AS_OF).collect()]
    p2 = [r.ProductID for r in C.catalog_page(shop, 2, 2, AS_OF).collect()]
    assert p1 == [1, 1] and p2 == [2, 3]
    after = [r.ProductID for r in C.catalog_page_after(shop, 1, 52, AS_OF).collect()]
    assert after == [2, 3]


def test_category_page_and_bad_ids(spark):
    shop = small_shop(spark)
    ids = spark.createDataFrame([(1,), (0,), (-5,)], "CategoryID long")
    got = rows(C.category_page(shop, ids, 1, 1, AS_OF), "CategoryID", "ProductID", "RowInCategory")
    assert got == [(1, 1, 1)]


def test_lookups(spark):
    shop = small_shop(spark)
    codes = spark.createDataFrame([("S10",), ("s10",), ("OLD",), ("ALL",)], "Code string")
    assert rows(C.promo_by_code(shop, codes, AS_OF), "Code") == [("ALL",), ("S10",)]
    det = C.product_details(shop, spark.createDataFrame([(1,), (4,)], "ProductID long"), AS_OF).collect()
    assert [(r.ProductID, r.DiscountedPrice) for r in det] == [(1, D("9.05"))]  # promo 1 is first
    assert rows(C.promocodes(shop), "PromoID", "CategoryName")[3] == (4, None)
    assert [r.CategoryName for r in C.categories(shop).collect()] == ["Caps", "Shirts", "Shoes"]
    assert rows(C.search_products_regex(shop, "^b"), "ProductID") == [(2,)]
    assert C.catalog_plain(shop).count() == 3


def test_active_window_exact_instant(spark):
    shop = small_shop(spark)
    later = C.catalog(shop, dt.datetime(2024, 1, 15, 0, 0, 1))
    assert rows(later.filter("ProductID = 1"), "DiscountedPrice") == [(D("5.03"),)]
