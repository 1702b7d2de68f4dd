"""A small hand-made shop for rule tests."""
import datetime as dt
from decimal import Decimal as D

from bazaar.sources import tables as Tb


def small_shop(spark, products=None, promos=None, order_items=None, orders=None, cart=None,
               favorites=None, users=None, user_roles=None, cart_events=None):
    cats = spark.createDataFrame([(1, "Shirts"), (2, "Caps"), (3, "Shoes")], Tb.CATEGORIES)
    prods = spark.createDataFrame(products or [
        (1, "Red Shirt", "cotton", 1, D("10.05"), 5, "C:\\img\\images\\1.jpg"),
        (2, "Blue Cap", "wool", 2, D("20.00"), 0, None),
        (3, "Shoe", "leather", 3, D("50.00"), 2, None),
        (4, "Lost", "no category", None, D("1.00"), 9, None),
    ], Tb.PRODUCTS)
    pr = spark.createDataFrame(promos or [
        (1, "S10", 10, False, 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15)),
        (2, "S50", 50, False, 1, dt.datetime(2024, 1, 15), dt.datetime(2024, 2, 1)),
        (3, "OLD", 30, False, 2, dt.datetime(2023, 1, 1), dt.datetime(2023, 2, 1)),
        (4, "ALL", 20, True, None, dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)),
    ], Tb.PROMOCODES)
    us = spark.createDataFrame(users or [(10, "ann", None, "ann@x"), (11, "bob", None, "bob@x"),
                                         (12, "eve", None, "eve@x")], Tb.USERS)
    ur = spark.createDataFrame(user_roles or [(10, 2), (11, 2), (11, 1), (12, 1)], Tb.USER_ROLES)
    oi = spark.createDataFrame(order_items or [
        (100, 1, 2, D("10.00")), (100, 2, 1, D("20.00")), (101, 1, 3, D("9.00")), (102, 4, 50, D("1.00")),
    ], Tb.ORDER_ITEMS)
    od = spark.createDataFrame(orders or [(100, 10, None, 1), (101, 11, 1, 1), (103, 10, None, 1)], Tb.ORDERS)
    tables = {"categories": cats, "products": prods, "promocodes": pr, "users": us, "user_roles": ur,
              "order_items": oi, "orders": od,
              "favorites": spark.createDataFrame(favorites or [(10, 1), (10, 1), (11, 3), (12, 2)], Tb.FAVORITES)}
    if cart is not None:
        tables["cart_items"] = spark.createDataFrame(cart, Tb.CART_ITEMS)
    if cart_events is not None:
        tables["cart_events"] = spark.createDataFrame(cart_events, Tb.CART_EVENTS)
    return Tb.shop_from_tables(spark, tables)
