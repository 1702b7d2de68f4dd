"""Nested (document) reads N1-N5, built from ``lookup`` / ``unwind``.

One-to-many lookups group the many side by its key first (partial
``collect_list`` per map task, one shuffle) and left-join the result on
a unique key.  One-to-one lookups (a favorite's product, a cart line's
product) are plain joins that wrap the matched row in a struct; grouping
the product table for them would shuffle it for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.orders import lines_of
from bazaar.operators.joins import lookup, unwind
from bazaar.sources.tables import Shop

ITEM_FIELDS = ["ProductID", "Quantity", "UnitPrice"]
PRODUCT_FIELDS = ["ProductID", "ProductName", "Description", "CategoryID", "Price",
                  "StockQuantity", "ImageURL"]


def _orders(shop: Shop, user_id=None, order_id=None) -> DataFrame:
    o = shop.orders.select("OrderID", "UserID", "PromoID", "StatusID")
    if user_id is not None:
        o = o.filter(F.col("UserID") == F.lit(user_id))
    if order_id is not None:
        o = o.filter(F.col("OrderID") == F.lit(order_id))
    return o


# N1 -------------------------------------------------------------------------
def orders_nested(shop: Shop, user_id=None, split_docs: int | None = None) -> DataFrame:
    """Each order with its ``items`` array; an order with no line keeps [].
    For one user only the lines of the user's orders are grouped."""
    orders = _orders(shop, user_id)
    lines = shop.order_items if user_id is None else lines_of(shop.order_items, orders)
    return lookup(orders, lines, "OrderID", "OrderID", "items", fields=ITEM_FIELDS, split_docs=split_docs)


# N2 -------------------------------------------------------------------------
def order_document(shop: Shop, user_id=None, order_id=None) -> DataFrame:
    """N1 plus ``products``: each product named by any item, once.  For one
    user or order only the lines of those orders are grouped."""
    orders = _orders(shop, user_id, order_id)
    lines = lines_of(shop.order_items, orders) if user_id is not None or order_id is not None else shop.order_items
    named = (lines.select("OrderID", "ProductID").distinct()
             .join(shop.products.select(*PRODUCT_FIELDS), "ProductID", "inner"))
    order_cols = [c for c in orders.columns if c != "OrderID"]
    parts = {"order": (orders, order_cols), "items": (lines, ITEM_FIELDS), "products": (named, PRODUCT_FIELDS)}
    types = {k: df.select(F.struct(*cols).alias(k)).schema[k].dataType for k, (df, cols) in parts.items()}
    rows = None
    for name, (df, cols) in parts.items():
        one = df.where("OrderID is not null").select("OrderID", *[
            F.struct(*cols).alias(k) if k == name else F.lit(None).cast(types[k]).alias(k) for k in parts])
        rows = one if rows is None else rows.unionByName(one)
    # one grouping for all three: arrays that are joined on instead are sorted and held a second and third time in a task
    docs = rows.groupBy("OrderID").agg(F.collect_list("order").alias("orders"), F.sort_array(F.collect_list("items")).alias("items"),
                                       F.sort_array(F.collect_list("products")).alias("products"))
    found = docs.select("OrderID", F.explode("orders").alias("order"), "items", "products")
    keyless = orders.where("OrderID is null").select("OrderID", *order_cols, *[
        F.array().cast(docs.schema[k].dataType).alias(k) for k in ("items", "products")])
    return found.select("OrderID", "order.*", "items", "products").unionByName(keyless)


# N3 -------------------------------------------------------------------------
def favorites_nested(shop: Shop, user_id=None) -> DataFrame:
    """Each favorite with its ``product`` document; favorites whose
    product is gone drop out (``$unwind`` of an empty lookup)."""
    fav = shop.favorites.select("UserID", "ProductID")
    if user_id is not None:
        fav = fav.filter(F.col("UserID") == F.lit(user_id))
    prod = shop.products.select(F.col("ProductID").alias("__pid"),
                                F.struct(*PRODUCT_FIELDS).alias("product"))
    return (fav.join(prod, fav["ProductID"] == prod["__pid"], "inner")
            .select("UserID", "ProductID", "product"))


# N4 -------------------------------------------------------------------------
def cart_nested(shop: Shop, user_id=None, cart: DataFrame | None = None) -> DataFrame:
    """Each cart line with its ``product`` document."""
    lines = (cart if cart is not None else shop.cart_items).select("UserID", "ProductID", "Quantity")
    if user_id is not None:
        lines = lines.filter(F.col("UserID") == F.lit(user_id))
    prod = shop.products.select(F.col("ProductID").alias("__pid"),
                                F.struct(*PRODUCT_FIELDS).alias("product"))
    return (lines.join(prod, lines["ProductID"] == prod["__pid"], "inner")
            .select("UserID", "ProductID", "Quantity", "product"))


# N5 -------------------------------------------------------------------------
def users_nested(shop: Shop, username: str | None = None) -> DataFrame:
    """Each user with a ``roles`` array (RoleID, RoleName); [] when none."""
    users = shop.users.select("UserID", "Username", "Email")
    if username is not None:
        users = users.filter(F.col("Username") == F.lit(username))
    roles = shop.user_roles.join(shop.roles, "RoleID", "inner").select("UserID", "RoleID", "RoleName")
    return lookup(users, roles, "UserID", "UserID", "roles", fields=["RoleID", "RoleName"])


def orders_nested_split_lines(shop: Shop, parts: int = 4) -> DataFrame:
    """N1 with ``split_docs=parts`` unwound back to lines: the check that
    spreading a hot order over several documents keeps every line once."""
    docs = orders_nested(shop, split_docs=parts)
    return unwind(docs, "items").select("OrderID", "UserID",
                                        F.col("items.ProductID").alias("ProductID"),
                                        F.col("items.Quantity").alias("Quantity"),
                                        F.col("items.UnitPrice").alias("UnitPrice"))


# N6 (flat view) -------------------------------------------------------------
def orders_unwound(shop: Shop) -> DataFrame:
    """N1 unwound again, keeping orders without items (null item)."""
    return (unwind(orders_nested(shop), "items", keep_empty=True)
            .select("OrderID", "UserID",
                    F.col("items.ProductID").alias("ProductID"),
                    F.col("items.Quantity").alias("Quantity"),
                    F.col("items.UnitPrice").alias("UnitPrice")))
