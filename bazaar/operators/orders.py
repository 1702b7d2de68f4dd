"""Orders, carts and favorites: J5-J7 joins, A1-A5 aggregations.

Aggregations are written group-first: order lines are reduced by their
key (partial aggregate in every map task, then one shuffle) before any
dimension is joined, so a hot product or order costs one row per map
task in the shuffle, never a third of the table in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import SUM_MONEY, discounted_price_raw, line_total, promo_applies, sum_line_totals
from bazaar.operators.ids import next_ids
from bazaar.operators.users import role_gate
from bazaar.sources.tables import Shop


def _user_filter(df: DataFrame, user_id) -> DataFrame:
    return df if user_id is None else df.filter(F.col("UserID") == F.lit(user_id))


def lines_of(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """The lines of the given orders: a semi join with their ids (broadcast
    when they turn out few, so the lines are filtered where they are read)."""
    return order_items.join(orders.select("OrderID"), "OrderID", "left_semi").select(*order_items.columns)


# A1 -------------------------------------------------------------------------
def top_products(shop: Shop, n: int = 100) -> DataFrame:
    """Best sellers: quantity and revenue per product, top ``n`` by quantity.

    Same answer as grouping by the seven product columns after the join
    (ProductID decides them), but the shuffle carries one narrow row per
    product and map task instead of every order line with its
    description.  Ties on TotalSold are broken by ProductID.
    """
    sold = (shop.order_items
            .groupBy("ProductID")
            .agg(F.sum("Quantity").cast("long").alias("TotalSold"),
                 sum_line_totals("Quantity", "UnitPrice").alias("TotalRevenue")))
    products = shop.named_products.select("ProductID", "ProductName", "Description", "ImageURL",
                                          "Price", "StockQuantity", "CategoryName")
    return (sold.join(products, "ProductID", "inner")
            .select("ProductID", "ProductName", "Description", "ImageURL", "Price",
                    "StockQuantity", "CategoryName", "TotalSold", "TotalRevenue")
            .orderBy(F.col("TotalSold").desc(), F.col("ProductID"))
            .limit(n))


# A2 -------------------------------------------------------------------------
def top_products_keyed(shop: Shop, n: int = 100) -> DataFrame:
    """Document form: group by product, look the product up (lines whose
    product is gone drop out; no category needed), top ``n``."""
    sold = (shop.order_items
            .groupBy("ProductID")
            .agg(F.sum("Quantity").cast("long").alias("totalSold"),
                 sum_line_totals("Quantity", "UnitPrice").alias("totalRevenue")))
    products = shop.products.select("ProductID", F.col("ProductName").alias("productName"),
                                    F.col("CategoryID").alias("categoryId"))
    return (sold.join(products, "ProductID", "inner")
            .select(F.col("ProductID").alias("productId"), "productName", "categoryId",
                    "totalSold", "totalRevenue")
            .orderBy(F.col("totalSold").desc(), F.col("productId"))
            .limit(n))


# A3 -------------------------------------------------------------------------
def order_totals(shop: Shop, user_id=None, gate: bool = True) -> DataFrame:
    """TotalPrice and status per order; orders without lines drop out.

    Lines are summed per OrderID before the join to Orders (a unique
    key), so the join never multiplies rows.  For one user the lines are
    cut down to the user's orders first, so only those are aggregated.
    """
    orders = _user_filter(shop.orders.select("OrderID", "UserID", "StatusID"), user_id)
    if gate:
        orders = role_gate(orders, shop.user_roles, shop.roles, "User")
    lines = shop.order_items if user_id is None else lines_of(shop.order_items, orders)
    totals = lines.groupBy("OrderID").agg(sum_line_totals("Quantity", "UnitPrice").alias("TotalPrice"))
    return (orders.join(totals, "OrderID", "inner")
            .join(shop.order_statuses.select("StatusID", "DisplayName"), "StatusID")
            .select("UserID", "OrderID", "TotalPrice", "DisplayName"))


# J5 -------------------------------------------------------------------------
def favorites(shop: Shop, user_id=None) -> DataFrame:
    """Favorite products of role-User users; duplicate favorites are kept."""
    fav = role_gate(_user_filter(shop.favorites, user_id), shop.user_roles, shop.roles, "User")
    products = shop.named_products.select("ProductID", "ProductName", "Description", "CategoryName",
                                          "Price", "StockQuantity", "ImageURL")
    return (fav.join(products, "ProductID", "inner")
            .select("UserID", "ProductID", "ProductName", "Description", "CategoryName",
                    "Price", "StockQuantity", "ImageURL"))


# J6 -------------------------------------------------------------------------
def cart_items(shop: Shop, user_id=None, cart: DataFrame | None = None) -> DataFrame:
    """Cart lines with product, category, stock and list price."""
    lines = cart if cart is not None else shop.cart_items
    lines = role_gate(_user_filter(lines.select("UserID", "ProductID", "Quantity"), user_id),
                      shop.user_roles, shop.roles, "User")
    products = shop.named_products.select("ProductID", "ProductName", "Description", "CategoryID", "CategoryName",
                                          "Price", "StockQuantity", "ImageURL")
    return (lines.join(products, "ProductID", "inner")
            .select("UserID", "ProductID", "ProductName", "Description", "CategoryID",
                    "CategoryName", "Quantity", "Price", "StockQuantity", "ImageURL"))


def numbered_cart(shop: Shop, cart: DataFrame | None = None, start: int = 0) -> DataFrame:
    """(CartItemID, UserID, ProductID, Quantity): cart lines with an identity of their own (D11), in (user, product) order after ``start``."""
    lines = cart if cart is not None else shop.cart_items
    return next_ids(lines.select("UserID", "ProductID", "Quantity"), ["UserID", "ProductID"], start, "CartItemID").select(
        "CartItemID", "UserID", "ProductID", "Quantity")


# J7 -------------------------------------------------------------------------
def order_details(shop: Shop, user_id=None, order_id=None) -> DataFrame:
    """One row per order line with status, product name and LineTotal."""
    orders = _user_filter(shop.orders.select("OrderID", "UserID", "StatusID"), user_id)
    if order_id is not None:
        orders = orders.filter(F.col("OrderID") == F.lit(order_id))
    orders = role_gate(orders, shop.user_roles, shop.roles, "User")
    statuses = shop.order_statuses.select("StatusID", F.col("DisplayName").alias("Status"))
    return (orders.join(statuses, "StatusID", "inner")
            .join(shop.order_items, "OrderID", "inner")
            .join(shop.products.select("ProductID", "ProductName"), "ProductID", "inner")
            .select("UserID", "OrderID", "Status", "ProductName", "Quantity", "UnitPrice",
                    line_total("Quantity", "UnitPrice").alias("LineTotal")))


# A4 -------------------------------------------------------------------------
def cart_quote_lines(shop: Shop, requests: DataFrame, cart: DataFrame | None = None) -> DataFrame:
    """Per cart line: the price after the chosen promo code (client rule).

    ``requests`` has (UserID, Code): each is a quote of its own over the
    user's whole cart; repeated requests count once, and a user without a
    request is quoted without a code.  The promo is found by exact code
    with no validity test; it applies when global or when its category
    name equals the line's category name.
    """
    lines = cart_items(shop, cart=cart).select("UserID", "ProductID", "ProductName", "CategoryName",
                                              "Quantity", "Price")
    promos = (shop.promocodes.join(shop.categories, "CategoryID", "left")
              .select("Code", "DiscountPercent", "IsGlobal",
                      F.col("CategoryName").alias("PromoCategoryName")))
    chosen = requests.select("UserID", "Code").distinct().join(promos, "Code", "left")
    applies = F.col("DiscountPercent").isNotNull() & promo_applies(
        "IsGlobal", "PromoCategoryName", "CategoryName")
    unit = F.when(applies, discounted_price_raw("Price", "DiscountPercent")).otherwise(
        F.col("Price").cast(T.DecimalType(14, 4)))
    return (lines.join(chosen, "UserID", "left")
            .select("UserID", "Code", "ProductID", "ProductName", "Quantity", "Price",
                    unit.alias("ItemPrice"), applies.alias("hasDiscount")))


def cart_quote(shop: Shop, requests: DataFrame, cart: DataFrame | None = None) -> DataFrame:
    """Cart total per user and chosen code after the promo, rounded to cents at the end."""
    lines = cart_quote_lines(shop, requests, cart)
    amount = (F.col("ItemPrice") * F.col("Quantity").cast(T.DecimalType(10, 0)))
    return (lines.groupBy("UserID", "Code")
            .agg(F.round(F.sum(amount), 2).cast(SUM_MONEY).alias("Total"),
                 F.count(F.lit(1)).alias("Lines"),
                 F.sum(F.col("hasDiscount").cast("int")).cast("long").alias("DiscountedLines")))


# A5 -------------------------------------------------------------------------
def cart_shortages(shop: Shop, cart: DataFrame | None = None) -> DataFrame:
    """Users whose cart has lines above stock (missing stock counts as 0),
    with the short product names joined by ', ' in name order."""
    lines = cart_items(shop, cart=cart)
    short = lines.filter(F.coalesce(F.col("StockQuantity"), F.lit(0)) < F.col("Quantity"))
    return (short.groupBy("UserID")
            .agg(F.count(F.lit(1)).alias("ShortLines"),
                 F.concat_ws(", ", F.sort_array(F.collect_list("ProductName"))).alias("ShortProducts")))

