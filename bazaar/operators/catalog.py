"""Catalog reads: J1-J4, J8, J9, J12, J14-J16 and paging L1-L4, L6.

Promo pricing is a left join of products to the promos active at
``as_of`` on CategoryID.  The active-promo filter runs before the join
(it touches only promo columns), and the promo side is broadcast after a
bounded size check.  Two active promos for one category give two rows
per product (``promo_policy="all"``, the shop's behaviour); ``"best"``
keeps the largest discount only.

Single-key calls of the shop (one product, one category, one code) take
a key DataFrame instead and become semi joins, so one plan answers any
number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.exprs import (discounted_price, discounted_price_raw, display_price, keyword_match,
                                    keyword_pattern, promo_active, promo_active_open, regex_match,
                                    stock_label)
from bazaar.operators.interval import interval_join
from bazaar.sources.tables import Shop

DEFAULT_PAGE_SIZE = 52

CATALOG_COLS = ["ProductID", "ProductName", "Description", "CategoryName", "Price",
                 "DiscountedPrice", "StockQuantity", "ImageURL"]
DETAIL_COLS = ["ProductID", "ProductName", "Description", "CategoryID", "CategoryName", "Price",
                "DiscountedPrice", "StockQuantity", "ImageURL"]


def active_promos(promocodes: DataFrame, as_of, policy: str = "all") -> DataFrame:
    """Category promos active at ``as_of`` (global ones have no category
    and so never join a product)."""
    act = (promocodes.filter(promo_active("ValidFrom", "ValidTo", as_of))
           .select("CategoryID", "PromoID", "DiscountPercent"))
    if policy == "all":
        return act
    if policy == "best":
        return (act.groupBy("CategoryID")
                .agg(F.max_by("PromoID", F.struct("DiscountPercent", F.col("PromoID"))).alias("PromoID"),
                     F.max("DiscountPercent").alias("DiscountPercent")))
    raise ValueError(f"unknown promo policy {policy!r}")


def priced_products(shop: Shop, as_of, policy: str = "all", products: DataFrame | None = None,
                    raw: bool = False) -> DataFrame:
    """Products with category name, promo id and discounted price.

    A product without category drops out; left join to the active promos
    of its category.  ``products``: some of ``shop.named_products``.
    """
    prods = products if products is not None else shop.named_products
    # Promo tables are small and file- or literal-backed, so Spark's own
    # size estimate (autoBroadcastJoinThreshold) decides the broadcast.
    promos = active_promos(shop.promocodes, as_of, policy)
    price = (discounted_price_raw if raw else discounted_price)("Price", "DiscountPercent")
    return (prods.join(promos, "CategoryID", "left")
            .withColumn("DiscountedPrice", price))


# J1 -------------------------------------------------------------------------
def catalog(shop: Shop, as_of, policy: str = "all") -> DataFrame:
    return priced_products(shop, as_of, policy).select(*CATALOG_COLS)


def catalog_at(shop: Shop, views: DataFrame, at: str = "ts", raw: bool = False) -> DataFrame:
    """Each row of ``views`` (a ``ProductID`` and a moment ``at``) with the product as the catalog showed it then.

    The rule of J1 at the row's own time: one row per category promo active
    at that moment, or the list price without a promo.  Products without
    category and unknown products give no row.  The promos are met by (category, moment) once
    however many rows ask for it.
    """
    named = shop.named_products.select("ProductID", "ProductName", "CategoryID", "CategoryName", "Price")
    seen = views.join(named, "ProductID")
    moments = seen.select("CategoryID", at).distinct()
    spans = shop.promocodes.where("CategoryID is not null").select("CategoryID", "PromoID", "DiscountPercent", "ValidFrom", "ValidTo")
    active = interval_join(moments, spans, ["CategoryID"], at, "ValidFrom", "ValidTo").drop("ValidFrom", "ValidTo")
    price = (discounted_price_raw if raw else discounted_price)("Price", "DiscountPercent")
    return seen.join(active, ["CategoryID", at], "left").withColumn("DiscountedPrice", price)


# J2 -------------------------------------------------------------------------
def product_details(shop: Shop, product_ids: DataFrame, as_of, first_only: bool = True) -> DataFrame:
    """Details of the requested products (a ProductID frame).

    The shop's API keeps the first row of a fanned-out product; with
    ``first_only`` that is the row of the lowest promo id (no promo
    first), picked by a ``min_by`` aggregate rather than a window.
    """
    wanted = shop.named_products.join(product_ids.select("ProductID"), "ProductID", "left_semi")
    rows = priced_products(shop, as_of, products=wanted)
    if not first_only:
        return rows.select(*DETAIL_COLS)
    order = F.struct(F.col("PromoID").isNotNull().alias("has_promo"), F.col("PromoID"))
    rest = [c for c in DETAIL_COLS if c != "ProductID"]
    return (rows.groupBy("ProductID")
            .agg(F.min_by(F.struct(*rest), order).alias("d"))
            .select("ProductID", *[F.col(f"d.{c}").alias(c) for c in rest]))


# J3 -------------------------------------------------------------------------
def catalog_by_category(shop: Shop, category_ids: DataFrame, as_of) -> DataFrame:
    """Priced products of the requested categories (CategoryID frame);
    the category filter is applied to products before any join."""
    wanted = shop.named_products.join(category_ids.select("CategoryID").distinct(), "CategoryID", "left_semi")
    return priced_products(shop, as_of, products=wanted).select(
        "CategoryID", *CATALOG_COLS)


# J4 -------------------------------------------------------------------------
def search_products(shop: Shop, keyword: str | None, as_of, escape: bool = False) -> DataFrame:
    """Keyword search over name, description and category name, with the
    unrounded promo price.  A blank keyword gives an empty result."""
    if keyword_pattern(keyword, escape) is None:
        return priced_products(shop, as_of, raw=True).select(*CATALOG_COLS).limit(0)
    rows = priced_products(shop, as_of, raw=True)
    return (rows.filter(keyword_match(["ProductName", "Description", "CategoryName"], keyword, escape))
            .select(*CATALOG_COLS))


# J8 -------------------------------------------------------------------------
def promocodes(shop: Shop) -> DataFrame:
    """All promos with their category name (global ones: null name)."""
    return (shop.promocodes.join(shop.categories, "CategoryID", "left")
            .select("PromoID", "Code", "DiscountPercent", "IsGlobal", "CategoryName",
                    "ValidFrom", "ValidTo"))


def promo_choices(shop: Shop, as_of) -> DataFrame:
    """The client's promo list: J8 filtered by the open-bound validity
    test (F4), where a missing bound does not exclude a promo."""
    return promocodes(shop).filter(promo_active_open("ValidFrom", "ValidTo", as_of))


def product_cards(shop: Shop, as_of, policy: str = "all") -> DataFrame:
    """What a product card shows: the price to pay (F11: discounted price
    when there is one, else the list price) and the stock label (F10)."""
    rows = priced_products(shop, as_of, policy)
    return rows.select("ProductID", "ProductName", "CategoryName", "StockQuantity",
                       display_price("DiscountedPrice", "Price").alias("ShownPrice"),
                       stock_label("StockQuantity").alias("StockLabel"))


# J9 -------------------------------------------------------------------------
def promo_by_code(shop: Shop, requests: DataFrame, as_of) -> DataFrame:
    """Each request row (with a ``Code`` column) that names a promo active
    at ``as_of``, with its PromoID and percent; exact, case-sensitive
    match.  Unknown or inactive codes give no row, as the shop's lookup.
    With ``as_of=None`` a promo must be active at the request's own
    ``request_ts``."""
    if as_of is None:
        promos = shop.promocodes.select("Code", "PromoID", "DiscountPercent", "ValidFrom", "ValidTo")
        return interval_join(requests, promos, ["Code"], "request_ts", "ValidFrom", "ValidTo").drop("ValidFrom", "ValidTo")
    act = (shop.promocodes.filter(promo_active("ValidFrom", "ValidTo", as_of))
           .select("Code", "PromoID", "DiscountPercent"))
    return requests.join(act, "Code", "inner")


# J12 ------------------------------------------------------------------------
def category_id_by_name(shop: Shop, names: DataFrame) -> DataFrame:
    return (shop.categories.join(names.select("CategoryName").distinct(), "CategoryName", "left_semi")
            .select("CategoryName", "CategoryID"))


# J14 ------------------------------------------------------------------------
def catalog_plain(shop: Shop) -> DataFrame:
    """Products with their category name, no price rule."""
    return shop.named_products.select("ProductID", "ProductName", "Description", "CategoryName", "Price",
                                      "StockQuantity", "ImageURL")


# J15 ------------------------------------------------------------------------
def products_by_category(shop: Shop, category_ids: DataFrame) -> DataFrame:
    """Scan + filter, no join to Categories (document form)."""
    return shop.products.join(category_ids.select("CategoryID").distinct(), "CategoryID", "left_semi")


# J16 ------------------------------------------------------------------------
def search_products_regex(shop: Shop, keyword: str) -> DataFrame:
    """Case-insensitive regular expression on the product name only."""
    return shop.products.filter(regex_match("ProductName", keyword))


# Paging ---------------------------------------------------------------------
def page_bounds(page, size) -> tuple[int, int]:
    """Null or < 1 page -> 1; null or < 1 size -> 52 (shop defaults)."""
    p = page if isinstance(page, int) and page >= 1 else 1
    s = size if isinstance(size, int) and size >= 1 else DEFAULT_PAGE_SIZE
    return (p - 1) * s, s


def _page_order():
    return [F.col("ProductID").asc(), F.col("PromoID").asc_nulls_first()]


# L1 -------------------------------------------------------------------------
def catalog_page(shop: Shop, page, size, as_of) -> DataFrame:
    """Catalog slice ordered by ProductID (PromoID breaks fan-out ties).

    ``orderBy().offset().limit()`` plans as a per-partition top-k plus a
    merge of at most (offset + size) rows per partition; for deep pages
    use ``catalog_page_after``.
    """
    start, n = page_bounds(page, size)
    return (priced_products(shop, as_of).orderBy(*_page_order())
            .offset(start).limit(n).select(*DETAIL_COLS))


def catalog_page_after(shop: Shop, last_product_id, size, as_of) -> DataFrame:
    """Keyset paging: the next ``size`` rows after ``last_product_id``;
    the filter is pushed into the parquet scan, so depth costs nothing."""
    _, n = page_bounds(1, size)
    prods = shop.named_products if last_product_id is None else shop.named_products.filter(
        F.col("ProductID") > F.lit(last_product_id))
    return (priced_products(shop, as_of, products=prods).orderBy(*_page_order())
            .limit(n).select(*DETAIL_COLS))


# L2 -------------------------------------------------------------------------
def search_page(shop: Shop, keyword: str | None, page, size, as_of) -> DataFrame:
    start, n = page_bounds(page, size)
    if keyword_pattern(keyword) is None:
        return priced_products(shop, as_of, raw=True).select(*CATALOG_COLS).limit(0)
    rows = priced_products(shop, as_of, raw=True).filter(
        keyword_match(["ProductName", "Description", "CategoryName"], keyword))
    return rows.orderBy(*_page_order()).offset(start).limit(n).select(*CATALOG_COLS)


# L3 -------------------------------------------------------------------------
def category_page(shop: Shop, category_ids: DataFrame, page, size, as_of) -> DataFrame:
    """The same page of every requested category.

    ``row_number() <= offset + size`` lets Spark trim each category to
    that many rows inside every map task (window group limit) before the
    shuffle, so a category holding a third of the products is never
    sorted whole in one task.  Ids that are not positive give nothing.
    """
    start, n = page_bounds(page, size)
    ids = category_ids.select("CategoryID").filter(F.col("CategoryID") > 0).distinct()
    wanted = shop.named_products.join(ids, "CategoryID", "left_semi")
    rows = priced_products(shop, as_of, products=wanted)
    rn = F.row_number().over(Window.partitionBy("CategoryID").orderBy(*_page_order()))
    return (rows.withColumn("rn", rn)
            .filter(F.col("rn") <= start + n)
            .filter(F.col("rn") > start)
            .select("CategoryID", *CATALOG_COLS, F.col("rn").cast("long").alias("RowInCategory")))


# L4 -------------------------------------------------------------------------
def categories(shop: Shop) -> DataFrame:
    return shop.categories.select("CategoryID", "CategoryName").orderBy("CategoryName")


# L6 -------------------------------------------------------------------------
def products_by_category_order(shop: Shop) -> DataFrame:
    """Full scan sorted by CategoryID (ProductID breaks ties, so a large
    category is spread over several range partitions)."""
    return shop.products.orderBy("CategoryID", "ProductID")
