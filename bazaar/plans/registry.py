"""Named queries over the driver's tables: each takes (spark, sf_dir) and
returns a lazy DataFrame over the whole tables.  ``oracle.py`` holds the
DuckDB SQL twin of each one under the same name and column names."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import as_timestamp
from bazaar.operators import orders as O
from bazaar.plans.presentation import DOUBLE_COLS, TEXT_COLS
from bazaar.sources.tables import load_shop, read_table, shop_from_tables

Query = Callable[[SparkSession, str], DataFrame]


def present(name: str, df: DataFrame) -> DataFrame:
    """Presentation step of a registered query: the columns listed in
    ``presentation.DOUBLE_COLS`` leave as double and those in ``TEXT_COLS``
    as text (the SQL twin does the same).  All money arithmetic before this point is exact decimal."""
    wanted = set(DOUBLE_COLS.get(name, []))
    undeclared = [f.name for f in df.schema.fields
                  if isinstance(f.dataType, T.DecimalType) and f.name not in wanted]
    if undeclared:
        raise ValueError(f"{name}: decimal columns {undeclared} missing from DOUBLE_COLS")
    text = set(TEXT_COLS.get(name, []))
    return df.select(*[F.col(c).cast("double" if c in wanted else "string").alias(c) if c in wanted | text else F.col(c)
                       for c in df.columns])


def presented(queries: dict[str, Query]) -> dict[str, Query]:
    """The registered queries as handed to a caller's session: time zone
    pinned to UTC (the shop's timestamps are UTC wall-clock values, as in
    the SQL twins), then ``present``."""
    def wrap(name, fn):
        def run(spark, d):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(name, fn(spark, d))
        return run
    return {name: wrap(name, fn) for name, fn in queries.items()}


def _q_top_products(spark, d):
    return O.top_products(load_shop(spark, d), 100)


def _q_top_products_keyed(spark, d):
    return O.top_products_keyed(load_shop(spark, d), 100)


def _q_order_totals(spark, d):
    return O.order_totals(load_shop(spark, d))


def _q_favorites(spark, d):
    return O.favorites(load_shop(spark, d))


def _q_order_details(spark, d):
    return O.order_details(load_shop(spark, d))


def _q_fold_cart_events(spark, d):
    return load_shop(spark, d).cart_items


def _q_fold_cart_events_doc(spark, d):
    from bazaar.operators.writes import fold_cart_events_document
    shop = load_shop(spark, d)
    return fold_cart_events_document(shop.cart_events, shop.user_roles, shop.roles).items


def _q_cart_items(spark, d):
    return O.cart_items(load_shop(spark, d))


def quote_requests(shop) -> DataFrame:
    """One quote request per cart owner: the code of promo UserID % 9
    (0 means no code), the same pick as the checkout requests; every fifth
    user tries the code ALL20 as well."""
    users = shop.cart_items.select("UserID").distinct()
    promo_id = F.when(F.col("UserID") % 9 == 0, F.lit(None)).otherwise(F.col("UserID") % 9)
    first = (users.withColumn("PromoID", promo_id.cast("long"))
             .join(shop.promocodes.select("PromoID", "Code"), "PromoID", "left")
             .select("UserID", "Code"))
    return first.unionByName(users.filter("UserID % 5 = 0").select("UserID", F.lit("ALL20").alias("Code")))


def _q_cart_quote(spark, d):
    shop = load_shop(spark, d)
    return O.cart_quote(shop, quote_requests(shop))


def _q_cart_quote_lines(spark, d):
    shop = load_shop(spark, d)
    return O.cart_quote_lines(shop, quote_requests(shop))


def _q_cart_shortages(spark, d):
    return O.cart_shortages(load_shop(spark, d))


QUERIES: dict[str, Query] = {
    "top_products": _q_top_products,
    "top_products_keyed": _q_top_products_keyed,
    "order_totals": _q_order_totals,
    "favorites": _q_favorites,
    "order_details": _q_order_details,
    "fold_cart_events": _q_fold_cart_events,
    "fold_cart_events_doc": _q_fold_cart_events_doc,
    "cart_items": _q_cart_items,
    "cart_quote": _q_cart_quote,
    "cart_quote_lines": _q_cart_quote_lines,
    "cart_shortages": _q_cart_shortages,
    "cart_items_numbered": lambda spark, d: O.numbered_cart(load_shop(spark, d)),
}


# Catalog ----------------------------------------------------------------------
from bazaar.operators import catalog as C  # noqa: E402
from bazaar.operators import pages as P  # noqa: E402
from bazaar.operators import search as S  # noqa: E402
from bazaar.operators import snapshots as Sn  # noqa: E402
from bazaar.operators import users as U  # noqa: E402
from bazaar.sources.tables import AS_OF  # noqa: E402

SEARCH_KEYWORD = " Small "     # trimmed and lowercased by the operator
REGEX_KEYWORD = "^red"
CATALOG_PAGE = 10
SEARCH_PAGE = 2
CATEGORY_PAGE = 2


def _q_catalog(spark, d):
    return C.catalog(load_shop(spark, d), AS_OF)


def _q_catalog_best(spark, d):
    return C.catalog(load_shop(spark, d), AS_OF, policy="best")


def _q_product_details(spark, d):
    shop = load_shop(spark, d)
    return C.product_details(shop, shop.products.select("ProductID"), AS_OF)


def _q_catalog_by_category(spark, d):
    shop = load_shop(spark, d)
    return C.catalog_by_category(shop, shop.categories, AS_OF)


def _q_search_products(spark, d):
    return C.search_products(load_shop(spark, d), SEARCH_KEYWORD, AS_OF)


#: Keywords with wildcards, classes, no match and nothing but blanks (fixed values).
SEARCH_PATTERNS = ["sm_ll", "%tin", "no such thing", "  ", "x", "[a-c]rass", "pol%steel", "_", " SIZE 1[0-2] ", "zz", "[oops", "a"]


def search_keywords(spark, d) -> DataFrame:
    """Every word of the category names, every nation's name, and the fixed patterns."""
    words = load_shop(spark, d).categories.select(F.explode(F.split("CategoryName", " ")).alias("Keyword"))
    names = read_table(spark, d, "nation").select(F.col("n_name").alias("Keyword"))
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in SEARCH_PATTERNS])).alias("Keyword"))
    return words.unionByName(names).unionByName(fixed)


def _q_search_many(spark, d):
    return S.search_many(load_shop(spark, d), search_keywords(spark, d), AS_OF)


def _batch_shop(spark, d):
    """The shop with its promo table after the events-driven promo batch."""
    shop = load_shop(spark, d)
    return load_shop(spark, d, promocodes=new_promocodes(spark, d, shop))


def _q_promocodes(spark, d):
    return C.promocodes(_batch_shop(spark, d))


# The codes customers type in the code requests (two unknown, one wrong case).
REQUESTED_CODES = ["ECO10", "LARGE25", "MED15", "MED33", "OLD50", "ALL20", "ZERO", "SOON30", "eco10", "NOPE"]


def code_requests(spark, d) -> DataFrame:
    """One promo-code lookup per event row."""
    ev = read_table(spark, d, "events")
    code = F.element_at(F.array(*[F.lit(c) for c in REQUESTED_CODES]),
                        (F.col("event_id") % len(REQUESTED_CODES) + 1).cast("int"))
    return ev.select("event_id", code.alias("Code"), F.col("ts").alias("request_ts"))


def _q_promo_by_code(spark, d):
    return C.promo_by_code(_batch_shop(spark, d), code_requests(spark, d).drop("request_ts"), AS_OF)


def _q_promo_by_code_at_request(spark, d):
    """The lookups of ``promo_by_code``, each at the time of its event."""
    return C.promo_by_code(_batch_shop(spark, d), code_requests(spark, d), None).select("event_id", "Code", "PromoID", "DiscountPercent")


def _q_catalog_at_view(spark, d):
    """Every viewed product with its price at the time of the view."""
    ev = read_table(spark, d, "events").filter(F.col("event_type") == "view")
    views = ev.select("event_id", "ts", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("ProductID"))
    return C.catalog_at(load_shop(spark, d), views).select("event_id", "ProductID", "CategoryName", "Price",
                                                           F.col("PromoID").cast("string").alias("PromoID"), "DiscountedPrice")


def _q_category_id_by_name(spark, d):
    shop = load_shop(spark, d)
    return C.category_id_by_name(shop, shop.categories.select("CategoryName"))


def _q_catalog_plain(spark, d):
    return C.catalog_plain(load_shop(spark, d))


def _q_products_by_category(spark, d):
    shop = load_shop(spark, d)
    return C.products_by_category(shop, shop.categories)


def _q_search_products_regex(spark, d):
    return C.search_products_regex(load_shop(spark, d), REGEX_KEYWORD)


def _q_catalog_page(spark, d):
    return C.catalog_page(load_shop(spark, d), CATALOG_PAGE, 52, AS_OF)


def _q_catalog_page_directory(spark, d, page):
    """A page of the catalog from its page directory; 0 means the last page."""
    book = P.write_pages(C.priced_products(load_shop(spark, d), AS_OF), ["ProductID", "PromoID"], AS.stream_root(spark, "pages"))
    return P.read_page(book, page if page else P.last_page(book, 52), 52).select(*C.DETAIL_COLS)


def _q_search_page(spark, d):
    return C.search_page(load_shop(spark, d), SEARCH_KEYWORD, SEARCH_PAGE, 52, AS_OF)


def _q_category_page(spark, d):
    shop = load_shop(spark, d)
    return C.category_page(shop, shop.categories, CATEGORY_PAGE, 52, AS_OF)


def _q_categories(spark, d):
    return C.categories(load_shop(spark, d))


def _q_products_by_category_order(spark, d):
    return C.products_by_category_order(load_shop(spark, d))


def _q_user_roles(spark, d):
    shop = load_shop(spark, d)
    return U.user_roles(shop.users, shop.user_roles, shop.roles)


def _q_users_with_role(spark, d):
    shop = load_shop(spark, d)
    return U.users_with_role(shop.user_roles, shop.roles, "User")


def _q_primary_role(spark, d):
    shop = load_shop(spark, d)
    return U.primary_role(U.user_roles(shop.users, shop.user_roles, shop.roles))


QUERIES.update({
    "catalog": _q_catalog,
    "catalog_best": _q_catalog_best,
    "product_details": _q_product_details,
    "catalog_by_category": _q_catalog_by_category,
    "search_products": _q_search_products,
    "search_many": _q_search_many,
    "promocodes": _q_promocodes,
    "promo_by_code": _q_promo_by_code,
    "promo_by_code_at_request": _q_promo_by_code_at_request,
    "catalog_at_view": _q_catalog_at_view,
    "category_id_by_name": _q_category_id_by_name,
    "catalog_plain": _q_catalog_plain,
    "products_by_category": _q_products_by_category,
    "search_products_regex": _q_search_products_regex,
    "catalog_page": _q_catalog_page,
    "catalog_page_directory": lambda spark, d: _q_catalog_page_directory(spark, d, 10),
    "catalog_page_directory_last": lambda spark, d: _q_catalog_page_directory(spark, d, 0),
    "search_page": _q_search_page,
    "category_page": _q_category_page,
    "categories": _q_categories,
    "products_by_category_order": _q_products_by_category_order,
    "user_roles": _q_user_roles,
    "users_with_role": _q_users_with_role,
    "primary_role": _q_primary_role,
})


# Nested documents ---------------------------------------------------------------
from bazaar.operators import nested as N  # noqa: E402


def _q_orders_nested(spark, d):
    return N.orders_nested(load_shop(spark, d))


def _q_order_document(spark, d):
    return N.order_document(load_shop(spark, d))


def _q_favorites_nested(spark, d):
    return N.favorites_nested(load_shop(spark, d))


def _q_cart_nested(spark, d):
    return N.cart_nested(load_shop(spark, d))


def _q_users_nested(spark, d):
    return N.users_nested(load_shop(spark, d))


def _q_orders_nested_split_lines(spark, d):
    return N.orders_nested_split_lines(load_shop(spark, d), 4)


def _q_orders_unwound(spark, d):
    return N.orders_unwound(load_shop(spark, d))


QUERIES.update({
    "orders_nested": _q_orders_nested,
    "order_document": _q_order_document,
    "favorites_nested": _q_favorites_nested,
    "cart_nested": _q_cart_nested,
    "users_nested": _q_users_nested,
    "orders_unwound": _q_orders_unwound,
    "orders_nested_split_lines": _q_orders_nested_split_lines,
})


# Checkout -----------------------------------------------------------------------
from bazaar.operators import checkout as K  # noqa: E402


def checkout_requests(shop) -> DataFrame:
    """One checkout request per user seen in the cart events: promo
    UserID % 9 (0 means none), requested at AS_OF + UserID seconds.
    Users without the User role or with an empty cart are included on
    purpose, so every reject reason is exercised."""
    users = shop.cart_events.select("UserID").distinct()
    promo_id = F.when(F.col("UserID") % 9 == 0, F.lit(None)).otherwise(F.col("UserID") % 9)
    ts = F.timestamp_seconds(F.unix_timestamp(as_timestamp(AS_OF)) + F.col("UserID"))
    return users.select("UserID", promo_id.cast("long").alias("PromoID"), ts.alias("request_ts"))


def _outputs(res):
    """A checkout whose outputs recompute the shared lines instead of leaving them persisted."""
    res.release()
    return res


def _checkout(spark, d, **how):
    """Whole carts by the shop's own rule: lines of zero or less pass, and raise the stock."""
    shop = load_shop(spark, d)
    return _outputs(K.checkout(shop, checkout_requests(shop), AS_OF, **({"strict": False} | how)))


def _checkout_at_request(spark, d):
    """The checkout requests spread over the 30 days around AS_OF, each under the promos of its own time."""
    shop = load_shop(spark, d)
    day = F.expr("make_dt_interval(cast(UserID % 30 as int) - 15)")
    req = checkout_requests(shop).withColumn("request_ts", F.col("request_ts") + day)
    return _outputs(K.checkout(shop, req, None, strict=False))


def _checkout_repeats(spark, d):
    """One request per cart event: all but the first of a user are repeats."""
    shop = load_shop(spark, d)
    req = shop.cart_events.select("UserID", (F.col("event_id") % 3).alias("PromoID"), F.date_trunc("day", "ts").alias("request_ts"))
    return _outputs(K.checkout(shop, req, AS_OF))


def _checkout_simple(spark, d):
    shop = load_shop(spark, d)
    return K.checkout_simple(shop, checkout_requests(shop))


QUERIES.update({
    "checkout_orders": lambda spark, d: _checkout(spark, d).orders,
    "checkout_order_items": lambda spark, d: _checkout(spark, d).order_items,
    "checkout_stock": lambda spark, d: _checkout(spark, d).stock,
    "checkout_carts": lambda spark, d: _checkout(spark, d).carts,
    "checkout_rejects": lambda spark, d: _checkout(spark, d).rejects,
    "checkout_repeat_rejects": lambda spark, d: _checkout_repeats(spark, d).rejects.filter(F.col("reason") == K.DUPLICATE_REQUEST),
    "checkout_snapshot_orders": lambda spark, d: _checkout(spark, d, stock="snapshot").orders,
    "checkout_snapshot_rejects": lambda spark, d: _checkout(spark, d, stock="snapshot", strict=True).rejects,
    "checkout_strict_orders": lambda spark, d: _checkout(spark, d, strict=True).orders,
    "checkout_strict_rejects": lambda spark, d: _checkout(spark, d, strict=True).rejects,
    "checkout_oversold": lambda spark, d: _checkout(spark, d, stock="snapshot").oversold,
    "checkout_prefix_orders": lambda spark, d: _checkout(spark, d, stock="prefix").orders,
    "checkout_prefix_rejects": lambda spark, d: _checkout(spark, d, stock="prefix").rejects,
    "checkout_at_request_order_items": lambda spark, d: _checkout_at_request(spark, d).order_items,
    "checkout_simple_orders": lambda spark, d: _checkout_simple(spark, d).orders,
    "checkout_simple_order_items": lambda spark, d: _checkout_simple(spark, d).order_items,
    "checkout_simple_rejects": lambda spark, d: _checkout_simple(spark, d).rejects,
})


# Writes -------------------------------------------------------------------------
from bazaar.operators import writes as Wr  # noqa: E402


def promo_requests(spark, d) -> DataFrame:
    """One add-promo request per event row; values chosen so every reject
    rule fires (taken code, blank code, percent out of range, dates in
    the past, non-admin actor, duplicates inside the batch)."""
    ev = read_table(spark, d, "events")
    code = (F.when(F.col("event_type") == "purchase", F.lit("ECO10"))
            .when((F.col("event_type") == "view") & (F.col("event_id") % 11 == 0), F.lit(""))
            .otherwise(F.concat(F.lit("EV-"), F.col("event_type"), F.lit("-"),
                                (F.col("event_id") % 97).cast("string"))))
    return ev.select(
        "event_id", "ts", F.col("user_id").alias("ActorID"), code.alias("Code"),
        ((F.floor("value").cast("long") % 110) - 3).cast("int").alias("DiscountPercent"),
        (F.col("event_type") == "signup").alias("IsGlobal"),
        (F.col("event_id") % 6 + 1).cast("long").alias("CategoryID"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("timestamp")).otherwise(F.col("ts")).alias("ValidFrom"),
        F.when(F.col("event_type") == "click", F.lit(None).cast("timestamp"))
        .otherwise(F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ValidTo"))


def _add_promos(spark, d):
    shop = load_shop(spark, d)
    return Wr.add_promocodes(shop.promocodes, promo_requests(spark, d), AS_OF, rules="sql",
                             user_roles=shop.user_roles, roles=shop.roles, order=["ts", "event_id"])


def _add_promos_at_request(spark, d):
    """Each request at the time of its event: dates at AS_OF are in the past for the later ones only."""
    shop = load_shop(spark, d)
    req = promo_requests(spark, d).withColumn("request_ts", F.col("ts")).withColumn(
        "ValidFrom", F.when(F.col("event_id") % 2 == 0, as_timestamp(AS_OF)).otherwise(F.col("ValidFrom")))
    return Wr.add_promocodes(shop.promocodes, req, None, rules="sql", user_roles=shop.user_roles, roles=shop.roles, order=["ts", "event_id"])


def _add_promos_doc(spark, d):
    shop = load_shop(spark, d)
    return Wr.add_promocodes(shop.promocodes, promo_requests(spark, d).drop("ActorID"), AS_OF,
                             rules="document", order=["ts", "event_id"])


def _delete_promos(spark, d, rules="sql", gated=False):
    """Promos 1, 4 and 7 and the unknown 10, one request per order."""
    shop = load_shop(spark, d)
    ids = read_table(spark, d, "orders").select(F.col("o_custkey").alias("ActorID"),
                                                (F.col("o_orderkey") % 4 * 3 + 1).cast("long").alias("PromoID"))
    if not gated:
        ids = ids.drop("ActorID")
    return Wr.delete_promocodes(shop.promocodes, shop.orders, ids, rules=rules, user_roles=shop.user_roles, roles=shop.roles)


def _actor(key) -> "F.Column":
    """Actors 0, 5, 10 and 15 in turn; customer 0 alone is an admin."""
    return (F.col(key) % 4 * 5).cast("long").alias("ActorID")


def _delete_products(spark, d, mode):
    """restrict: every product after the registered upsert is asked for; those it added have no order
    lines and one favorite each.  cascade_all: one category."""
    shop = load_shop(spark, d)
    lines = shop.order_items
    if mode == "restrict":
        res = _upsert(spark, d)
        liked = res.tables["added"].select((F.col("ProductID") % 7).alias("UserID"), "ProductID")
        products = res.tables["products"].select(*shop.products.columns)
        return Wr.delete_products(products, products.select("ProductID"), shop.favorites.unionByName(liked), shop.cart_items, lines)
    else:
        promo_line = shop.categories.filter(F.col("CategoryName") == "PROMO").select("CategoryID")
        ids = shop.products.join(promo_line, "CategoryID", "left_semi").select("ProductID")
    return Wr.delete_products(shop.products, ids, shop.favorites, shop.cart_items, lines, mode=mode)


def _delete_products_gated(spark, d):
    shop = load_shop(spark, d)
    ids = shop.products.select("ProductID", _actor("ProductID"))
    return Wr.delete_products(shop.products, ids, shop.favorites, shop.cart_items, shop.order_items, mode="plain",
                              user_roles=shop.user_roles, roles=shop.roles)


def _delete_users(spark, d):
    shop = load_shop(spark, d)
    ids = (read_table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING")
           .select(F.col("c_custkey").alias("UserID")))
    return Wr.delete_users(shop, ids)


def product_rows(shop) -> DataFrame:
    """One upsert row per product: adds (no id), updates, unknown ids and
    rows with a zero price (refused)."""
    p = shop.products
    pid = (F.when(F.col("StockQuantity") > 44, F.lit(None).cast("long"))
           .when(F.col("StockQuantity") < 2, F.col("ProductID") + F.lit(1_000_000_000))
           .otherwise(F.col("ProductID")))
    price = (F.when(F.col("StockQuantity") == 10, F.lit(0).cast("decimal(10,2)"))
             .otherwise((F.col("Price") * F.lit(1.1).cast("decimal(2,1)")).cast("decimal(10,2)")))
    return p.select(F.col("ProductID").alias("src_id"), pid.alias("ProductID"),
                    F.upper("ProductName").alias("ProductName"),
                    F.concat("Description", F.lit(" (v2)")).alias("Description"), "CategoryID",
                    price.alias("Price"), (F.col("StockQuantity") + 5).alias("StockQuantity"),
                    F.when(F.col("ProductID") % 2 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("ImageURL")).alias("ImageURL"))


def _upsert(spark, d):
    shop = load_shop(spark, d)
    return Wr.upsert_products(shop.products, product_rows(shop), order=["src_id"])


def _upsert_gated(spark, d):
    shop = load_shop(spark, d)
    return Wr.upsert_products(shop.products, product_rows(shop).withColumn("ActorID", _actor("src_id")), order=["src_id"],
                              user_roles=shop.user_roles, roles=shop.roles)


def product_patches(shop) -> DataFrame:
    p = shop.products
    k = F.col("StockQuantity") % 3
    patch = (F.when(k == 0, F.create_map(F.lit("Price"),
                                         (F.col("Price") * F.lit(0.9).cast("decimal(2,1)"))
                                         .cast("decimal(10,2)").cast("string")))
             .when(k == 1, F.create_map(F.lit("ProductName"), F.upper("ProductName"),
                                        F.lit("ImageURL"), F.lit(None).cast("string")))
             .otherwise(F.create_map(F.lit("StockQuantity"), F.when(F.col("ProductID") % 5 == 0, F.lit("many")).otherwise(F.lit("0")))))
    pid = F.when(F.col("StockQuantity") == 0, F.col("ProductID") + F.lit(1_000_000_000)).otherwise(F.col("ProductID"))
    return p.select(pid.alias("ProductID"), patch.alias("patch"))


def _patch(spark, d):
    shop = load_shop(spark, d)
    return Wr.patch_products(shop.products, product_patches(shop), AS_OF)


def _patch_series(spark, d):
    """Every event patches the product it names, in (ts, event_id) order: many patches of one product."""
    shop = load_shop(spark, d)
    ev = read_table(spark, d, "events")
    patch = (F.when(F.col("event_type") == "click", F.create_map(F.lit("StockQuantity"), (F.col("event_id") % 50).cast("string")))
             .when(F.col("event_type") == "view", F.create_map(F.lit("ImageURL"), F.lit(None).cast("string")))
             .when(F.col("event_type") == "error", F.create_map(F.lit("ProductName"), F.concat(F.lit("e"), F.col("event_id").cast("string")),
                                                                F.lit("ImageURL"), F.lit("x.jpg")))
             .otherwise(F.create_map(F.lit("Description"), F.col("event_type"))))
    patches = ev.select("ts", "event_id", (F.col("user_id") % 4 * 5).cast("long").alias("ActorID"),
                        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("ProductID"), patch.alias("patch"))
    return Wr.patch_products(shop.products, patches, AS_OF, order=["ts", "event_id"], user_roles=shop.user_roles, roles=shop.roles)


def _favorites_edit(spark, d):
    shop = load_shop(spark, d)
    ev = read_table(spark, d, "events")
    key = F.regexp_extract("props", "[0-9]+", 0).cast("long")

    def of(kind):
        return ev.filter(F.col("event_type") == kind).select(F.col("user_id").alias("UserID"), key.alias("ProductID"), "ts", "event_id")
    return Wr.edit_favorites(shop.favorites, of("purchase"), of("click"), shop.user_roles, shop.roles, order=["ts", "event_id"])


def _favorites_edit_doc(spark, d):
    """Favorites keyed by the id of the view event that made them; adds are
    purchase events; every click removes the oldest favorite of its
    (user, product), named by id."""
    shop = load_shop(spark, d)
    ev = read_table(spark, d, "events")
    key = F.regexp_extract("props", "[0-9]+", 0).cast("long")

    def of(kind):
        return ev.filter(F.col("event_type") == kind).select(
            F.col("event_id").alias("FavoriteID"), F.col("user_id").alias("UserID"), key.alias("ProductID"))
    favs, adds, clicks = of("view"), of("purchase"), of("click")
    removes = (clicks.select("UserID", "ProductID", F.col("FavoriteID").alias("click_id"))
               .join(favs, ["UserID", "ProductID"], "inner")
               .groupBy("click_id", "UserID").agg(F.min("FavoriteID").alias("FavoriteID"))
               .select("UserID", "FavoriteID"))
    return Wr.edit_favorites_document(favs, adds, removes, shop.user_roles, shop.roles)


def user_rows(spark, d) -> DataFrame:
    """One registration per customer row: taken names and e-mails,
    duplicates inside the batch, unknown and missing roles."""
    c = read_table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(
        F.concat(F.lit("new_"), F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string")))
    email = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lower("c_name"), F.lit("@example.com"))).otherwise(
        F.concat(F.lit("n"), F.col("c_custkey").cast("string"), F.lit("@shop.test")))
    role = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Admin"))
            .when(F.col("c_mktsegment") == "FURNITURE", F.lit("Guest"))
            .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit(None).cast("string"))
            .otherwise(F.lit("User")))
    return c.select(F.col("c_custkey").alias("src_id"), name.alias("Username"),
                    F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("PasswordHash"),
                    email.alias("Email"), role.alias("RoleName"))


def _register(spark, d, rules="sql", gated=False):
    shop = load_shop(spark, d)
    rows = user_rows(spark, d)
    if gated:    # a third registers itself, the others are registered by actor 0 or 5
        rows = rows.withColumn("ActorID", F.when(F.col("src_id") % 3 > 0, (F.col("src_id") % 3 - 1) * 5).cast("long"))
    return Wr.register_users(shop.users, shop.user_roles, shop.roles, rows, rules=rules, order=["src_id"])


def _fold_rejects(spark, d):
    shop = load_shop(spark, d)
    return Wr.fold_cart_events(shop.cart_events, user_roles=shop.user_roles, roles=shop.roles).rejects.select("event_id", "reason")


def _integrity(spark, d):
    """The shop after products and accounts were removed without their rows elsewhere."""
    shop = load_shop(spark, d)
    segment = read_table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("UserID"))
    tables = {name: getattr(shop, name) for name in ("categories", "promocodes", "roles", "user_roles", "favorites", "orders",
                                                     "order_statuses", "order_items")}
    tables["products"] = shop.products.filter(F.col("StockQuantity") != 5)
    tables["users"] = shop.users.join(segment, "UserID", "left_anti")
    tables["cart_items"] = shop.cart_items
    return Wr.integrity_report(shop_from_tables(spark, tables))


QUERIES.update({
    "add_promocodes_added": lambda spark, d: _add_promos(spark, d).tables["added"],
    "add_promocodes_rejects": lambda spark, d: _add_promos(spark, d).rejects.select("event_id", "reason"),
    "add_promocodes_at_request_added": lambda spark, d: _add_promos_at_request(spark, d).tables["added"],
    "add_promocodes_at_request_rejects": lambda spark, d: _add_promos_at_request(spark, d).rejects.select("event_id", "reason"),
    "add_promocodes_doc_added": lambda spark, d: _add_promos_doc(spark, d).tables["added"],
    "delete_promocodes_promos": lambda spark, d: _delete_promos(spark, d).tables["promocodes"],
    "delete_promocodes_orders": lambda spark, d: _delete_promos(spark, d).tables["orders"],
    "delete_promocodes_rejects": lambda spark, d: _delete_promos(spark, d).rejects,
    "delete_promocodes_doc_orders": lambda spark, d: _delete_promos(spark, d, "document").tables["orders"],
    "delete_products_products": lambda spark, d: _delete_products(spark, d, "restrict").tables["products"],
    "delete_products_favorites": lambda spark, d: _delete_products(spark, d, "restrict").tables["favorites"],
    "delete_products_rejects": lambda spark, d: _delete_products(spark, d, "restrict").rejects,
    "delete_products_cascade_order_items":
        lambda spark, d: _delete_products(spark, d, "cascade_all").tables["order_items"],
    "delete_users_orders": lambda spark, d: _delete_users(spark, d).tables["orders"],
    "delete_users_order_items": lambda spark, d: _delete_users(spark, d).tables["order_items"],
    "delete_users_user_roles": lambda spark, d: _delete_users(spark, d).tables["user_roles"],
    "upsert_products_products": lambda spark, d: _upsert(spark, d).tables["products"],
    "upsert_products_rejects": lambda spark, d: _upsert(spark, d).rejects.select("src_id", "reason"),
    "patch_products_products": lambda spark, d: _patch(spark, d).tables["products"],
    "patch_products_rejects": lambda spark, d: _patch(spark, d).rejects.select("ProductID", "reason"),
    "edit_favorites_favorites": lambda spark, d: _favorites_edit(spark, d).tables["favorites"],
    "edit_favorites_rejects": lambda spark, d: _favorites_edit(spark, d).rejects,
    "edit_favorites_doc_favorites": lambda spark, d: _favorites_edit_doc(spark, d).tables["favorites"],
    "register_users_added": lambda spark, d: _register(spark, d).tables["added_users"],
    "register_users_roles": lambda spark, d: _register(spark, d).tables["added_roles"],
    "register_users_rejects": lambda spark, d: _register(spark, d).rejects.select("src_id", "reason"),
    "register_users_doc_added": lambda spark, d: _register(spark, d, "document").tables["added_users"],
    "integrity_report": _integrity,
    "delete_promocodes_doc_promos": lambda spark, d: _delete_promos(spark, d, "document").tables["promocodes"],
    "delete_promocodes_gate_rejects":
        lambda spark, d: _delete_promos(spark, d, gated=True).rejects.select("ActorID", "PromoID", "reason"),
    "delete_products_gate_products": lambda spark, d: _delete_products_gated(spark, d).tables["products"],
    "delete_products_gate_rejects":
        lambda spark, d: _delete_products_gated(spark, d).rejects.select("ActorID", "ProductID", "reason"),
    "upsert_products_gate_rejects": lambda spark, d: _upsert_gated(spark, d).rejects.select("src_id", "ActorID", "reason"),
    "patch_products_series": lambda spark, d: _patch_series(spark, d).tables["products"],
    "patch_products_series_rejects": lambda spark, d: _patch_series(spark, d).rejects.select("event_id", "reason"),
    "register_users_gate_added": lambda spark, d: _register(spark, d, gated=True).tables["added_users"],
    "register_users_gate_rejects": lambda spark, d: _register(spark, d, gated=True).rejects.select("src_id", "reason"),
    "fold_cart_events_rejects": lambda spark, d: _fold_rejects(spark, d),
})


# Audit, logs, JSON and streams ------------------------------------------------------
from bazaar.operators import audit as Au  # noqa: E402
from bazaar.sources import json_io as J  # noqa: E402
from bazaar.streaming import audit_stream as AS  # noqa: E402
from bazaar.streaming import cart_stream as CS  # noqa: E402
from bazaar.streaming import top_stream as TS  # noqa: E402

LATENESS_DAYS = 10
ADMIN_ACTOR = 0    # customer 0 holds the Admin role


def new_products(shop) -> DataFrame:
    """Product snapshot after the upsert batch and after removing the
    products with stock 5 (inserts, updates and deletes)."""
    up = Wr.upsert_products(shop.products, product_rows(shop), order=["src_id"]).tables["products"]
    gone = shop.products.filter(F.col("StockQuantity") == 5).select("ProductID")
    return Wr.delete_products(up, gone, shop.favorites, shop.cart_items, shop.order_items,
                              mode="plain").tables["products"]


def new_promocodes(spark, d, shop) -> DataFrame:
    """Promo snapshot after the add-promo batch and removing expired codes."""
    added = Wr.add_promocodes(shop.promocodes, promo_requests(spark, d), AS_OF, rules="sql",
                              user_roles=shop.user_roles, roles=shop.roles,
                              order=["ts", "event_id"]).tables["promocodes"]
    expired = shop.promocodes.filter(F.col("ValidTo") < as_timestamp(AS_OF)).select("PromoID")
    return Wr.delete_promocodes(added, shop.orders, expired).tables["promocodes"]


def _audit_products(spark, d):
    shop = load_shop(spark, d)
    return Au.audit_products(shop.products, new_products(shop), ADMIN_ACTOR, AS_OF)


def _audit_products_by_range(spark, d):
    """The product audit over the key ranges whose digests differ; the products below 5/8 of the ids are left unchanged."""
    shop = load_shop(spark, d)
    top = shop.products.agg(F.max("ProductID")).first()[0]
    new = shop.products.filter(F.col("ProductID") < top * 5 // 8).unionByName(
        new_products(shop).filter(F.col("ProductID") >= top * 5 // 8).select(*shop.products.columns))
    return Sn.audit_by_range(Au.audit_products, shop.products, new, "ProductID", Au.PRODUCT_VALUE_COLS, ADMIN_ACTOR, AS_OF, width=64)


def _audit_promocodes(spark, d):
    shop = load_shop(spark, d)
    return Au.audit_promocodes(shop.promocodes, new_promocodes(spark, d, shop), ADMIN_ACTOR, AS_OF)


def _audit_log(spark, d):
    return Au.logs(Au.append_logs(None, _audit_products(spark, d).unionByName(_audit_promocodes(spark, d))))


def _logs_json_roundtrip(spark, d):
    path = AS.stream_root(spark, "logs-json")
    J.export_logs(_audit_log(spark, d), path)
    return J.read_logs_json(spark, path, multi_line=False)


def _imported_logs(spark, d, dedup):
    """The product log takes in a file of the whole log: with ``dedup`` only
    the promo entries are new, without every row is appended."""
    existing = Au.append_logs(None, _audit_products(spark, d))
    path = AS.stream_root(spark, "logs-json")
    J.export_logs(_audit_log(spark, d), path)
    return J.import_logs(existing, J.read_logs_json(spark, path, multi_line=False), dedup=dedup)


def _import_logs_dedup(spark, d):
    return _imported_logs(spark, d, True)


def _import_logs_append(spark, d):
    return _imported_logs(spark, d, False)


def _log_rejects(spark, d):
    """Every account asks for the log."""
    shop = load_shop(spark, d)
    return Au.log_requests(shop.users.select(F.col("UserID").alias("ActorID")), shop.user_roles, shop.roles)[1]


def _export_products(spark, d):
    return J.export_frame(load_shop(spark, d).products)


def _import_products_added(spark, d):
    shop = load_shop(spark, d)
    path = AS.stream_root(spark, "products-json")
    J.export_products(shop.products, path)
    return J.import_products(spark, shop.products, path, multi_line=False)[1]


def _import_products_array_added(spark, d):
    """The products as array files, read again by byte ranges."""
    shop = load_shop(spark, d)
    path = AS.stream_root(spark, "products-array")
    J.export_products_array(shop.products, path)
    return J.import_products(spark, shop.products, path)[1]


def _audit_stream_replayed(spark, d):
    """The change feed delivered twice, the second time after a restart."""
    shop = load_shop(spark, d)
    feed = AS.product_change_feed(shop.products, new_products(shop), ADMIN_ACTOR, AS_OF)
    root = AS.stream_root(spark, "audit-replayed")
    for parts in (3, 2):
        feed.repartitionByRange(parts, "Key").write.mode("append").parquet(f"{root}/source")
        AS.run_audit_stream(spark, f"{root}/source", f"{root}/sink", f"{root}/checkpoint", replayed_within="1 day")
    return spark.read.parquet(f"{root}/sink").select("UserID", "Action", "Timestamp", "Key")


def _audit_stream(spark, d):
    shop = load_shop(spark, d)
    feed = AS.product_change_feed(shop.products, new_products(shop), ADMIN_ACTOR, AS_OF)
    root = AS.stream_root(spark, "audit-stream")
    feed.repartitionByRange(4, "Key").write.parquet(f"{root}/source")
    AS.run_audit_stream(spark, f"{root}/source", f"{root}/sink", f"{root}/checkpoint", max_files_per_trigger=1)
    return spark.read.parquet(f"{root}/sink").select("UserID", "Action", "Timestamp", "Key")


def _audit_promo_stream(spark, d):
    shop = load_shop(spark, d)
    feed = AS.promo_change_feed(shop.promocodes, new_promocodes(spark, d, shop), ADMIN_ACTOR, AS_OF)
    root = AS.stream_root(spark, "audit-promo-stream")
    feed.repartitionByRange(3, "Key").write.parquet(f"{root}/source")
    AS.run_audit_stream(spark, f"{root}/source", f"{root}/sink", f"{root}/checkpoint",
                        max_files_per_trigger=1, kind="promo")
    return spark.read.parquet(f"{root}/sink").select("UserID", "Action", "Timestamp", "Key")


def _top_products_stream(spark, d):
    """All order lines as a feed in two halves, then every tenth order's lines taken back.

    The feed's files are as many as Spark's tasks (none is a fixed share of the table); a micro-batch takes half of the lines' files.
    """
    shop = load_shop(spark, d)
    root = AS.stream_root(spark, "top-stream")
    lines = shop.order_items.select(F.lit("insert").alias("op"), "*")
    gone = lines.filter(F.col("OrderID") % 10 == 0).withColumn("op", F.lit("delete"))
    lines.repartition("OrderID").write.parquet(f"{root}/source")
    half = -(-len(spark.read.schema(TS.LINE_CHANGES).parquet(f"{root}/source").inputFiles()) // 2)
    gone.write.mode("append").parquet(f"{root}/source")
    return spark.read.parquet(TS.run_top_stream(spark, f"{root}/source", root, shop, max_files_per_trigger=max(half, 1))[-1])


def _cart_stream_run(spark, d):
    """Cart events cut into eight time slices, two files per micro-batch."""
    shop = load_shop(spark, d)
    root = AS.stream_root(spark, "cart-stream")
    shop.cart_events.repartitionByRange(8, "ts").write.parquet(f"{root}/source")
    return root, CS.run_cart_stream(spark, f"{root}/source", root, shop.user_roles, shop.roles, max_files_per_trigger=2)


def _cart_stream(spark, d):
    return _cart_stream_run(spark, d)[1]


def _cart_stream_rejects(spark, d):
    root, _ = _cart_stream_run(spark, d)
    return CS.read_side(spark, root, "rejects").select("event_id", "reason")


def _cart_stream_out_of_order(spark, d, lateness=None):
    """Set events arrive first, all others after a restart."""
    shop = load_shop(spark, d)
    root = AS.stream_root(spark, "cart-late")
    for part in (F.col("op") == "set", F.col("op") != "set"):
        shop.cart_events.filter(part).write.mode("append").parquet(f"{root}/source")
        carts = CS.run_cart_stream(spark, f"{root}/source", root, shop.user_roles, shop.roles, max_files_per_trigger=None,
                                   lateness=lateness)
    return root, carts


def _cart_stream_mixed(spark, d):
    return _cart_stream_out_of_order(spark, d)[1]


def _cart_stream_late(spark, d):
    root, _ = _cart_stream_out_of_order(spark, d, dt.timedelta(days=LATENESS_DAYS))
    return CS.read_side(spark, root, "late").select("event_id", "reason")


QUERIES.update({
    "audit_products": _audit_products,
    "audit_products_by_range": _audit_products_by_range,
    "audit_promocodes": _audit_promocodes,
    "audit_log": _audit_log,
    "logs_json_roundtrip": _logs_json_roundtrip,
    "import_logs_dedup": _import_logs_dedup,
    "import_logs_append": _import_logs_append,
    "log_request_rejects": _log_rejects,
    "export_products": _export_products,
    "import_products_added": _import_products_added,
    "import_products_array_added": _import_products_array_added,
    "audit_stream_replayed": _audit_stream_replayed,
    "audit_stream": _audit_stream,
    "audit_promo_stream": _audit_promo_stream,
    "top_products_stream": _top_products_stream,
    "cart_stream": _cart_stream,
    "cart_stream_rejects": _cart_stream_rejects,
    "cart_stream_out_of_order": _cart_stream_mixed,
    "cart_stream_late": _cart_stream_late,
})


# Client-side views and keyset paging -----------------------------------------------------
KEYSET_AFTER = 500


def _q_promo_choices(spark, d):
    return C.promo_choices(_batch_shop(spark, d), AS_OF)


def _q_product_cards(spark, d):
    return C.product_cards(load_shop(spark, d), AS_OF)


def _q_catalog_page_after(spark, d):
    return C.catalog_page_after(load_shop(spark, d), KEYSET_AFTER, 52, AS_OF)


def _q_delete_products_plain(spark, d):
    shop = load_shop(spark, d)
    gone = shop.products.filter(F.col("StockQuantity") == 5).select("ProductID")
    return Wr.delete_products(shop.products, gone, shop.favorites, shop.cart_items, shop.order_items,
                              mode="plain").tables["products"]


QUERIES.update({
    "promo_choices": _q_promo_choices,
    "product_cards": _q_product_cards,
    "catalog_page_after": _q_catalog_page_after,
    "delete_products_plain": _q_delete_products_plain,
})


# Document twins -------------------------------------------------------------------------


def _q_add_products_doc(spark, d):
    shop = load_shop(spark, d)
    rows = product_rows(shop)
    return Wr.add_products_document(shop.products, rows.drop("ProductID"), AS_OF, order=["src_id"]).tables["added"]


def _q_promocodes_doc(spark, d):
    return _batch_shop(spark, d).promocodes


QUERIES.update({
    "add_products_doc_added": _q_add_products_doc,
    "promocodes_doc": _q_promocodes_doc,
})
