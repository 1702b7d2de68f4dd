"""How registered queries hand out values: the columns listed here leave
as DOUBLE on both the Spark and the SQL side -- money (exact decimal
until this point, a JSON number in the shop's API) and a quantity that is
null after an outer unwind.  Ids are bigint, and those that are null for
some rows by design (an order without promo) leave as text, so that no
client turns them into floating point.  Operators return bigint throughout."""

from __future__ import annotations

PRICE2 = ["Price", "DiscountedPrice"]

DOUBLE_COLS: dict[str, list[str]] = {
    "top_products": ["Price", "TotalRevenue"], "top_products_keyed": ["totalRevenue"],
    "order_totals": ["TotalPrice"], "favorites": ["Price"], "order_details": ["UnitPrice", "LineTotal"],
    "cart_items": ["Price"], "cart_quote": ["Total"],
    "catalog": PRICE2, "catalog_best": PRICE2, "product_details": PRICE2, "catalog_by_category": PRICE2,
    "search_products": PRICE2, "catalog_page": PRICE2, "search_page": PRICE2, "category_page": PRICE2,
    "catalog_plain": ["Price"], "products_by_category": ["Price"], "search_products_regex": ["Price"],
    "products_by_category_order": ["Price"],
    "orders_unwound": ["Quantity", "UnitPrice"],
    "checkout_order_items": ["UnitPrice"],
    "checkout_simple_order_items": ["UnitPrice"],
    "delete_products_products": ["Price"], "delete_products_cascade_order_items": ["UnitPrice"],
    "delete_users_order_items": ["UnitPrice"],
    "upsert_products_products": ["Price"], "patch_products_products": ["Price"],
    "export_products": ["Price"], "import_products_added": ["Price"],
    "product_cards": ["ShownPrice"], "catalog_page_after": PRICE2, "delete_products_plain": ["Price"],
    "add_products_doc_added": ["Price"],
    "cart_quote_lines": ["Price", "ItemPrice"],
    "orders_nested_split_lines": ["UnitPrice"],
    "delete_products_gate_products": ["Price"],
    "patch_products_series": ["Price"], "checkout_at_request_order_items": ["UnitPrice"], "catalog_at_view": PRICE2, "search_many": PRICE2, "top_products_stream": ["Price", "TotalRevenue"],
    "import_products_array_added": ["Price"], "catalog_page_directory": PRICE2, "catalog_page_directory_last": PRICE2,
}

TEXT_COLS: dict[str, list[str]] = {
    **{name: ["PromoID"] for name in (
        "orders_nested", "order_document", "checkout_orders", "checkout_rejects", "checkout_simple_orders", "checkout_simple_rejects",
        "checkout_prefix_orders", "checkout_prefix_rejects", "checkout_snapshot_orders", "checkout_snapshot_rejects",
        "checkout_repeat_rejects", "checkout_strict_orders", "checkout_strict_rejects", "delete_promocodes_orders", "delete_promocodes_doc_orders", "delete_users_orders")},
    "orders_unwound": ["ProductID"], "delete_promocodes_gate_rejects": ["ActorID"],
    **{name: ["CategoryID"] for name in ("add_promocodes_added", "add_promocodes_at_request_added", "add_promocodes_doc_added", "promocodes_doc",
                                         "delete_promocodes_promos", "delete_promocodes_doc_promos")},
}
