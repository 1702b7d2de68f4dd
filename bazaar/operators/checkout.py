"""D1 bulk checkout (and D1b, its document form).

One lazy plan turns a frame of checkout requests into the new Orders,
OrderItems, product stock and carts, plus the rejected requests with a
reason.  Per-user verdicts are aggregates over the cart lines (partial
aggregation per map task), never a window over a user's lines; stock is
decremented by the sold quantity per product, an aggregate as well.

Stock rules.  ``stock="serial"`` (default) is the shop's: requests are taken
one after the other in (request_ts, UserID) order, and a cart sees the
decrements of the carts accepted before it.  ``stock="snapshot"``: every
cart is tested against the same stock, as a single call would be;
``oversold`` lists the products whose accepted demand exceeds it.
``stock="prefix"``: a line passes only if the running demand for its
product -- all eligible carts' lines up to this request, rejected carts
included -- fits the stock.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import MONEY, discounted_price, promo_active, promo_applies
from bazaar.operators.components import connected_components
from bazaar.operators.ids import drop_checkpoint, max_id, next_ids, write_checkpoint
from bazaar.operators.scan import running_total
from bazaar.operators.users import users_with_role
from bazaar.operators.writes import first_per_key
from bazaar.sources.tables import Shop

# Reject reasons of the checkout.
NOT_A_SHOP_USER = "not a shop user"
DUPLICATE_REQUEST = "duplicate request"
EMPTY_CART = "empty cart"
OUT_OF_STOCK = "out of stock"
NON_POSITIVE = "non-positive quantity"
PENDING = "pending"

#: Lines of one conflict group that a task passes over at a time (about 100 MB of Python objects at most).
GROUP_LINES = 1_000_000


@dataclass
class Checkout:
    orders: DataFrame       # OrderID, UserID, PromoID, StatusID
    order_items: DataFrame  # OrderID, ProductID, Quantity, UnitPrice
    stock: DataFrame        # ProductID, StockQuantity (new)
    carts: DataFrame        # UserID, ProductID, Quantity (what is left)
    rejects: DataFrame      # UserID, PromoID, request_ts, reason, detail
    oversold: DataFrame     # ProductID, StockQuantity, Sold
    kept: tuple = ()        # intermediates persisted for the outputs

    def release(self) -> None:
        """Unpersist the shared intermediates once the outputs are written."""
        for df in self.kept:
            df.unpersist()


def _first_request_per_user(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One request per user (the earliest); every other one, identical
    repeats included, is rejected."""
    first, later = first_per_key(requests.select("UserID", "PromoID", "request_ts"), ["UserID"], ["request_ts", "PromoID"])
    dup = later.select("UserID", "PromoID", "request_ts",
                       F.lit(DUPLICATE_REQUEST).alias("reason"), F.lit(None).cast("string").alias("detail"))
    return first, dup


def _taken_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one-by-one loop over lines sorted by (group, request_ts, UserID): (UserID, taken) per cart.

    Holds one cart and what is left of the products of one group.
    """
    group, left, cart, lines = None, {}, None, []
    out: tuple[list, list] = ([], [])

    def close() -> None:
        fits = all(stock is None or left.get(p, stock) >= q for p, q, stock in lines)
        if fits:
            for p, q, stock in lines:
                if stock is not None:
                    left[p] = left.get(p, stock) - q
        out[0].append(cart)
        out[1].append(fits)

    def emit() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_())], names=["UserID", "won"])
        out[0].clear()
        out[1].clear()
        return done

    for batch in batches:
        for g, user, product, q, stock in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if lines and (user != cart or g != group):
                close()
                lines = []
            if g != group:
                group, left = g, {}
            cart = user
            lines.append((product, q, stock))
        yield emit()
    if lines:
        close()
        yield emit()


def _serial_accepted(lines: DataFrame, strict: bool) -> DataFrame:
    """(UserID, won) of every cart when ``lines`` (UserID, request_ts,
    ProductID, Quantity, StockQuantity) are checked out one after the other.

    Only carts that share a product whose demand exceeds its stock can be in
    each other's way.  The others are accepted at once; the rest falls into
    conflict groups (components of carts and contested products), and each
    group is decided by one pass over its carts in request order.  Of a
    group with more than GROUP_LINES lines the earliest carts up to that
    many lines are decided (they depend on no later one), then demand, stock
    and groups are taken anew without them.  Up to GROUP_LINES contested
    lines in all are one group, without looking for components.  So the number of
    jobs depends on the largest group's lines over GROUP_LINES only, and no
    task passes over more than that of one group.
    """
    order = ["request_ts", "UserID"]
    base = lines.select("UserID", "request_ts", "ProductID", F.col("Quantity").cast("long").alias("q"),
                        F.col("StockQuantity").cast("long").alias("stock"))
    out, state, stale = None, base, []
    while True:
        # A cart that cannot be accepted whatever the others do takes nothing.
        lost = state.filter((F.col("q") <= 0) | (F.col("q") > F.col("stock")) if strict else F.lit(False)).select("UserID").distinct()
        able = state.join(lost, "UserID", "left_anti") if strict else state
        wanted = able.groupBy("ProductID").agg(F.sum(F.greatest("q", F.lit(0))).alias("wanted"), F.max("stock").alias("most"))
        short = wanted.filter("wanted > most").select("ProductID")
        contested = write_checkpoint(able.join(short, "ProductID", "left_semi").select(*base.columns), "contested")
        busy = contested.select("UserID").distinct()
        free = able.select("UserID").distinct().join(busy, "UserID", "left_anti").withColumn("won", F.lit(True))
        refused = lost.withColumn("won", F.lit(False)) if strict else free.limit(0)
        n = contested.count()
        stale.append(contested)
        if n <= GROUP_LINES:
            grouped, whole = contested.withColumn("grp", F.lit(0).cast("long")), True
        else:
            named = _conflict_groups(contested)
            stale.append(named)
            grouped, whole = _earliest_carts(named, order)
        # a group's carts go to one task, sorted; a task takes many groups
        dealt = (grouped.repartition("grp").sortWithinPartitions("grp", *order, "ProductID")
                 .select("grp", "UserID", "ProductID", "q", "stock"))
        decided = write_checkpoint(free.unionByName(refused).unionByName(dealt.mapInArrow(_taken_in_order, "UserID long, won boolean")), "decided")
        out = decided if out is None else out.unionByName(decided)
        if whole:
            break
        left = contested.join(decided.select("UserID"), "UserID", "left_anti")
        took = (contested.join(decided.filter("won").select("UserID"), "UserID", "left_semi").groupBy("ProductID").agg(F.sum("q").alias("took")))
        state = write_checkpoint(left.join(took, "ProductID", "left").select(
            "UserID", "request_ts", "ProductID", "q", (F.col("stock") - F.coalesce("took", F.lit(0))).alias("stock")), "serial")
        for table in stale:
            drop_checkpoint(table)
        stale = [state]
    for table in stale:
        drop_checkpoint(table)
    return out


def _conflict_groups(contested: DataFrame) -> DataFrame:
    """Lines with ``grp``: the component of their cart among carts and contested products (written)."""
    pivot = contested.groupBy("UserID").agg(F.min("ProductID").alias("pivot"))
    comp = connected_components(contested.join(pivot, "UserID").select(F.col("ProductID").alias("src"), F.col("pivot").alias("dst")))
    named = write_checkpoint(contested.join(comp.select(F.col("node").alias("ProductID"), F.col("component").alias("grp")), "ProductID"), "groups")
    drop_checkpoint(comp)
    return named


def _earliest_carts(named: DataFrame, order: list[str]) -> tuple[DataFrame, bool]:
    """(lines, whether all): of groups above GROUP_LINES only the earliest whole carts up to it, at least one."""
    large = named.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > GROUP_LINES).select("grp")
    if large.isEmpty():
        return named, True
    carts = named.join(large, "grp", "left_semi").groupBy("grp", *order).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(carts, ["grp"], order, "n", "upto")
    early = upto.filter((F.col("upto") <= GROUP_LINES) | (F.col("upto") == F.col("n"))).select("UserID")
    small = named.join(large, "grp", "left_anti")
    return small.unionByName(named.join(large, "grp", "left_semi").join(early, "UserID", "left_semi").select(*small.columns)), False


def checkout(shop: Shop, requests: DataFrame, as_of, allow_empty: bool = False,
             strict: bool = True, cart: DataFrame | None = None, start_id: int | None = None,
             stock: str = "serial") -> Checkout:
    """Per request (UserID, PromoID nullable, request_ts).

    * not role User -> reject; a cart line above stock rejects the whole
      cart; with ``strict`` a line <= 0 rejects it too; an empty cart is
      rejected unless ``allow_empty``.
    * the promo counts only when active at ``as_of`` -- with ``as_of=None``
      at the request's own ``request_ts``, as a call at that time would see
      it; it prices a line
      when global or of the line's category (F5 + F1); the order keeps
      the requested PromoID even when the promo did not count.
    """
    # The carts and the priced cart lines feed all five outputs: persist
    # them once (a lost executor recomputes its blocks from lineage).
    carts = (cart if cart is not None else shop.cart_items).select(
        "UserID", "ProductID", "Quantity").persist(StorageLevel.MEMORY_AND_DISK)
    first, dup = _first_request_per_user(requests)
    shop_users = users_with_role(shop.user_roles, shop.roles, "User")
    not_user = first.join(shop_users, "UserID", "left_anti")
    eligible = first.join(shop_users, "UserID", "left_semi")

    products = shop.products.select("ProductID", "CategoryID", "Price", "StockQuantity")
    lines = (carts.join(eligible.select("UserID", "request_ts"), "UserID", "inner")
             .join(products, "ProductID", "inner")).persist(StorageLevel.MEMORY_AND_DISK)

    order = ["request_ts", "UserID"]
    if stock == "snapshot":
        judged_lines = lines
        short = F.col("StockQuantity") < F.col("Quantity")
    elif stock == "prefix":
        # Running demand per product in request order (skew-safe scan).
        ordered = lines.withColumn("__demand_qty", F.greatest(F.col("Quantity"), F.lit(0)))
        judged_lines = running_total(ordered, ["ProductID"], order, "__demand_qty", "Demand")
        short = F.col("StockQuantity") < F.col("Demand")
    elif stock == "serial":
        # What the accepted carts before a line took, its own cart left out.
        won = _serial_accepted(lines, strict).select("UserID", F.col("won").alias("__won"))
        ordered = (lines.join(won, "UserID")
                   .withColumn("__took", F.when(F.col("__won"), F.col("Quantity").cast("long")).otherwise(F.lit(0))))
        judged_lines = running_total(ordered, ["ProductID"], order, "__took", "Taken")
        short = F.col("StockQuantity") - (F.col("Taken") - F.col("__took")) < F.col("Quantity")
    else:
        raise ValueError(f"unknown stock rule {stock!r}")
    judged_lines = judged_lines.withColumn("__short", short)
    per_cart = (judged_lines.groupBy("UserID")
                .agg(F.count(F.lit(1)).alias("n_lines"),
                     F.max(F.col("__short").cast("int")).alias("any_short"),
                     F.min("Quantity").alias("min_qty")))
    reason = (F.when(F.col("n_lines").isNull() & F.lit(not allow_empty), F.lit(EMPTY_CART))
              .when(F.col("any_short") == 1, F.lit(OUT_OF_STOCK))
              .when(F.lit(strict) & (F.col("min_qty") <= 0), F.lit(NON_POSITIVE)))
    # The verdict feeds every output: written once.
    judged = write_checkpoint(eligible.join(per_cart, "UserID", "left").withColumn("reason", reason)
                              .select("UserID", "PromoID", "request_ts", "reason"), "verdict")
    # The names of missing products are looked up for the refused carts only.
    short_names = (judged_lines.filter("__short")
                   .join(judged.filter(F.col("reason") == OUT_OF_STOCK).select("UserID"), "UserID", "left_semi")
                   .select("UserID", "ProductID").join(shop.products.select("ProductID", "ProductName"), "ProductID", "inner")
                   .groupBy("UserID").agg(F.min("ProductName").alias("detail")))

    rejects = (not_user.select("UserID", "PromoID", "request_ts",
                               F.lit(NOT_A_SHOP_USER).alias("reason"), F.lit(None).cast("string").alias("detail"))
               .unionByName(dup)
               .unionByName(judged.filter(F.col("reason").isNotNull()).join(short_names, "UserID", "left")
                            .select("UserID", "PromoID", "request_ts", "reason", "detail")))

    accepted = judged.filter(F.col("reason").isNull()).select("UserID", "PromoID", "request_ts")
    start = start_id if start_id is not None else max_id(shop.orders, "OrderID")
    numbered = next_ids(accepted, ["request_ts", "UserID"], start, "OrderID")

    orders = _with_status(numbered, shop.order_statuses)

    moment = F.col("request_ts") if as_of is None else as_of
    promos = shop.promocodes.select("PromoID", F.col("DiscountPercent").alias("pct"), "IsGlobal", "ValidFrom", "ValidTo",
                                    F.col("CategoryID").alias("PromoCategoryID"))
    priced = (lines.drop("request_ts").join(numbered.select("UserID", "OrderID", "PromoID", "request_ts"), "UserID", "inner")
              .join(promos, "PromoID", "left"))
    counts = F.coalesce(promo_active("ValidFrom", "ValidTo", moment), F.lit(False))
    unit = F.when(counts & promo_applies("IsGlobal", "PromoCategoryID", "CategoryID"),
                  discounted_price("Price", "pct")).otherwise(F.col("Price").cast(MONEY))
    order_items = priced.select("OrderID", "ProductID", "Quantity", unit.alias("UnitPrice"))

    sold = (lines.join(accepted.select("UserID"), "UserID", "left_semi")
            .groupBy("ProductID").agg(F.sum("Quantity").cast("long").alias("Sold")))
    with_sold = shop.products.select("ProductID", "StockQuantity").join(sold, "ProductID", "left")
    stock = with_sold.select(
        "ProductID",
        (F.col("StockQuantity") - F.coalesce(F.col("Sold"), F.lit(0))).cast(T.IntegerType()).alias("StockQuantity"))
    oversold = with_sold.filter(F.col("Sold") > F.col("StockQuantity")).select("ProductID", "StockQuantity", "Sold")

    remaining = carts.join(accepted.select("UserID"), "UserID", "left_anti").select(*carts.columns)
    return Checkout(orders=orders, order_items=order_items, stock=stock, carts=remaining,
                    rejects=rejects, oversold=oversold, kept=(carts, lines))


def _with_status(numbered: DataFrame, statuses: DataFrame) -> DataFrame:
    """Attach the id of the 'pending' status (one scalar looked up once)."""
    row = statuses.filter(F.col("StatusCode") == PENDING).select("StatusID").first()
    if row is None:
        raise ValueError("no 'pending' order status")
    return numbered.select("OrderID", "UserID", "PromoID", F.lit(row["StatusID"]).cast("long").alias("StatusID"))


def checkout_simple(shop: Shop, requests: DataFrame, cart: DataFrame | None = None,
                    start_id: int | None = None) -> Checkout:
    """D1b, the document form: role User and a non-empty cart are the only
    tests; the promo (looked up by id, no validity or category test)
    discounts every line by price * (1 - pct/100); stock is untouched.
    The line price comes from the product (the cart line has none)."""
    carts = (cart if cart is not None else shop.cart_items).select("UserID", "ProductID", "Quantity")
    first, dup = _first_request_per_user(requests)
    shop_users = users_with_role(shop.user_roles, shop.roles, "User")
    not_user = first.join(shop_users, "UserID", "left_anti")
    eligible = first.join(shop_users, "UserID", "left_semi")
    has_cart = carts.select("UserID").distinct()
    empty = eligible.join(has_cart, "UserID", "left_anti")
    accepted = eligible.join(has_cart, "UserID", "left_semi")
    rejects = (not_user.select("UserID", "PromoID", "request_ts", F.lit(NOT_A_SHOP_USER).alias("reason"))
               .unionByName(dup.drop("detail"))
               .unionByName(empty.select("UserID", "PromoID", "request_ts", F.lit(EMPTY_CART).alias("reason")))
               .withColumn("detail", F.lit(None).cast("string")))
    start = start_id if start_id is not None else max_id(shop.orders, "OrderID")
    numbered = next_ids(accepted, ["request_ts", "UserID"], start, "OrderID")
    orders = _with_status(numbered, shop.order_statuses)
    promos = shop.promocodes.select("PromoID", F.col("DiscountPercent").alias("pct"))
    price = shop.products.select("ProductID", "Price")
    items = (carts.join(numbered.select("UserID", "OrderID", "PromoID"), "UserID", "inner")
             .join(price, "ProductID", "left")
             .join(promos, "PromoID", "left"))
    factor = F.lit(1) - F.col("pct").cast(T.DecimalType(10, 0)) * F.lit(0.01).cast(T.DecimalType(2, 2))
    unit = F.when(F.col("pct").isNotNull(), (F.col("Price") * factor).cast(T.DecimalType(14, 4))) \
        .otherwise(F.col("Price").cast(T.DecimalType(14, 4)))
    order_items = items.select("OrderID", "ProductID", "Quantity", unit.alias("UnitPrice"))
    stock = shop.products.select("ProductID", "StockQuantity")
    remaining = carts.join(accepted.select("UserID"), "UserID", "left_anti").select(*carts.columns)
    return Checkout(orders=orders, order_items=order_items, stock=stock, carts=remaining,
                    rejects=rejects, oversold=stock.limit(0).withColumn("Sold", F.lit(0).cast("long")))
