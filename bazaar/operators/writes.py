"""Writes as set operations.

Each operator takes the current tables plus a request DataFrame and
returns the new state and a ``rejects`` frame with a ``reason`` column,
where the shop raised an error per call.  Nothing is written here;
callers persist the returned frames (``write.mode("overwrite")`` to a
new path, since parquet has no MERGE).
"""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import as_timestamp
from bazaar.operators.ids import max_id, next_ids, write_checkpoint
from bazaar.operators.users import users_with_role

KEYS = ["UserID", "ProductID"]

# Reject reasons.
NOT_A_SHOP_USER = "not a shop user"
NOT_AN_ADMIN = "not an admin"
MALFORMED_VALUE = "malformed value"
NO_DOCUMENT_FORM = "no document form"


@dataclass
class CartFold:
    items: DataFrame      # UserID, ProductID, Quantity
    rejects: DataFrame    # the rejected events plus reason


_BEFORE_ALL = -(10 ** 17)   # microseconds; earlier than any timestamp


def event_position(ts: Column, event_id: Column) -> Column:
    """(ts, event_id) as one number in the same order.  A decimal is a
    mutable aggregation buffer, so ``max`` stays a hash aggregate; a
    struct would be sorted."""
    micros = F.coalesce(F.unix_micros(ts), F.lit(_BEFORE_ALL)).cast("decimal(18,0)")
    from_zero = event_id.cast("decimal(19,0)") + F.lit(decimal.Decimal(2 ** 63))
    return (micros * F.lit(decimal.Decimal(2 * 10 ** 19)) + from_zero).cast("decimal(38,0)")


def fold_cart_events(events: DataFrame, base: DataFrame | None = None,
                     user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> CartFold:
    """Fold delta / set / remove events per (user, product) in
    (ts, event_id) order onto an optional starting cart ``base``.

    delta adds to the line (inserting it when absent); set replaces it,
    and a set <= 0 or a remove deletes it; a delta may leave a line <= 0.

    The fold is exact without ordering the events of a key: the last
    reset (set / remove / starting line) per key is a ``max`` aggregate,
    and the deltas after it are a ``sum`` aggregate behind a left join
    with that one-row-per-key result.  Both aggregates combine partially
    in every map task, so a key holding a third of all events is never
    sorted or buffered whole in one task (a per-key window would be).
    """
    ev = events.select("event_id", "ts", "UserID", "ProductID", "op", "qty")
    if user_roles is not None and roles is not None:
        shop_users = users_with_role(user_roles, roles, "User")
        rejects = (ev.join(shop_users, "UserID", "left_anti")
                   .withColumn("reason", F.lit(NOT_A_SHOP_USER)))
        ev = ev.join(shop_users, "UserID", "left_semi")
    else:
        rejects = ev.limit(0).withColumn("reason", F.lit(None).cast("string"))

    if base is not None:
        start = base.select(F.lit(-(2 ** 63)).cast("long").alias("event_id"),
                            F.lit(dt.datetime(1, 1, 1)).cast("timestamp").alias("ts"), *KEYS,
                            F.lit("base").alias("op"), F.col("Quantity").cast("int").alias("qty"))
        ev = ev.unionByName(start)
    ev = ev.withColumn("__pos", event_position(F.col("ts"), F.col("event_id")))
    # Pass 1: where the last reset (set / remove / starting line) of every key stands.
    last_reset = (ev.filter(F.col("op") != "delta").groupBy(*KEYS).agg(F.max("__pos").alias("__reset")))
    # Pass 2: every event meets its key's last reset once (a left join the
    # skew handling can split); one aggregate then gives the reset's
    # verdict and the deltas after it, so no key needs a second join.
    is_reset = (F.col("op") != "delta") & (F.col("__pos") == F.col("__reset"))
    keep = is_reset & (((F.col("op") == "set") & (F.col("qty") > 0)) | (F.col("op") == "base"))   # a base row may be <= 0
    after = (F.col("op") == "delta") & (F.col("__reset").isNull() | (F.col("__pos") > F.col("__reset")))
    folded = (ev.join(last_reset, KEYS, "left")
              .groupBy(*KEYS)
              .agg(F.max(F.coalesce(keep, F.lit(False))).alias("kept"),
                   F.max(F.when(keep, F.col("qty"))).alias("value"),
                   F.sum(F.when(after, F.col("qty"))).alias("added"),
                   F.count(F.when(after, F.lit(1))).alias("n_after")))
    present = F.col("kept") | (F.col("n_after") > 0)
    quantity = (F.when(F.col("kept"), F.col("value")).otherwise(F.lit(0))
                + F.coalesce(F.col("added"), F.lit(0)))
    items = folded.filter(present).select(*KEYS, quantity.cast("int").alias("Quantity"))
    return CartFold(items=items, rejects=rejects)


def fold_cart_events_document(events: DataFrame, user_roles: DataFrame | None = None,
                              roles: DataFrame | None = None) -> CartFold:
    """D2, document twin: every add (``delta``) inserts a new cart line
    with its quantity, even for a product already in the cart; a
    ``remove`` deletes one line of that product -- the oldest -- or
    nothing when there is none.  ``set`` has no document form: such events
    are rejected.  Result: one row per surviving line (``LineID`` = the
    inserting event).

    Exact and order-free per key: with +1 per add and -1 per remove in
    (ts, event_id) order, the number of surviving lines is the final
    running sum minus its lowest prefix below zero (a queue that cannot
    go negative), and removal from the front leaves the newest lines.
    Both running sums use ``running_total``, which cuts a hot key into
    slices instead of holding it in one task.
    """
    from bazaar.operators.scan import running_total

    ev = events.select("event_id", "ts", "UserID", "ProductID", "op", "qty")
    if user_roles is not None and roles is not None:
        shop_users = users_with_role(user_roles, roles, "User")
        rejects = (ev.join(shop_users, "UserID", "left_anti")
                   .withColumn("reason", F.lit(NOT_A_SHOP_USER)))
        ev = ev.join(shop_users, "UserID", "left_semi")
    else:
        rejects = ev.limit(0).withColumn("reason", F.lit(None).cast("string"))
    rejects = rejects.unionByName(ev.filter(~F.col("op").isin("delta", "remove"))
                                  .withColumn("reason", F.lit(NO_DOCUMENT_FORM)))
    ops = (ev.filter(F.col("op").isin("delta", "remove"))
           .withColumn("step", F.when(F.col("op") == "delta", F.lit(1)).otherwise(F.lit(-1)).cast("long")))
    running = running_total(ops, KEYS, ["ts", "event_id"], "step", "depth")
    survivors = (running.groupBy(*KEYS)
                 .agg((F.sum("step") - F.least(F.min("depth"), F.lit(0))).alias("kept")))
    adds = (running.filter(F.col("op") == "delta")
            .select(*KEYS, "event_id", "qty", (-F.unix_micros("ts")).alias("__back_ts"),
                    (-F.col("event_id")).alias("__back_id"), F.lit(1).cast("long").alias("__one")))
    newest_first = running_total(adds, KEYS, ["__back_ts", "__back_id"], "__one", "from_newest")
    items = (newest_first.join(survivors, KEYS, "inner")
             .filter(F.col("from_newest") <= F.col("kept"))
             .select(*KEYS, F.col("event_id").alias("LineID"), F.col("qty").alias("Quantity")))
    return CartFold(items=items, rejects=rejects)


# Shared -------------------------------------------------------------------------
NOT_FOUND = "unknown id"
DUPLICATE_CODE = "duplicate code"
CODE_AND_PERCENT_REQUIRED = "code and percent required"
PERCENT_RANGE = "percent must be 1-100"
DATES_IN_PAST = "dates in the past"
USED_IN_ORDERS = "product used in orders"
REQUIRED_FIELDS = "required fields missing"
USERNAME_TAKEN = "username taken"
EMAIL_TAKEN = "email taken"
DUPLICATE_IN_BATCH = "duplicate in batch"
UNKNOWN_ROLE = "unknown role"


@dataclass
class WriteResult:
    tables: dict          # name -> new state (DataFrame)
    rejects: DataFrame    # rejected request rows + reason


def first_per_key(requests: DataFrame, key: list[str], order: list[str],
                  last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split requests into the first (``last``: the last) one per key by
    ``order`` and the others.  Requests that tie on ``order`` are ranked
    by their other columns, and of identical requests one is taken, so
    there is never more than one per key; a null key is a key.

    The pick is ``min``/``max`` of a struct of the whole row (combined in
    every map task, so a hot key is never sorted whole in one task); the
    others are found by a join with the one row per key."""
    cols = requests.columns
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in cols if c not in order]]])
    pick = F.max if last else F.min
    firsts = requests.groupBy(*key).agg(pick(row).alias("__first"))
    first = firsts.select(*[F.col("__first")[c].alias(c) for c in cols])
    keyed = firsts.select(*[F.col(k).alias(f"__k_{k}") for k in key], "__first")
    same_key = F.lit(True)
    for k in key:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    tagged = requests.join(keyed, same_key, "inner").withColumn("__same", row.eqNullSafe(F.col("__first")))
    # identical copies of the pick: all but one are others
    copies = (tagged.filter("__same").groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
              .withColumn("__copy", F.explode(F.sequence(F.lit(2).cast("long"), F.col("__n")))).select(*cols))
    later = tagged.filter(~F.col("__same")).select(*cols).unionByName(copies)
    return first, later


def _order_struct(order: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in order])


def _gate_actor(requests: DataFrame, user_roles: DataFrame | None, roles: DataFrame | None,
                role: str, actor_col: str = "ActorID") -> tuple[DataFrame, DataFrame]:
    """Requests whose actor holds ``role``; the others become rejects.
    Without the role tables, or without an actor column, nobody is tested."""
    if user_roles is None or roles is None or actor_col not in requests.columns:
        return requests, requests.limit(0).withColumn("reason", F.lit(None).cast("string"))
    cols = requests.columns
    allowed = users_with_role(user_roles, roles, role).select(F.col("UserID").alias(actor_col))
    ok = requests.join(allowed, actor_col, "left_semi").select(*cols)
    bad = requests.join(allowed, actor_col, "left_anti").select(*cols).withColumn(
        "reason", F.lit(NOT_A_SHOP_USER if role == "User" else NOT_AN_ADMIN))
    return ok, bad


def _minus(table: DataFrame, keys: DataFrame, on) -> DataFrame:
    """``table`` without the rows matching ``keys`` (anti join), in the
    table's own column order."""
    return table.join(keys, on, "left_anti").select(*table.columns)


def _reject(df: DataFrame, cond, reason: str) -> tuple[DataFrame, DataFrame]:
    """Split off rows where ``cond`` is true as rejects with ``reason``."""
    c = F.coalesce(cond, F.lit(False))
    return df.filter(~c), df.filter(c).withColumn("reason", F.lit(reason))


# D3 -----------------------------------------------------------------------------
def add_promocodes(existing: DataFrame, requests: DataFrame, as_of, rules: str = "sql",
                   user_roles: DataFrame | None = None, roles: DataFrame | None = None,
                   order: list[str] | None = None) -> WriteResult:
    """New promo codes.  ``requests``: Code, DiscountPercent, IsGlobal,
    CategoryID, ValidFrom, ValidTo (nullable), optional ActorID, plus the
    ``order`` columns that rank requests of one batch (first wins).

    sql rules: admin actor; code and a non-zero percent required; percent
    1-100; category nulled when global; defaults from = as_of, to =
    as_of + 1 year; code already taken or used earlier in the batch ->
    reject; from or to before as_of -> reject.  document rules: only the
    duplicate-code test.  With ``as_of=None`` "now" is each request's own
    ``request_ts``.
    """
    order = order or ["Code"]
    now = as_timestamp(as_of) if as_of is not None else F.col("request_ts")
    req, rej_actor = _gate_actor(requests, user_roles, roles, "Admin")
    rejects = [rej_actor]
    if rules == "sql":
        req, r = _reject(req, F.col("Code").isNull() | (F.col("Code") == "")
                         | F.col("DiscountPercent").isNull() | (F.col("DiscountPercent") == 0),
                         CODE_AND_PERCENT_REQUIRED)
        rejects.append(r)
        req, r = _reject(req, (F.col("DiscountPercent") <= 0) | (F.col("DiscountPercent") > 100), PERCENT_RANGE)
        rejects.append(r)
        req = (req.withColumn("CategoryID", F.when(F.coalesce(F.col("IsGlobal"), F.lit(False)),
                                                   F.lit(None).cast("long")).otherwise(F.col("CategoryID")))
               .withColumn("ValidFrom", F.coalesce(F.col("ValidFrom"), now))
               .withColumn("ValidTo", F.coalesce(F.col("ValidTo"), now + F.expr("INTERVAL 12 MONTHS"))))
    taken = existing.select("Code").distinct().withColumn("__taken", F.lit(True))
    req, r = _reject(req.join(taken, "Code", "left"), F.col("__taken"), DUPLICATE_CODE)
    req, r = req.drop("__taken"), r.drop("__taken")
    rejects.append(r)
    late = req.limit(0)
    if rules == "sql":
        # A request refused for its dates adds nothing, so it cannot block a later one.
        past = F.coalesce((F.col("ValidFrom") < now) | (F.col("ValidTo") < now), F.lit(False))
        req, late = req.filter(~past), req.filter(past)
    first, later = first_per_key(req, ["Code"], order)
    rejects.append(later.withColumn("reason", F.lit(DUPLICATE_CODE)))
    if rules == "sql":
        winner = first.select(F.col("Code").alias("__code"), _order_struct(order).alias("__won"))
        reason = F.when(_order_struct(order) > F.col("__won"), F.lit(DUPLICATE_CODE)).otherwise(F.lit(DATES_IN_PAST))
        rejects.append(late.join(winner, late["Code"] == winner["__code"], "left")
                       .select(*late.columns, reason.alias("reason")))
    cols = ["Code", "DiscountPercent", "IsGlobal", "CategoryID", "ValidFrom", "ValidTo"]
    added = next_ids(first.select(*cols, *[c for c in order if c not in cols]), order,
                     max_id(existing, "PromoID"), "PromoID").select("PromoID", *cols)
    out = existing.select("PromoID", *cols).unionByName(added)
    return WriteResult(tables={"promocodes": out, "added": added}, rejects=_union_rejects(rejects))


def _union_rejects(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# D4 -----------------------------------------------------------------------------
def delete_promocodes(promocodes: DataFrame, orders: DataFrame, ids: DataFrame, rules: str = "sql",
                      user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> WriteResult:
    """Remove promos by id.  sql: unknown id rejected, orders that used a
    removed promo get PromoID null.  document: orders keep the dead id,
    unknown ids are a no-op.  With an ``ActorID`` column in ``ids`` and
    the role tables, requests of actors that are no admin are rejected.

    Orders are not shuffled on PromoID (few values, a hot null): the known
    ids are broadcast when a count proves them few."""
    want, not_admin = _gate_actor(ids.select(*[c for c in ("ActorID", "PromoID") if c in ids.columns]).distinct(),
                                  user_roles, roles, "Admin")
    want = want.select("PromoID").distinct()
    known = want.join(promocodes.select("PromoID"), "PromoID", "left_semi")
    unknown = (want.join(promocodes.select("PromoID"), "PromoID", "left_anti")
               .withColumn("reason", F.lit(NOT_FOUND)))
    if rules != "sql":
        unknown = unknown.limit(0)
    new_promos = _minus(promocodes, known, "PromoID")
    if rules == "sql":
        gone = known.select(F.col("PromoID").alias("__gone"))
        new_orders = (orders.join(gone, orders["PromoID"] == gone["__gone"], "left")
                      .withColumn("PromoID", F.when(F.col("__gone").isNotNull(), F.lit(None).cast("long"))
                                  .otherwise(F.col("PromoID")))
                      .select(*orders.columns))
    else:
        new_orders = orders
    return WriteResult(tables={"promocodes": new_promos, "orders": new_orders},
                       rejects=_union_rejects([unknown, not_admin]))


# D5 -----------------------------------------------------------------------------
def delete_products(products: DataFrame, ids: DataFrame, favorites: DataFrame, cart_items: DataFrame,
                    order_items: DataFrame, mode: str = "restrict",
                    user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> WriteResult:
    """Remove products.  restrict: a product named by an order line is
    rejected, the rest are removed with their favorites and cart lines.
    cascade_all: order lines go too.  plain: products only.  With an
    ``ActorID`` column in ``ids`` and the role tables, requests of actors
    that are no admin are rejected.

    Order lines are reduced to their distinct products first (partial
    aggregate), so a product with a third of all lines is one row per task."""
    want, not_admin = _gate_actor(ids.select(*[c for c in ("ActorID", "ProductID") if c in ids.columns]).distinct(),
                                  user_roles, roles, "Admin")
    want = want.select("ProductID").distinct()
    rejects = want.limit(0).withColumn("reason", F.lit(None).cast("string"))
    if mode == "restrict":
        used = order_items.select("ProductID").distinct().withColumn("__used", F.lit(True))
        flagged = want.join(used, "ProductID", "left")
        rejects = flagged.filter("__used").select("ProductID", F.lit(USED_IN_ORDERS).alias("reason"))
        want = flagged.filter(F.col("__used").isNull()).select("ProductID")
    elif mode not in ("cascade_all", "plain"):
        raise ValueError(f"unknown mode {mode!r}")
    tables = {"products": _minus(products, want, "ProductID")}
    if mode != "plain":
        tables["favorites"] = _minus(favorites, want, "ProductID")
        tables["cart_items"] = _minus(cart_items, want, "ProductID")
    tables["order_items"] = (_minus(order_items, want, "ProductID") if mode == "cascade_all"
                             else order_items)
    return WriteResult(tables=tables, rejects=_union_rejects([rejects, not_admin]))


# D6 -----------------------------------------------------------------------------
def delete_users(shop, ids: DataFrame, cart_items: DataFrame | None = None) -> WriteResult:
    """Remove accounts with everything that hangs off them: favorites,
    cart lines, roles, the lines of their orders, their orders."""
    want = ids.select("UserID").distinct()
    gone_orders = shop.orders.join(want, "UserID", "left_semi").select("OrderID")
    carts = cart_items if cart_items is not None else shop.cart_items
    return WriteResult(tables={
        "users": _minus(shop.users, want, "UserID"),
        "favorites": _minus(shop.favorites, want, "UserID"),
        "cart_items": _minus(carts, want, "UserID"),
        "user_roles": _minus(shop.user_roles, want, "UserID"),
        "order_items": _minus(shop.order_items, gone_orders, "OrderID"),
        "orders": _minus(shop.orders, want, "UserID"),
    }, rejects=want.limit(0).withColumn("reason", F.lit(None).cast("string")))


# D7 -----------------------------------------------------------------------------
PRODUCT_COLS = ["ProductName", "Description", "CategoryID", "Price", "StockQuantity", "ImageURL"]


def upsert_products(existing: DataFrame, rows: DataFrame, order: list[str] | None = None,
                    user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> WriteResult:
    """Add rows without ProductID (new ids), overwrite every column of
    rows with a known ProductID; an unknown id is a no-op.  Required
    fields must be non-empty and non-zero (so price or stock 0 is refused).
    Of several updates of one id the last in ``order`` stands (ties: the
    largest row).  With an ``ActorID`` column and the role tables, rows of
    actors that are no admin are rejected."""
    rows, not_admin = _gate_actor(rows, user_roles, roles, "Admin")
    def blank(c):     # JS falsy: null, "" or 0
        if isinstance(rows.schema[c].dataType, T.StringType):
            return F.col(c).isNull() | (F.col(c) == "")
        return F.col(c).isNull() | (F.col(c) == 0)
    # An update names its product; id 0 counts as missing, as in the API.
    missing = blank("ProductName") | blank("Description") | blank("CategoryID") | blank("Price") \
        | blank("StockQuantity") | (F.col("ProductID") == 0)
    ok, rejects = _reject(rows, missing, REQUIRED_FIELDS)
    updates = ok.filter(F.col("ProductID").isNotNull())
    adds = ok.filter(F.col("ProductID").isNull())
    updates, _ = first_per_key(updates, ["ProductID"], order or [], last=True)
    upd = updates.select("ProductID", *[F.col(c).alias(f"__new_{c}") for c in PRODUCT_COLS])
    merged = existing.join(upd, "ProductID", "left")
    has = F.col("__new_ProductName").isNotNull()
    updated = merged.select("ProductID", *[F.when(has, F.col(f"__new_{c}")).otherwise(F.col(c))
                                           .cast(existing.schema[c].dataType).alias(c) for c in PRODUCT_COLS])
    order_cols = order or ["ProductName", "Description"]
    new_rows = next_ids(adds.select(*PRODUCT_COLS, *[c for c in order_cols if c not in PRODUCT_COLS]),
                        order_cols, max_id(existing, "ProductID"), "ProductID")
    new_rows = new_rows.select("ProductID", *[F.col(c).cast(existing.schema[c].dataType).alias(c)
                                              for c in PRODUCT_COLS])
    return WriteResult(tables={"products": updated.unionByName(new_rows), "added": new_rows},
                       rejects=_union_rejects([not_admin, rejects]))


def add_products_document(existing: DataFrame, rows: DataFrame, as_of, order: list[str] | None = None,
                          user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> WriteResult:
    """Document twin of D7's add: every row is inserted with a new id and
    stamped ``created_at`` = ``updated_at`` = ``as_of``; no field test.
    Actors are tested as in ``upsert_products``."""
    rows, not_admin = _gate_actor(rows, user_roles, roles, "Admin")
    order_cols = order or ["ProductName", "Description"]
    new_rows = next_ids(rows.select(*PRODUCT_COLS, *[c for c in order_cols if c not in PRODUCT_COLS]),
                        order_cols, max_id(existing, "ProductID"), "ProductID")
    stamp = as_timestamp(as_of).cast("timestamp")
    added = new_rows.select("ProductID", *[F.col(c).cast(existing.schema[c].dataType).alias(c)
                                           for c in PRODUCT_COLS],
                            stamp.alias("created_at"), stamp.alias("updated_at"))
    return WriteResult(tables={"added": added}, rejects=not_admin)


# D8 -----------------------------------------------------------------------------
def patch_products(existing: DataFrame, patches: DataFrame, as_of, order: list[str] | None = None,
                   user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> WriteResult:
    """Partial update: ``patches`` = (ProductID, patch map<string,string>,
    the ``order`` columns).  Only the keys present in a patch change (a key
    with a null value sets null); ``updated_at`` is set on patched rows;
    unknown ids are rejected.  Several patches of one product are merged:
    for every field the last in ``order`` stands (ties: the largest value),
    as if they were applied one after the other.  The merge is an aggregate
    per (product, field), never a list of a product's patches.  With an
    ``ActorID`` column and the role tables, patches of actors that are no
    admin are rejected.  A patch with a value that its column cannot hold is
    rejected whole (as the call that carries it would be) and changes
    nothing; the other patches go on."""
    order = order or []
    patches, not_admin = _gate_actor(patches, user_roles, roles, "Admin")
    given = F.col("patch")
    malformed = F.lit(False)
    for c in PRODUCT_COLS:
        value = given.getItem(c)
        malformed = malformed | (value.isNotNull() & value.try_cast(existing.schema[c].dataType).isNull())
    patches, unfit = _reject(patches, malformed, MALFORMED_VALUE)
    fields = (patches.select("ProductID", *order, F.explode("patch").alias("field", "value"))
              .filter(F.col("field").isin(PRODUCT_COLS)))
    last = fields.groupBy("ProductID", "field").agg(
        F.max(F.struct(*order, F.col("value").isNull().alias("n"), "value"))["value"].alias("value"))
    merged_patch = last.groupBy("ProductID").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__patch"))
    p = (patches.select("ProductID").distinct().withColumn("__patched", F.lit(True))
         .join(merged_patch, "ProductID", "left"))
    merged = existing.join(p, "ProductID", "left")
    cols = []
    for c in PRODUCT_COLS:
        present = F.coalesce(F.map_contains_key(F.col("__patch"), F.lit(c)), F.lit(False))
        new = F.col("__patch").getItem(c).try_cast(existing.schema[c].dataType)
        cols.append(F.when(present, new).otherwise(F.col(c)).alias(c))
    updated_at = F.when(F.col("__patched"), as_timestamp(as_of)).cast("timestamp").alias("updated_at")
    out = merged.select("ProductID", *cols, updated_at)
    unknown = (patches.join(existing.select("ProductID"), "ProductID", "left_anti").select(*patches.columns)
               .withColumn("reason", F.lit(NOT_FOUND)))
    return WriteResult(tables={"products": out}, rejects=_union_rejects([unknown, not_admin, unfit]))


# D9 -----------------------------------------------------------------------------
def edit_favorites(existing: DataFrame, adds: DataFrame, removes: DataFrame,
                   user_roles: DataFrame | None = None, roles: DataFrame | None = None,
                   order: list[str] | None = None) -> WriteResult:
    """Adds are appended (duplicates kept); a remove deletes every copy of
    its (user, product) that is there at its time.  ``order`` names the
    columns of both frames that place the calls in time: an add after the
    last remove of its key survives.  Without ``order`` all removes come
    after all adds.  Only role-User users may do either.

    The last remove of a key is an aggregate; adds and the existing rows
    meet it once in a join."""
    order = order or []
    a = adds.select("UserID", "ProductID", *order).withColumn("op", F.lit("add"))
    r = removes.select("UserID", "ProductID", *order).withColumn("op", F.lit("remove"))
    if user_roles is not None and roles is not None:
        shop_users = users_with_role(user_roles, roles, "User")
        rejects = (a.unionByName(r).join(shop_users, "UserID", "left_anti")
                   .select("UserID", "ProductID", "op", F.lit(NOT_A_SHOP_USER).alias("reason")))
        a = a.join(shop_users, "UserID", "left_semi")
        r = r.join(shop_users, "UserID", "left_semi")
    else:
        rejects = a.limit(0).select("UserID", "ProductID", "op", F.lit(None).cast("string").alias("reason"))
    if not order:
        out = _minus(existing.select(*KEYS).unionByName(a.select(*KEYS)), r.select(*KEYS).distinct(), KEYS)
        return WriteResult(tables={"favorites": out}, rejects=rejects)
    last = r.groupBy(*KEYS).agg(F.max(_order_struct(order)).alias("__removed"))
    at = _order_struct(order)
    kept = (a.select(*KEYS, at.alias("__at"))
            .unionByName(existing.select(*KEYS, F.lit(None).cast(a.select(at.alias("x")).schema["x"].dataType).alias("__at"))))
    out = (kept.join(last, KEYS, "left")
           .filter(F.col("__removed").isNull() | (F.col("__at") > F.col("__removed"))).select(*KEYS))
    return WriteResult(tables={"favorites": out}, rejects=rejects)


def edit_favorites_document(existing: DataFrame, adds: DataFrame, removes: DataFrame,
                            user_roles: DataFrame | None = None, roles: DataFrame | None = None) -> WriteResult:
    """D9, document twin: favorites carry their own ``FavoriteID``.  Adds
    (UserID, ProductID, FavoriteID) are appended; a remove (UserID,
    FavoriteID) deletes that one favorite when it belongs to that user,
    and is a no-op otherwise.  Only role-User users may do either."""
    a = adds.select("FavoriteID", "UserID", "ProductID")
    r = removes.select("UserID", "FavoriteID")
    if user_roles is not None and roles is not None:
        shop_users = users_with_role(user_roles, roles, "User")
        rejects = (a.select("UserID", "FavoriteID").withColumn("op", F.lit("add"))
                   .unionByName(r.withColumn("op", F.lit("remove")))
                   .join(shop_users, "UserID", "left_anti").withColumn("reason", F.lit(NOT_A_SHOP_USER)))
        a = a.join(shop_users, "UserID", "left_semi")
        r = r.join(shop_users, "UserID", "left_semi")
    else:
        rejects = r.limit(0).withColumn("op", F.lit(None).cast("string")).withColumn(
            "reason", F.lit(None).cast("string"))
    table = existing.select("FavoriteID", "UserID", "ProductID").unionByName(a)
    out = _minus(table, r.distinct(), ["FavoriteID", "UserID"])
    return WriteResult(tables={"favorites": out}, rejects=rejects)


# D10 ----------------------------------------------------------------------------
def register_users(users: DataFrame, user_roles: DataFrame, roles: DataFrame, rows: DataFrame,
                   rules: str = "sql", order: list[str] | None = None) -> WriteResult:
    """New accounts with one role each (``RoleName``, default 'User').

    sql: Username and Email must be new (against the table and the accounts
    accepted earlier in the batch, in ``order``); an unknown role rejects
    the account, which then blocks nobody.  document: no uniqueness test,
    and the account is kept even when its role is unknown (it is written
    before the role lookup), just without a role.  With an ``ActorID``
    column, rows that name an actor who is no admin are rejected (a null
    actor registers itself).
    """
    order = order or ["Username", "Email"]
    cols = rows.columns
    req = rows.withColumn("RoleName", F.coalesce(F.col("RoleName"), F.lit("User")))
    role_ids = roles.select("RoleName", "RoleID")
    rejects = []
    if "ActorID" in cols:
        admins = users_with_role(user_roles, roles, "Admin").select(F.col("UserID").alias("ActorID"))
        asked = req.filter(F.col("ActorID").isNotNull())
        rejects.append(asked.join(admins, "ActorID", "left_anti").select(*cols).withColumn("reason", F.lit(NOT_AN_ADMIN)))
        req = asked.join(admins, "ActorID", "left_semi").select(*cols).unionByName(req.filter(F.col("ActorID").isNull()))
    if rules == "sql":
        for col, reason in (("Username", USERNAME_TAKEN), ("Email", EMAIL_TAKEN)):
            taken = users.select(col).distinct().withColumn("__t", F.lit(True))
            req, r = _reject(req.join(taken, col, "left"), F.col("__t"), reason)
            req = req.select(*cols)
            rejects.append(r.select(*cols, "reason"))
        known = req.join(role_ids, "RoleName", "left_semi").select(*cols)
        unknown = req.join(role_ids, "RoleName", "left_anti").select(*cols)
        req, blocked = _accept_in_order(known, ["Username", "Email"], order)
        rejects.append(blocked.withColumn("reason", F.lit(DUPLICATE_IN_BATCH)))
        at, won = _order_struct(order), req
        for i, col in enumerate(("Username", "Email")):
            names = won.select(F.col(col).alias(f"__v{i}"), at.alias(f"__at{i}"))
            unknown = unknown.join(names, F.col(col) == F.col(f"__v{i}"), "left")
        after = F.coalesce(at > F.col("__at0"), F.lit(False)) | F.coalesce(at > F.col("__at1"), F.lit(False))
        rejects.append(unknown.select(*cols, F.when(after, F.lit(DUPLICATE_IN_BATCH)).otherwise(F.lit(UNKNOWN_ROLE)).alias("reason")))
    else:
        rejects.append(req.join(role_ids, "RoleName", "left_anti").select(*cols).withColumn("reason", F.lit(UNKNOWN_ROLE)))
    keep = ["Username", "PasswordHash", "Email", "RoleName"]
    new = next_ids(req.select(*keep, *[c for c in order if c not in keep]), order,
                   max_id(users, "UserID"), "UserID")
    new_users = new.select("UserID", "Username", "PasswordHash", "Email")
    new_roles = new.join(role_ids, "RoleName", "inner").select("UserID", "RoleID")
    return WriteResult(tables={"users": users.select("UserID", "Username", "PasswordHash", "Email")
                               .unionByName(new_users),
                               "user_roles": user_roles.select("UserID", "RoleID").unionByName(new_roles),
                               "added_users": new_users, "added_roles": new_roles},
                       rejects=_union_rejects(rejects))


def _accept_in_order(requests: DataFrame, unique: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests accepted when taken one after the other in ``order``, each
    refused if an accepted one before it has the same value in one of the
    ``unique`` columns (nulls never clash), and the refused ones.

    Set-based rounds: the first undecided request of each of its values is
    accepted, and undecided ones that share a value with an accepted one
    are refused.  The first undecided request of all is always decided, so
    the rounds end; every round is written under the checkpoint folder.
    Ties are ranked by the other columns; of identical requests one counts.
    """
    cols = requests.columns
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in cols if c not in order]]])
    counted = write_checkpoint(requests.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__row", row), "accept")
    undecided, accepted = counted, None
    while not undecided.isEmpty():
        picked = undecided
        for i, c in enumerate(unique):
            first = undecided.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("__row").alias(f"__f{i}"))
            picked = picked.join(first, c, "left").filter(F.col(c).isNull() | (F.col("__row") == F.col(f"__f{i}")))
        picked = write_checkpoint(picked.select(*counted.columns), "accept")
        accepted = picked if accepted is None else accepted.unionByName(picked)
        rest = undecided.join(picked.select(F.col("__row").alias("__p")), F.col("__row") == F.col("__p"), "left_anti")
        for c in unique:
            rest = rest.join(picked.select(F.col(c).alias("__v")).filter("__v is not null").distinct(), F.col(c) == F.col("__v"), "left_anti")
        undecided = write_checkpoint(rest.select(*counted.columns), "accept")
    if accepted is None:
        return requests, requests.limit(0)
    won = accepted.select(F.col("__row").alias("__p"))
    lost = counted.join(won, F.col("__row") == F.col("__p"), "left_anti").withColumn("__copies", F.col("__n"))
    extra = accepted.withColumn("__copies", F.col("__n") - 1)
    refused = lost.select(*cols, "__copies").unionByName(extra.select(*cols, "__copies")).filter("__copies > 0")
    refused = refused.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*cols)
    return accepted.select(*cols), refused


# D12 ----------------------------------------------------------------------------
def integrity_report(shop, cart_items: DataFrame | None = None) -> DataFrame:
    """Rows (check, key, n): duplicates against the shop's unique
    indexes, orphan foreign keys and inverted promo windows -- what the
    database enforced and parquet does not."""
    carts = cart_items if cart_items is not None else shop.cart_items

    def dups(df, cols, name):
        k = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                .select(F.lit(name).alias("check"), k.alias("key"), "n"))

    def orphans(df, col, parent, pcol, name):
        # Key first: one row per key and task is shuffled, not the child's rows.
        child = (df.select(F.col(col).alias("__k")).filter(F.col("__k").isNotNull())
                 .groupBy("__k").agg(F.count(F.lit(1)).alias("n")))
        par = parent.select(F.col(pcol).alias("__k"))
        return (child.join(par, "__k", "left_anti")
                .select(F.lit(name).alias("check"), F.col("__k").cast("string").alias("key"), "n"))

    parts = [
        dups(shop.users, ["Username"], "duplicate Users.Username"),
        dups(shop.users, ["Email"], "duplicate Users.Email"),
        dups(shop.user_roles, ["UserID", "RoleID"], "duplicate UserRoles"),
        dups(carts, ["UserID", "ProductID"], "duplicate CartItems"),
        dups(shop.promocodes, ["Code"], "duplicate Promocodes.Code"),
        orphans(shop.products, "CategoryID", shop.categories, "CategoryID", "orphan Products.CategoryID"),
        orphans(shop.order_items, "ProductID", shop.products, "ProductID", "orphan OrderItems.ProductID"),
        orphans(shop.order_items, "OrderID", shop.orders, "OrderID", "orphan OrderItems.OrderID"),
        orphans(shop.orders, "UserID", shop.users, "UserID", "orphan Orders.UserID"),
        orphans(shop.orders, "PromoID", shop.promocodes, "PromoID", "orphan Orders.PromoID"),
        orphans(shop.favorites, "UserID", shop.users, "UserID", "orphan Favorites.UserID"),
        orphans(shop.favorites, "ProductID", shop.products, "ProductID", "orphan Favorites.ProductID"),
        orphans(carts, "ProductID", shop.products, "ProductID", "orphan CartItems.ProductID"),
        orphans(shop.user_roles, "RoleID", shop.roles, "RoleID", "orphan UserRoles.RoleID"),
        (shop.promocodes.filter(F.col("ValidTo") < F.col("ValidFrom"))
         .select(F.lit("inverted promo window").alias("check"), F.col("PromoID").cast("string").alias("key"),
                 F.lit(1).cast("long").alias("n"))),
    ]
    return _union_rejects(parts)
