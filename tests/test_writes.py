"""Writes: the cart fold against a sequential brute force, checkout
invariants and one case per reject reason."""
import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.operators import checkout as K
from bazaar.operators import writes as W
from bazaar.operators.ids import next_ids
from bazaar.sources import tables as Tb
from conftest import AS_OF, rows
from shopfix import small_shop

T0 = dt.datetime(2024, 1, 1)


def brute_fold(events, base=None):
    """The shop's procedures applied one event at a time."""
    cart = dict(base or {})
    for eid, ts, u, p, op, q in sorted(events, key=lambda e: (e[1], e[0])):
        k = (u, p)
        if op == "delta":
            cart[k] = cart.get(k, 0) + q
        elif op == "set" and q > 0:
            cart[k] = q
        else:
            cart.pop(k, None)
    return sorted((u, p, q) for (u, p), q in cart.items())


def test_fold_cases(spark):
    ev = [(1, T0, 1, 1, "set", 0), (2, T0 + dt.timedelta(1), 1, 1, "delta", 2),     # set 0 then delta
          (3, T0, 1, 2, "delta", -1),                                               # below zero kept
          (4, T0, 1, 3, "remove", None), (5, T0 + dt.timedelta(1), 1, 3, "delta", 1),  # remove then delta
          (7, T0, 1, 4, "set", 5), (6, T0, 1, 4, "remove", None),                   # same ts: id decides
          (8, T0, 1, 5, "set", 3), (9, T0 + dt.timedelta(2), 1, 5, "remove", None)]  # last is a delete
    df = spark.createDataFrame(ev, Tb.CART_EVENTS)
    assert rows(W.fold_cart_events(df).items) == brute_fold(ev) == [(1, 1, 2), (1, 2, -1), (1, 3, 1), (1, 4, 5)]


def test_fold_matches_brute_force_random(spark):
    rnd = random.Random(7)
    ev = []
    for i in range(3000):
        op = rnd.choice(["delta", "delta", "set", "remove"])
        q = rnd.randint(-2, 4) if op == "delta" else (rnd.randint(-1, 4) if op == "set" else None)
        ev.append((i, T0 + dt.timedelta(minutes=rnd.randint(0, 400)), rnd.randint(1, 5), rnd.randint(1, 6), op, q))
    base = {(u, p): rnd.randint(-1, 3) for u in range(1, 6) for p in range(1, 4)}
    df = spark.createDataFrame(ev, Tb.CART_EVENTS)
    base_df = spark.createDataFrame([(u, p, q) for (u, p), q in base.items()], Tb.CART_ITEMS)
    assert rows(W.fold_cart_events(df).items) == brute_fold(ev)
    assert rows(W.fold_cart_events(df, base=base_df).items) == brute_fold(ev, base)


def test_fold_role_gate(spark):
    ev = [(1, T0, 10, 1, "delta", 1), (2, T0, 12, 1, "delta", 1)]
    shop = small_shop(spark)
    res = W.fold_cart_events(spark.createDataFrame(ev, Tb.CART_EVENTS), user_roles=shop.user_roles, roles=shop.roles)
    assert rows(res.items) == [(10, 1, 1)] and rows(res.rejects, "UserID", "reason") == [(12, W.NOT_A_SHOP_USER)]


def test_checkout_reasons_and_invariants(spark):
    cart = [(10, 1, 2), (10, 3, 1),     # ok, promo S50 (category 1) -> line 1 discounted
            (11, 2, 1),                  # Blue Cap stock 0 -> out of stock
            (12, 1, 1)]                  # user 12 is Admin only -> not a shop user
    shop = small_shop(spark, cart=cart,
                      users=[(10, "ann", None, "a"), (11, "bob", None, "b"), (12, "eve", None, "e"),
                             (13, "zed", None, "z")],
                      user_roles=[(10, 2), (11, 2), (12, 1), (13, 2)])
    req = spark.createDataFrame([(10, 2, AS_OF), (10, 3, AS_OF + dt.timedelta(1)), (11, None, AS_OF),
                                 (12, None, AS_OF), (13, 4, AS_OF)],
                                "UserID long, PromoID long, request_ts timestamp")
    res = K.checkout(shop, req, AS_OF)
    reasons = {r.UserID: r.reason for r in res.rejects.collect() if r.reason != K.DUPLICATE_REQUEST}
    assert reasons == {11: K.OUT_OF_STOCK, 12: K.NOT_A_SHOP_USER, 13: K.EMPTY_CART}
    assert rows(res.rejects.filter(F.col("reason") == K.DUPLICATE_REQUEST), "UserID", "PromoID") == [(10, 3)]
    assert rows(res.orders, "OrderID", "UserID", "PromoID", "StatusID") == [(104, 10, 2, 1)]
    assert rows(res.order_items, "ProductID", "Quantity", "UnitPrice") == [(1, 2, D("5.03")), (3, 1, D("50.00"))]
    before = {r.ProductID: r.StockQuantity for r in shop.products.collect()}
    after = {r.ProductID: r.StockQuantity for r in res.stock.collect()}
    sold = {r.ProductID: r.Quantity for r in res.order_items.collect()}
    assert all(before[p] - after[p] == sold.get(p, 0) for p in before)
    assert rows(res.carts) == [(11, 2, 1), (12, 1, 1)]
    # every request is accepted or rejected exactly once
    assert res.orders.count() + res.rejects.count() == req.count()


def test_checkout_non_positive_line(spark):
    shop = small_shop(spark, cart=[(10, 1, 0)])
    req = spark.createDataFrame([(10, None, AS_OF)], "UserID long, PromoID long, request_ts timestamp")
    assert [r.reason for r in K.checkout(shop, req, AS_OF).rejects.collect()] == [K.NON_POSITIVE]
    loose = K.checkout(shop, req, AS_OF, strict=False)
    assert loose.orders.count() == 1


def test_checkout_simple(spark):
    shop = small_shop(spark, cart=[(10, 2, 5)])
    req = spark.createDataFrame([(10, 3, AS_OF), (11, None, AS_OF)], "UserID long, PromoID long, request_ts timestamp")
    res = K.checkout_simple(shop, req)
    assert rows(res.order_items, "ProductID", "UnitPrice") == [(2, D("14.0000"))]  # expired promo still applies
    assert rows(res.rejects, "UserID", "reason") == [(11, K.EMPTY_CART)]


def test_next_ids_contiguous_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = next_ids(df, ["k"], 100, "nid").collect()
    assert sorted(r.nid for r in out) == list(range(101, 5101))
    assert all(r.nid == 101 + r.k for r in out)


def test_add_promocodes_rules(spark):
    shop = small_shop(spark)
    req = spark.createDataFrame([
        (1, 11, "NEW", 10, False, 1, None, None),                                          # ok, defaults
        (2, 11, "NEW", 15, False, 1, None, None),                                          # dup in batch
        (3, 11, "S10", 10, False, 1, None, None),                                          # code taken
        (4, 11, "", 10, False, 1, None, None),                                             # required
        (5, 11, "BIG", 150, False, 1, None, None),                                         # range
        (6, 11, "PAST", 5, True, 3, dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1)),     # in the past
        (7, 10, "NOPE", 5, False, 1, None, None),                                          # not an admin
        (8, 12, "GLOB", 5, True, 3, AS_OF, dt.datetime(2024, 3, 1)),                       # ok, category nulled
    ], "seq long, ActorID long, Code string, DiscountPercent int, IsGlobal boolean, CategoryID long, "
       "ValidFrom timestamp, ValidTo timestamp")
    res = W.add_promocodes(shop.promocodes, req, AS_OF, user_roles=shop.user_roles, roles=shop.roles, order=["seq"])
    assert rows(res.rejects, "seq", "reason") == [
        (2, W.DUPLICATE_CODE), (3, W.DUPLICATE_CODE), (4, W.CODE_AND_PERCENT_REQUIRED), (5, W.PERCENT_RANGE),
        (6, W.DATES_IN_PAST), (7, W.NOT_AN_ADMIN)]
    added = rows(res.tables["added"], "PromoID", "Code", "CategoryID", "ValidTo")
    assert added == [(5, "NEW", 1, dt.datetime(2025, 1, 15)), (6, "GLOB", None, dt.datetime(2024, 3, 1))]


def test_delete_promocodes_and_products_and_users(spark):
    shop = small_shop(spark, cart=[(10, 1, 1), (11, 3, 1)])
    ids = spark.createDataFrame([(1,), (9,)], "PromoID long")
    res = W.delete_promocodes(shop.promocodes, shop.orders, ids)
    assert rows(res.rejects, "PromoID") == [(9,)]
    assert rows(res.tables["orders"], "OrderID", "PromoID") == [(100, None), (101, None), (103, None)]
    doc = W.delete_promocodes(shop.promocodes, shop.orders, ids, rules="document")
    assert doc.rejects.count() == 0 and rows(doc.tables["orders"], "OrderID", "PromoID")[1] == (101, 1)

    pids = spark.createDataFrame([(1,), (3,)], "ProductID long")
    r = W.delete_products(shop.products, pids, shop.favorites, shop.cart_items, shop.order_items, "restrict")
    assert rows(r.rejects, "ProductID") == [(1,)]
    assert rows(r.tables["cart_items"]) == [(10, 1, 1)]
    r2 = W.delete_products(shop.products, pids, shop.favorites, shop.cart_items, shop.order_items, "cascade_all")
    assert rows(r2.tables["order_items"], "ProductID") == [(2,), (4,)]

    gone = W.delete_users(shop, spark.createDataFrame([(10,)], "UserID long"))
    assert rows(gone.tables["orders"], "OrderID") == [(101,)]
    assert rows(gone.tables["order_items"], "OrderID") == [(101,), (102,)]
    after = Tb.shop_from_tables(spark, {**{k: getattr(shop, k) for k in ["products", "categories", "promocodes",
                                                                       "roles", "order_statuses"]},
                                        **gone.tables})
    report = W.integrity_report(after)
    assert rows(report, "check", "key") == [("orphan OrderItems.OrderID", "102")]   # was orphan before, too


def test_upsert_and_patch(spark):
    shop = small_shop(spark)
    req = spark.createDataFrame([
        (1, 1, "Shirt2", "d", 1, D("11.00"), 4, None, 1),
        (2, None, "New", "d", 2, D("3.00"), 1, "u", 2),
        (3, 99, "Ghost", "d", 2, D("3.00"), 1, None, 3),
        (4, 2, "Cap2", "d", 2, D("0.00"), 1, None, 4),
    ], "seq long, ProductID long, ProductName string, Description string, CategoryID long, "
       "Price decimal(10,2), StockQuantity int, ImageURL string, src long")
    res = W.upsert_products(shop.products, req, order=["seq"])
    got = {r.ProductID: (r.ProductName, r.ImageURL) for r in res.tables["products"].collect()}
    assert got[1] == ("Shirt2", None) and got[5] == ("New", "u") and got[2][0] == "Blue Cap" and 99 not in got
    assert rows(res.rejects, "seq") == [(4,)]

    patches = spark.createDataFrame([(1, {"Price": "1.50"}), (2, {"ImageURL": None}), (77, {"Price": "1"})],
                                    "ProductID long, patch map<string,string>")
    p = W.patch_products(shop.products.withColumn("ImageURL", F.lit("x")), patches, AS_OF)
    out = {r.ProductID: r for r in p.tables["products"].collect()}
    assert out[1].Price == D("1.50") and out[1].ImageURL == "x" and out[1].updated_at == AS_OF
    assert out[2].ImageURL is None and out[3].updated_at is None
    assert rows(p.rejects, "ProductID") == [(77,)]


def test_edit_favorites_and_register(spark):
    shop = small_shop(spark)
    adds = spark.createDataFrame([(10, 2), (12, 3)], "UserID long, ProductID long")
    removes = spark.createDataFrame([(10, 1)], "UserID long, ProductID long")
    res = W.edit_favorites(shop.favorites, adds, removes, shop.user_roles, shop.roles)
    assert rows(res.tables["favorites"]) == [(10, 2), (11, 3), (12, 2)]
    assert rows(res.rejects, "UserID", "op") == [(12, "add")]

    reg = spark.createDataFrame([
        (1, "ann", "h", "n1@x", None), (2, "new", "h", "ann@x", None), (3, "dup", "h", "d1@x", "User"),
        (4, "dup", "h", "d2@x", "User"), (5, "guest", "h", "g@x", "Guest"), (6, "adm", "h", "a@x", "Admin"),
    ], "seq long, Username string, PasswordHash string, Email string, RoleName string")
    r = W.register_users(shop.users, shop.user_roles, shop.roles, reg, order=["seq"])
    assert rows(r.rejects, "seq", "reason") == [(1, W.USERNAME_TAKEN), (2, W.EMAIL_TAKEN),
                                                (4, W.DUPLICATE_IN_BATCH), (5, W.UNKNOWN_ROLE)]
    assert rows(r.tables["added_users"], "UserID", "Username") == [(13, "dup"), (14, "adm")]
    assert rows(r.tables["added_roles"]) == [(13, 2), (14, 1)]
    doc = W.register_users(shop.users, shop.user_roles, shop.roles, reg, rules="document", order=["seq"])
    assert doc.tables["added_users"].count() == 6 and doc.tables["added_roles"].count() == 5


def test_running_total_matches_brute_force_with_hot_key(spark):
    from bazaar.operators.scan import running_total
    rnd = random.Random(5)
    data = [(0 if i % 2 == 0 else rnd.randint(1, 30), i, rnd.randint(-2, 9)) for i in range(4000)]
    df = spark.createDataFrame(data, "k long, pos long, v long").repartition(6)
    got = {(r.k, r.pos): r.run for r in running_total(df, ["k"], ["pos"], "v", "run").collect()}
    acc, want = {}, {}
    for k, pos, v in sorted(data, key=lambda t: (t[0], t[1])):
        acc[k] = acc.get(k, 0) + v
        want[(k, pos)] = acc[k]
    assert got == want


def test_checkout_prefix_never_oversells(spark):
    shop = small_shop(spark, cart=[(10, 1, 3), (11, 1, 3)],
                      user_roles=[(10, 2), (11, 2)])
    req = spark.createDataFrame([(10, None, AS_OF), (11, None, AS_OF + dt.timedelta(seconds=1))],
                                "UserID long, PromoID long, request_ts timestamp")
    snap = K.checkout(shop, req, AS_OF, stock="snapshot")
    assert snap.orders.count() == 2 and rows(snap.oversold, "ProductID", "Sold") == [(1, 6)]
    pre = K.checkout(shop, req, AS_OF, stock="prefix")
    assert rows(pre.orders, "UserID") == [(10,)]
    assert rows(pre.rejects, "UserID", "reason") == [(11, K.OUT_OF_STOCK)]
    assert {r.ProductID: r.StockQuantity for r in pre.stock.collect()}[1] == 2


def test_integrity_report_finds_duplicates_orphans_and_inverted_windows(spark):
    shop = small_shop(spark, users=[(10, "ann", None, "a@x"), (11, "ann", None, "b@x")],
                      user_roles=[(10, 2), (10, 2), (11, 9)],
                      promos=[(1, "A", 5, False, 1, dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)),
                              (2, "A", 5, False, 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))],
                      cart=[(10, 1, 1), (10, 1, 2)])
    got = {(r["check"], r["key"]) for r in W.integrity_report(shop).collect()}
    assert {("duplicate Users.Username", "ann"), ("duplicate UserRoles", "10|2"), ("duplicate CartItems", "10|1"),
            ("duplicate Promocodes.Code", "A"), ("orphan UserRoles.RoleID", "9"),
            ("orphan OrderItems.OrderID", "102"), ("inverted promo window", "1")} <= got


def test_add_products_document_stamps_and_ids(spark):
    shop = small_shop(spark)
    rows_df = spark.createDataFrame([("B", "", None, D("0.00"), 0, None), ("A", "d", 1, D("1.00"), 1, "u")],
                                    "ProductName string, Description string, CategoryID long, Price decimal(10,2), "
                                    "StockQuantity int, ImageURL string")
    res = W.add_products_document(shop.products, rows_df, AS_OF)
    assert rows(res.tables["added"], "ProductID", "ProductName", "created_at") == [(5, "A", AS_OF), (6, "B", AS_OF)]


def test_append_logs_numbers_after_existing(spark):
    from bazaar.operators import audit as A
    existing = spark.createDataFrame([(41, 1, "x", AS_OF)], Tb.LOGS)
    entries = spark.createDataFrame([(1, "b", AS_OF, 2), (1, "a", AS_OF, 1)],
                                    "UserID long, Action string, Timestamp timestamp, Key long")
    out = A.append_logs(existing, entries)
    assert rows(out, "LogID", "Action") == [(41, "x"), (42, "a"), (43, "b")]


def test_fold_property_based(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    event = st.tuples(st.integers(0, 30),                      # minute
                      st.integers(1, 3), st.integers(1, 3),      # user, product
                      st.sampled_from(["delta", "set", "remove"]),
                      st.integers(-3, 4))

    @settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(event, min_size=1, max_size=40),
           st.dictionaries(st.tuples(st.integers(1, 3), st.integers(1, 3)), st.integers(-2, 5), max_size=4))
    def check(evs, base):
        ev = [(i, T0 + dt.timedelta(minutes=m), u, p, op, None if op == "remove" else q)
              for i, (m, u, p, op, q) in enumerate(evs)]
        df = spark.createDataFrame(ev, Tb.CART_EVENTS)
        base_df = spark.createDataFrame([(u, p, q) for (u, p), q in base.items()], Tb.CART_ITEMS)
        assert rows(W.fold_cart_events(df, base=base_df).items) == brute_fold(ev, base)

    check()


def test_document_cart_fold_matches_queue_brute_force(spark):
    from collections import deque
    rnd = random.Random(17)
    ev = []
    for i in range(2500):
        u, p = (1, 1) if i % 3 == 0 else (rnd.randint(2, 6), rnd.randint(1, 4))
        op = rnd.choice(["delta", "delta", "remove", "set"])
        ev.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, 900)), u, p, op,
                   None if op == "remove" else rnd.randint(-1, 3)))
    queues = {}
    for eid, ts, u, p, op, q in sorted(ev, key=lambda e: (e[1], e[0])):
        dq = queues.setdefault((u, p), deque())
        if op == "delta":
            dq.append((eid, q))
        elif op == "remove" and dq:
            dq.popleft()
    want = sorted((u, p, eid, q) for (u, p), dq in queues.items() for eid, q in dq)
    got = rows(W.fold_cart_events_document(spark.createDataFrame(ev, Tb.CART_EVENTS)).items)
    assert got == want


def test_edit_favorites_document_removes_one_own_favorite(spark):
    shop = small_shop(spark)
    favs = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 11, 3)], "FavoriteID long, UserID long, ProductID long")
    adds = spark.createDataFrame([(4, 10, 2), (5, 12, 2)], "FavoriteID long, UserID long, ProductID long")
    removes = spark.createDataFrame([(10, 1), (10, 3), (12, 2)], "UserID long, FavoriteID long")
    res = W.edit_favorites_document(favs, adds, removes, shop.user_roles, shop.roles)
    assert rows(res.tables["favorites"]) == [(2, 10, 1), (3, 11, 3), (4, 10, 2)]   # 10 cannot remove 11's favorite
    assert rows(res.rejects, "UserID", "op") == [(12, "add"), (12, "remove")]
