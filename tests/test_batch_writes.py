"""Batch writes against the shop's calls made one after the other, on random small batches."""
import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from bazaar.operators import checkout as K
from bazaar.operators import writes as W
from conftest import AS_OF, rows
from shopfix import small_shop

DAY = dt.timedelta(days=1)


def test_add_promocodes_equals_one_call_after_the_other(spark):
    shop = small_shop(spark)
    for seed in range(3):
        rnd = random.Random(seed)
        reqs = [(i, rnd.choice([11, 11, 10]), rnd.choice(["A", "B", "C", "S10", ""]), rnd.choice([0, 5, 50, 120]), False, 1,
                 AS_OF + rnd.choice([-1, 0, 1]) * DAY, AS_OF + rnd.choice([-1, 5]) * DAY) for i in range(60)]
        codes, want, why = {"S10", "S50", "OLD", "ALL"}, [], {}
        for i, actor, code, pct, _, _, lo, hi in reqs:
            if actor != 11:
                why[i] = W.NOT_AN_ADMIN
            elif not code or not pct:
                why[i] = W.CODE_AND_PERCENT_REQUIRED
            elif pct > 100:
                why[i] = W.PERCENT_RANGE
            elif code in codes:
                why[i] = W.DUPLICATE_CODE
            elif lo < AS_OF or hi < AS_OF:
                why[i] = W.DATES_IN_PAST
            else:
                codes.add(code)
                want.append((5 + len(want), code, pct))
        df = spark.createDataFrame(reqs, "seq long, ActorID long, Code string, DiscountPercent int, IsGlobal boolean, "
                                         "CategoryID long, ValidFrom timestamp, ValidTo timestamp")
        res = W.add_promocodes(shop.promocodes, df, AS_OF, user_roles=shop.user_roles, roles=shop.roles, order=["seq"])
        assert rows(res.tables["added"], "PromoID", "Code", "DiscountPercent") == want
        assert dict(rows(res.rejects, "seq", "reason")) == why


def test_ties_and_identical_requests_never_add_a_code_twice(spark):
    shop = small_shop(spark)
    reqs = [("X", 10, False, 1, None, None)] * 3 + [("X", 20, False, 1, None, None), ("Y", 5, False, 1, None, None)]
    df = spark.createDataFrame(reqs, "Code string, DiscountPercent int, IsGlobal boolean, CategoryID long, ValidFrom timestamp, ValidTo timestamp")
    res = W.add_promocodes(shop.promocodes, df, AS_OF)
    assert rows(res.tables["added"], "Code", "DiscountPercent") == [("X", 10), ("Y", 5)]
    assert rows(res.rejects, "Code", "DiscountPercent", "reason") == [("X", 10, W.DUPLICATE_CODE)] * 2 + [("X", 20, W.DUPLICATE_CODE)]


def test_register_users_equals_one_call_after_the_other(spark):
    shop = small_shop(spark)
    for seed in range(3):
        rnd = random.Random(seed)
        reqs = [(i, rnd.choice([None, 11, 10]), rnd.choice(["ann", "u1", "u2", "u3", "u4", "u5"]), "h",
                 rnd.choice(["bob@x", "e1", "e2", "e3", "e4", "e5"]), rnd.choice([None, "User", "Admin", "Guest"])) for i in range(50)]
        names, mails, want, why = {"ann", "bob", "eve"}, {"ann@x", "bob@x", "eve@x"}, [], {}
        for i, actor, name, _, mail, role in reqs:
            if actor == 10:
                why[i] = W.NOT_AN_ADMIN
            elif name == "ann":
                why[i] = W.USERNAME_TAKEN
            elif mail == "bob@x":
                why[i] = W.EMAIL_TAKEN
            elif name in names or mail in mails:
                why[i] = W.DUPLICATE_IN_BATCH
            elif role == "Guest":
                why[i] = W.UNKNOWN_ROLE
            else:
                names.add(name)
                mails.add(mail)
                want.append((13 + len(want), name, mail))
        df = spark.createDataFrame(reqs, "seq long, ActorID long, Username string, PasswordHash string, Email string, RoleName string")
        res = W.register_users(shop.users, shop.user_roles, shop.roles, df, order=["seq"])
        assert rows(res.tables["added_users"], "UserID", "Username", "Email") == want
        assert dict(rows(res.rejects, "seq", "reason")) == why


def test_registering_identical_rows_counts_every_copy(spark):
    shop = small_shop(spark)
    df = spark.createDataFrame([("n", "h", "m", None)] * 3 + [("n", "h", "k", "Guest")],
                               "Username string, PasswordHash string, Email string, RoleName string")
    res = W.register_users(shop.users, shop.user_roles, shop.roles, df)
    assert res.tables["added_users"].count() == 1 and res.rejects.count() == 3


def test_updates_and_patches_of_one_product_apply_in_order(spark):
    shop = small_shop(spark)
    upd = [(i, 1, f"n{i}", "d", 1, D("2.00"), i, None) for i in (3, 1, 2)]
    df = spark.createDataFrame(upd, "seq long, ProductID long, ProductName string, Description string, CategoryID long, "
                                    "Price decimal(10,2), StockQuantity int, ImageURL string")
    for res in (W.upsert_products(shop.products, df, order=["seq"]), W.upsert_products(shop.products, df.drop("seq"))):
        got = rows(res.tables["products"], "ProductID", "ProductName")
        assert got[0] == (1, "n3") and len(got) == 4

    rnd = random.Random(4)
    names = ["ProductName", "Price", "StockQuantity", "ImageURL"]
    patches = [(i, rnd.choice([1, 1, 2, 9]), {k: (None if k == "ImageURL" and rnd.random() < .5 else str(rnd.randint(1, 9)))
                                             for k in rnd.sample(names, rnd.randint(0, 3))}) for i in range(25)]
    want = {r.ProductID: r.asDict() for r in shop.products.collect()}
    for _, pid, p in patches:
        if pid in want:
            want[pid].update({k: D(v) if k == "Price" else int(v) if k == "StockQuantity" else v for k, v in p.items()})
    df = spark.createDataFrame(patches, "seq long, ProductID long, patch map<string,string>")
    res = W.patch_products(shop.products, df, AS_OF, order=["seq"])
    got = {r.ProductID: r.asDict() for r in res.tables["products"].collect()}
    assert len(got) == 4 and all({c: got[k][c] for c in want[k]} == want[k] for k in want)
    assert {k for k, r in got.items() if r["updated_at"]} == {p for _, p, _ in patches if p in want}
    assert rows(res.rejects, "seq") == [(i,) for i, pid, _ in patches if pid == 9]


def test_favorites_equal_one_call_after_the_other(spark):
    shop = small_shop(spark)
    rnd = random.Random(2)
    calls = [(i, rnd.choice(["add", "add", "remove"]), rnd.choice([10, 11, 12]), rnd.randint(1, 3)) for i in range(80)]
    favs = Counter((r.UserID, r.ProductID) for r in shop.favorites.collect())
    for _, op, u, p in calls:
        if u == 12:      # Admin only
            continue
        favs[u, p] = favs[u, p] + 1 if op == "add" else 0
    df = spark.createDataFrame(calls, "seq long, op string, UserID long, ProductID long")
    res = W.edit_favorites(shop.favorites, df.filter("op = 'add'"), df.filter("op = 'remove'"), shop.user_roles, shop.roles, order=["seq"])
    assert Counter(map(tuple, rows(res.tables["favorites"]))) == +favs
    assert res.rejects.count() == sum(u == 12 for _, _, u, _ in calls)


def loop_checkout(products, cart, reqs, strict):
    """(accepted users, {user: reason}) by taking one request after the other."""
    stock = {p: s for p, s in products}
    done, accepted, why = set(), [], []
    for u, promo, ts in sorted(reqs, key=lambda r: (r[2], r[0], r[1] is not None, r[1] or 0)):
        if u in done:
            why.append((u, K.DUPLICATE_REQUEST))
            continue
        done.add(u)
        lines = [(p, q) for cu, p, q in cart if cu == u]
        if not lines:
            why.append((u, K.EMPTY_CART))
        elif any(stock[p] < q for p, q in lines):
            why.append((u, K.OUT_OF_STOCK))
        elif strict and min(q for _, q in lines) <= 0:
            why.append((u, K.NON_POSITIVE))
        else:
            accepted.append(u)
            for p, q in lines:
                stock[p] -= q
    return accepted, sorted(why), stock


@pytest.mark.parametrize("group_lines", [1_000_000, 9, 1])
def test_serial_checkout_equals_the_one_by_one_loop(spark, monkeypatch, group_lines):
    monkeypatch.setattr(K, "GROUP_LINES", group_lines)      # below: conflict groups, their earliest carts first
    for seed, strict in ((1, True), (2, False), (3, True))[:3 if group_lines > 1 else 1]:
        rnd = random.Random(seed)
        products = [(p, f"p{p}", "d", 1, D("1.00"), rnd.randint(0, 25), None) for p in range(1, 9)]
        users = list(range(1, 41))
        cart = [(u, p, rnd.choice([1, 2, 3, 4] if strict else [-2, 1, 3, 6])) for u in users[:36]
                for p in rnd.sample(range(1, 9), rnd.randint(1, 3))] + ([(36, 1, 0)] if seed == 3 else [])
        cart = list({(u, p): (u, p, q) for u, p, q in cart}.values())
        reqs = [(u, rnd.choice([None, 2, 4]), AS_OF + dt.timedelta(seconds=rnd.randint(0, 30))) for u in users]
        reqs += [reqs[3], reqs[3], (5, 4, AS_OF + DAY)]
        shop = small_shop(spark, products=products, cart=cart, users=[(u, f"u{u}", None, f"{u}@x") for u in users],
                          user_roles=[(u, 2) for u in users])
        df = spark.createDataFrame(reqs, "UserID long, PromoID long, request_ts timestamp")
        res = K.checkout(shop, df, AS_OF, strict=strict)
        accepted, why, stock = loop_checkout([(p[0], p[5]) for p in products], cart, reqs, strict)
        got = [r.UserID for r in res.orders.orderBy("OrderID").collect()]
        first = {u: min(t for v, _, t in reqs if v == u) for u in users}
        assert got == sorted(accepted, key=lambda u: (first[u], u)) and 5 < len(got) < 36
        assert rows(res.rejects, "UserID", "reason") == why
        assert {r.ProductID: r.StockQuantity for r in res.stock.collect()} == stock
        assert res.orders.count() + res.rejects.count() == len(reqs)
        res.release()


def test_repeated_requests_are_all_answered(spark):
    shop = small_shop(spark, cart=[(10, 1, 1)])
    df = spark.createDataFrame([(10, None, AS_OF)] * 3 + [(None, 1, AS_OF)] * 2, "UserID long, PromoID long, request_ts timestamp")
    for res in (K.checkout(shop, df, AS_OF), K.checkout_simple(shop, df)):
        assert res.orders.count() == 1
        assert sorted(rows(res.rejects, "reason")) == [(K.DUPLICATE_REQUEST,)] * 3 + [(K.NOT_A_SHOP_USER,)]


def test_actors_without_the_admin_role_are_rejected(spark):
    shop = small_shop(spark)
    who = [(11, 1), (10, 2), (99, 3)]
    df = spark.createDataFrame(who, "ActorID long, ProductID long")
    gate = dict(user_roles=shop.user_roles, roles=shop.roles)
    res = W.delete_products(shop.products, df, shop.favorites, shop.cart_events, shop.order_items, "plain", **gate)
    assert rows(res.rejects, "ActorID", "reason") == [(10, W.NOT_AN_ADMIN), (99, W.NOT_AN_ADMIN)]
    assert rows(res.tables["products"], "ProductID") == [(2,), (3,), (4,)]
    promos = W.delete_promocodes(shop.promocodes, shop.orders, df.withColumnRenamed("ProductID", "PromoID"), **gate)
    assert rows(promos.tables["promocodes"], "PromoID") == [(2,), (3,), (4,)] and promos.rejects.count() == 2
    patches = df.withColumn("patch", F.create_map(F.lit("ProductName"), F.lit("z")))
    out = W.patch_products(shop.products, patches, AS_OF, **gate)
    assert rows(out.tables["products"].filter("ProductName = 'z'"), "ProductID") == [(1,)] and out.rejects.count() == 2
    rowsdf = shop.products.filter("ProductID < 4").join(df, "ProductID").withColumn("ProductName", F.lit("y")).withColumn("StockQuantity", F.lit(5))
    up = W.upsert_products(shop.products, rowsdf, **gate)
    assert rows(up.tables["products"].filter("ProductName = 'y'"), "ProductID") == [(1,)] and up.rejects.count() == 2
    doc = W.add_products_document(shop.products, rowsdf.drop("ProductID"), AS_OF, **gate)
    assert doc.tables["added"].count() == 1 and doc.rejects.count() == 2
