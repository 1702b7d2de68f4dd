"""Audit text (golden shapes of the shop's log), JSON sources, and
stream = batch for the change feed and the cart fold."""
import datetime as dt
import json
import os
import tempfile
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.operators import audit as A
from bazaar.operators import writes as W
from bazaar.sources import json_io as J
from bazaar.sources import tables as Tb
from bazaar.streaming import audit_stream as AS
from bazaar.streaming import cart_stream as CS
from conftest import AS_OF, rows


def _products(spark, data):
    return spark.createDataFrame(data, Tb.PRODUCTS)


def test_product_audit_golden_text(spark):
    old = _products(spark, [(1, "Jence", "d", 1, D("82.00"), 12, None), (2, "Gone", "d", 1, D("1.50"), 3, None),
                            (3, "Same", "d", 1, D("5.00"), 1, None), (5, None, "d", 1, D("5.00"), 1, None)])
    new = _products(spark, [(1, "Jince", "d", 1, D("92.00"), 56, None), (3, "Same", "d", 1, D("5.00"), 1, None),
                            (4, "New Jacket", "d", 1, D("199.99"), 50, None), (5, None, "x", 1, D("5.00"), 1, None)])
    got = rows(A.audit_products(old, new, 1, AS_OF), "Key", "Action")
    assert got == [(1, "Update product: Jence 82.00 12 -> Jince 92.00 56"), (2, "Delete product: Gone 1.50 3"),
                   (4, "Insert product: New Jacket 199.99 50"), (5, None)]
    assert A.audit_products(old, new, None, AS_OF).count() == 0


def test_promo_audit_updates_are_silent(spark):
    old = spark.createDataFrame([(1, "WINTER50", 50, False, 1, AS_OF, AS_OF), (2, "A", 5, False, 1, AS_OF, AS_OF)],
                                Tb.PROMOCODES)
    new = spark.createDataFrame([(2, "A", 7, False, 1, AS_OF, AS_OF), (3, "New promo", 25, True, None, AS_OF, AS_OF)],
                                Tb.PROMOCODES)
    got = rows(A.audit_promocodes(old, new, 1, AS_OF), "Action")
    assert got == [("Delete promocode: WINTER50 50%",), ("Insert promocode: New promo 25%",)]


def test_read_logs_json_with_bom_and_import(spark):
    d = tempfile.mkdtemp(prefix="bazaar-logs-")
    data = [{"LogID": 2, "UserID": 1, "Action": "Insert promocode: WINTER50 50%", "Timestamp": "2025-12-07T21:44:41.317"},
            {"LogID": 1, "UserID": 1, "Action": "Delete product: Jince 92.00 56", "Timestamp": "2025-12-07T22:22:11"},
            {"LogID": 3, "UserID": 1, "Action": "Insert promocode: WINTER50 50%", "Timestamp": "2025-12-07T21:44:41.317"}]
    with open(os.path.join(d, "logs.json"), "w", encoding="utf-8-sig") as fh:
        json.dump(data, fh, ensure_ascii=False, indent=2)
    df = J.read_logs_json(spark, d)
    got = rows(df, "LogID", "Timestamp")
    assert got == [(1, dt.datetime(2025, 12, 7, 22, 22, 11)), (2, dt.datetime(2025, 12, 7, 21, 44, 41, 317000)),
                   (3, dt.datetime(2025, 12, 7, 21, 44, 41, 317000))]
    existing = spark.createDataFrame([(7, 1, "x", AS_OF)], Tb.LOGS)
    merged = J.import_logs(existing, df)
    assert rows(merged, "LogID") == [(7,), (8,), (9,), (10,)]
    deduped = J.import_logs(existing, df, dedup=True)
    assert deduped.count() == 3


def test_products_json_roundtrip_and_rejects(spark):
    d = tempfile.mkdtemp(prefix="bazaar-prod-")
    existing = _products(spark, [(5, "A", "d", 1, D("1.00"), 1, "C:\\x\\images\\a.jpg")])
    J.export_products(existing, os.path.join(d, "ok"))
    with open(os.path.join(d, "ok", "extra.json"), "w") as fh:
        fh.write('{"ProductName": "B", "CategoryID": 1, "Price": "abc", "StockQuantity": 1}\n{broken\n')
    table, added, rejects = J.import_products(spark, existing, os.path.join(d, "ok"), multi_line=False)
    assert rows(added, "ProductID", "ImageURL") == [(6, "/images/a.jpg")]
    assert sorted(r.reason for r in rejects.collect()) == ["malformed JSON", "missing or invalid field"]
    assert table.count() == 2


def test_audit_stream_equals_batch(spark):
    old = _products(spark, [(i, f"p{i}", "d", 1, D("1.00"), i, None) for i in range(50)])
    new = (old.filter("ProductID % 5 <> 0")
           .withColumn("StockQuantity", F.when(F.col("ProductID") % 3 == 0, F.col("StockQuantity") + 1)
                       .otherwise(F.col("StockQuantity")))
           .unionByName(_products(spark, [(100, "n", "d", 1, D("2.00"), 1, None)])))
    feed = AS.product_change_feed(old, new, 1, AS_OF)
    root = AS.stream_root(spark, "test-audit")
    feed.repartition(5).write.parquet(f"{root}/src")
    AS.run_audit_stream(spark, f"{root}/src", f"{root}/sink", f"{root}/ck", max_files_per_trigger=2)
    streamed = spark.read.parquet(f"{root}/sink")
    assert rows(streamed, "Key", "Action") == rows(A.audit_products(old, new, 1, AS_OF), "Key", "Action")


def test_cart_stream_equals_batch(spark):
    import random
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    ev = []
    for i in range(600):
        op = rnd.choice(["delta", "delta", "set", "remove"])
        q = rnd.randint(-1, 3) if op != "remove" else None
        ev.append((i, t0 + dt.timedelta(minutes=i), rnd.randint(1, 4), rnd.randint(1, 5), op, q))
    root = AS.stream_root(spark, "test-cart")
    for k in range(4):   # four files in time order, one micro-batch each
        part = ev[k * 150:(k + 1) * 150]
        spark.createDataFrame(part, Tb.CART_EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/src")
    state = CS.run_cart_stream(spark, f"{root}/src", root)
    batch = W.fold_cart_events(spark.createDataFrame(ev, Tb.CART_EVENTS)).items
    assert rows(state) == rows(batch)


def cart_events(n, seed):
    import random
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(minutes=i), rnd.randint(1, 4), rnd.randint(1, 5), op, rnd.randint(-1, 3) if op != "remove" else None)
            for i, op in ((i, rnd.choice(["delta", "delta", "set", "remove"])) for i in range(n))]


def put(spark, root, events):
    spark.createDataFrame(events, Tb.CART_EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/src")


def test_cart_stream_in_any_order_and_after_a_restart_equals_batch(spark):
    import random
    ev = cart_events(400, 11)
    mixed = list(ev)
    random.Random(1).shuffle(mixed)
    root = AS.stream_root(spark, "test-cart-mixed")
    put(spark, root, mixed[:100])
    put(spark, root, mixed[100:250])
    first = rows(CS.run_cart_stream(spark, f"{root}/src", root))
    assert first == rows(W.fold_cart_events(spark.createDataFrame(mixed[:250], Tb.CART_EVENTS)).items)
    assert rows(CS.run_cart_stream(spark, f"{root}/src", root)) == first      # restart without new files
    put(spark, root, mixed[250:])
    last = rows(CS.run_cart_stream(spark, f"{root}/src", root))
    assert last == rows(W.fold_cart_events(spark.createDataFrame(ev, Tb.CART_EVENTS)).items)


def test_cart_stream_late_and_rejected_events(spark):
    from shopfix import small_shop
    shop = small_shop(spark)
    ev = [(i, t, u if u < 4 else 12, p, op, q) for i, t, u, p, op, q in cart_events(300, 5)]
    ev = [(i, t, 10 if u < 3 else 11 if u == 3 else 12, p, op, q) for i, t, u, p, op, q in ev]
    root = AS.stream_root(spark, "test-cart-late")
    newer, older = ev[150:], ev[:150]
    slack = dt.timedelta(minutes=200)
    gate = dict(user_roles=shop.user_roles, roles=shop.roles, lateness=slack)
    put(spark, root, newer)
    CS.run_cart_stream(spark, f"{root}/src", root, **gate)
    put(spark, root, older)
    got = rows(CS.run_cart_stream(spark, f"{root}/src", root, **gate))
    closed = max(t for _, t, u, *_ in newer if u != 12) - slack
    late = [e for e in older if e[1] < closed and e[2] != 12]
    assert late and rows(CS.read_side(spark, root, "late"), "event_id") == [(e[0],) for e in late]
    assert rows(CS.read_side(spark, root, "rejects"), "event_id") == [(e[0],) for e in ev if e[2] == 12]
    kept = [e for e in ev if e[2] != 12 and e not in late]
    assert got == rows(W.fold_cart_events(spark.createDataFrame(kept, Tb.CART_EVENTS)).items)


def test_cart_stream_closes_events_behind_the_watermark(spark):
    t0 = dt.datetime(2024, 1, 1)
    root = AS.stream_root(spark, "test-cart-closing")
    old = [(i, t0 + dt.timedelta(minutes=i), 1, 1, "delta", 1) for i in range(50)] + [(60, t0, 2, 2, "remove", None), (61, None, 3, 3, "delta", 2)]
    put(spark, root, old)
    put(spark, root, [(100, t0 + dt.timedelta(days=2), 9, 9, "set", 1)])
    slack = dt.timedelta(hours=1)
    assert rows(CS.run_cart_stream(spark, f"{root}/src", root, lateness=slack)) == [(1, 1, 50), (3, 3, 2), (9, 9, 1)]
    put(spark, root, [(101, t0 + dt.timedelta(days=2), 1, 1, "delta", 5), (102, t0, 1, 1, "set", 7)])
    assert rows(CS.run_cart_stream(spark, f"{root}/src", root, lateness=slack)) == [(1, 1, 55), (3, 3, 2), (9, 9, 1)]
    assert rows(CS.read_side(spark, root, "late"), "event_id", "ts") == [(102, t0)]
    with CS._rocksdb(spark):
        held = spark.read.format("statestore").option("path", f"{root}/checkpoint/carts").option("stateVarName", "open").load()
    assert held.count() <= 4      # a base row and the new event of key 1, one row of keys 3 and 9


def test_cart_stream_starts_from_initial_carts(spark):
    root = AS.stream_root(spark, "test-cart-initial")
    start = spark.createDataFrame([(1, 1, 4), (2, 1, -1)], Tb.CART_ITEMS)
    spark.createDataFrame([], Tb.CART_EVENTS).write.parquet(f"{root}/src")
    put(spark, root, [(1, dt.datetime(2024, 1, 1), 1, 1, "delta", 2)])
    assert rows(CS.run_cart_stream(spark, f"{root}/src", root, initial=start, max_files_per_trigger=None)) == [(1, 1, 6), (2, 1, -1)]
    assert rows(CS.run_cart_stream(spark, f"{root}/src", root, initial=start)) == [(1, 1, 6), (2, 1, -1)]


def test_log_import_knows_null_texts_and_keeps_microseconds(spark):
    at = dt.datetime(2024, 1, 1, 1, 2, 3, 123456)
    log = spark.createDataFrame([(1, 7, None, at), (2, 7, "x", at)], Tb.LOGS)
    path = AS.stream_root(spark, "test-log") + "/logs"
    J.export_logs(log, path)
    back = J.read_logs_json(spark, path, multi_line=False)
    assert rows(back, "Timestamp") == [(at,), (at,)]
    assert J.import_logs(log, back, dedup=True).count() == 2
    assert rows(J.import_logs(log, back), "LogID") == [(1,), (2,), (3,), (4,)]


def test_the_log_is_for_admins(spark):
    from shopfix import small_shop
    shop = small_shop(spark)
    log = spark.createDataFrame([(1, 7, "x", AS_OF)], Tb.LOGS)
    assert A.logs(log, shop.user_roles, shop.roles, 11).count() == 1 and A.logs(log).count() == 1
    assert A.logs(log, shop.user_roles, shop.roles, 10).count() == 0 == A.logs(log, shop.user_roles, shop.roles, None).count()


def test_cart_stream_keeps_one_state_row_a_user(spark):
    """Thirty lines of one user are read and written as one cart, not line by line."""
    root = AS.stream_root(spark, "test-cart-user")
    t0 = dt.datetime(2024, 1, 1)
    ev = [(i, t0 + dt.timedelta(minutes=i), 1 + i // 60, i % 30, "set" if i % 3 else "delta", i % 5) for i in range(120)] + [(200, None, 1, None, "delta", 3)]
    put(spark, root, ev[::2])
    put(spark, root, ev[1::2])
    got = rows(CS.run_cart_stream(spark, f"{root}/src", root))
    assert got == rows(W.fold_cart_events(spark.createDataFrame(ev, Tb.CART_EVENTS)).items) and (1, None, 3) in got
    with CS._rocksdb(spark):
        held = spark.read.format("statestore").option("path", f"{root}/checkpoint/carts").option("stateVarName", "open").load()
    assert held.count() == 2
