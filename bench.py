"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up, then $BENCH_REPS times; the median
wall time is reported.  Results are fully computed into Spark's ``noop``
sink (no collect to the driver).  Checkout writes all of its outputs:
``checkout`` with the snapshot stock rule over whole carts (as in round 1),
``checkout_serial`` one after the other by the shop's own rule.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaar.operators import catalog as C  # noqa: E402
from bazaar.operators import checkout as K  # noqa: E402
from bazaar.operators import nested as N  # noqa: E402
from bazaar.operators import orders as O  # noqa: E402
from bazaar.plans.registry import SEARCH_KEYWORD, checkout_requests  # noqa: E402
from bazaar.session import build_session  # noqa: E402
from bazaar.sources.tables import AS_OF, load_shop  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPS = int(os.environ.get("BENCH_REPS", "3"))


def _sink(df):
    df.write.format("noop").mode("overwrite").save()


def q_top_products(spark):
    _sink(O.top_products(load_shop(spark, SF_DIR), 100))


def q_catalog(spark):
    _sink(C.catalog(load_shop(spark, SF_DIR), AS_OF))


def q_search(spark):
    _sink(C.search_products(load_shop(spark, SF_DIR), SEARCH_KEYWORD, AS_OF))


def q_catalog_page(spark):
    _sink(C.catalog_page(load_shop(spark, SF_DIR), 10, 52, AS_OF))


def q_order_totals(spark):
    _sink(O.order_totals(load_shop(spark, SF_DIR)))


def q_orders_nested(spark):
    _sink(N.orders_nested(load_shop(spark, SF_DIR)))


def q_fold_cart_events(spark):
    _sink(load_shop(spark, SF_DIR).cart_items)


def q_checkout(spark, stock="snapshot", strict=True):
    shop = load_shop(spark, SF_DIR)
    res = K.checkout(shop, checkout_requests(shop), AS_OF, stock=stock, strict=strict)
    for df in (res.orders, res.order_items, res.stock, res.carts, res.rejects):
        _sink(df)
    res.release()


def q_checkout_serial(spark):
    """One cart after the other by the shop's own rule (lines <= 0 pass), whole carts."""
    q_checkout(spark, "serial", strict=False)


QUERIES = {
    "top_products": q_top_products,
    "catalog": q_catalog,
    "search_products": q_search,
    "catalog_page": q_catalog_page,
    "order_totals": q_order_totals,
    "orders_nested": q_orders_nested,
    "fold_cart_events": q_fold_cart_events,
    "checkout": q_checkout,
    "checkout_serial": q_checkout_serial,
}


def main() -> None:
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, CPUS * 2))))
    spark = build_session(master=f"local[{CPUS}]", shuffle_partitions=shuffle, app_name="bazaar-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    only = [a for a in sys.argv[1:] if a in QUERIES]
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        fn(spark)  # warm-up
        runs = []
        for _ in range(REPS):
            t0 = time.perf_counter()
            fn(spark)
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": CPUS, "reps": REPS}))
    spark.stop()


if __name__ == "__main__":
    main()
