"""Snapshot audits over differing key ranges equal those over whole snapshots."""
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.operators import audit as A
from bazaar.operators import snapshots as Sn
from bazaar.sources import tables as Tb
from conftest import AS_OF, rows


def test_only_changed_ranges_are_compared(spark):
    rng = random.Random(5)
    before = {k: (k, f"p{k}", "d", 1, D("1.00"), rng.randint(0, 9), None) for k in rng.sample(range(-2000, 40_000), 3000)}
    after = dict(before)
    touched = rng.sample(sorted(before), 6)
    for k in touched[:2]:
        del after[k]
    for k in touched[2:4]:
        after[k] = (*after[k][:5], 99, None)
    for k in (39_999_999, -5000):
        after[k] = (k, "new", None, 1, D("2.00"), 1, "x")
    old, new = (spark.createDataFrame(list(t.values()), Tb.PRODUCTS) for t in (before, after))
    cols = A.PRODUCT_VALUE_COLS
    for width, fanout in ((64, 8), (1024, 256), (1, 2)):
        got = Sn.audit_by_range(A.audit_products, old, new, "ProductID", cols, 1, AS_OF, width=width, fanout=fanout)
        assert rows(got, "Key", "Action") == rows(A.audit_products(old, new, 1, AS_OF), "Key", "Action")
        ranges = {k // width for k in touched[:4]} | {39_999_999 // width, -5000 // width}
        o, n = Sn.changed_rows(old, new, "ProductID", cols, width, fanout)
        assert {r.ProductID for r in o.collect()} == {k for k in before if k // width in ranges}
        assert {r.ProductID for r in n.collect()} == {k for k in after if k // width in ranges}
    kept = Sn.range_digests(old, "ProductID", cols)
    assert Sn.audit_by_range(A.audit_products, old, old, "ProductID", cols, 1, AS_OF, old_digests=kept).count() == 0
    assert rows(Sn.audit_by_range(A.audit_products, old.limit(0), new, "ProductID", cols, 1, AS_OF), "Key") == sorted((k,) for k in after)
    twice = old.unionByName(old.where(F.col("ProductID") == touched[5]))
    o, n = Sn.changed_rows(old, twice, "ProductID", cols, 1, 2)
    assert [r.ProductID for r in o.collect()] == [touched[5]] and n.count() == 2
