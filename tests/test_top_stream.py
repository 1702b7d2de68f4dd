"""Best sellers kept up to date equal the full query after every batch of line changes."""
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.operators import orders as O
from bazaar.plans.registry import QUERIES
from bazaar.sources import tables as Tb
from bazaar.streaming import audit_stream as AS
from bazaar.streaming import top_stream as TS
from conftest import rows
from shopfix import small_shop

COLS = ["ProductID", "ProductName", "CategoryName", "TotalSold", "TotalRevenue"]


def test_top_list_after_every_batch(spark):
    rng = random.Random(1)
    products = [(p, f"p{p}", "d", rng.choice([1, 2, 3, None]), D("1.00"), 5, None) for p in range(1, 31)]
    root = AS.stream_root(spark, "test-top")
    live, seen = [], []
    for batch in range(4):
        feed = []
        for _ in range(60):
            if live and rng.random() < 0.35:
                feed.append(("delete", *live.pop(rng.randrange(len(live)))))
            else:
                line = (rng.randrange(40), rng.randrange(1, 33), rng.randrange(0, 6), D(rng.randrange(100, 999)) / 100)
                live.append(line)
                feed.append(("insert", *line))
        seen.append(feed)
        spark.createDataFrame(feed, TS.LINE_CHANGES).coalesce(1).write.mode("append").parquet(f"{root}/src")
        shop = small_shop(spark, products=products, order_items=list(live))
        made = TS.run_top_stream(spark, f"{root}/src", root, shop, n=10)      # a restart between the batches
        assert len(made) == 1
        want = [tuple(r) for r in O.top_products(shop, 10).select(*COLS).collect()]
        got = spark.read.parquet(made[0]).select(*COLS)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 5
    parts = [TS.sales(spark.createDataFrame(f, TS.LINE_CHANGES)) for f in seen]
    whole = TS.sales(spark.createDataFrame([x for f in seen for x in f], TS.LINE_CHANGES))
    assert rows(TS.merged(parts), "ProductID", "TotalSold", "Cents", "Lines") == rows(whole, "ProductID", "TotalSold", "Cents", "Lines")
    assert spark.createDataFrame([], Tb.ORDER_ITEMS).count() == 0


def test_no_file_of_the_feed_is_a_fixed_share(spark, tmp_path):
    """The feed has as many files as Spark deals tasks, not four and one, whatever the size of the table."""
    lines = spark.range(40000).selectExpr("id div 4 as l_orderkey", "id % 7 as l_partkey", "0L as l_suppkey", "1 as l_linenumber", "2.0D as l_quantity",
                                          "10.0D as l_extendedprice")
    lines = lines.select(*[F.col(f.name) if f.name in lines.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in Tb.DRIVER_SCHEMAS["lineitem"].fields])
    lines.select(*[F.col(f.name).cast(f.dataType) for f in Tb.DRIVER_SCHEMAS["lineitem"].fields]).repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"p{i}", "b", "T", 3, 1.0) for i in range(7)], Tb.DRIVER_SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    made = []
    real = TS.run_top_stream
    try:
        for k, v in zip(held, ("20000", "1000", "false")):
            spark.conf.set(k, v)
        TS.run_top_stream = lambda spark, source, *a, **b: made.append(spark.read.parquet(source).groupBy(F.input_file_name(), "op").count().collect()) or real(spark, source, *a, **b)
        top = QUERIES["top_products_stream"](spark, str(tmp_path))
        assert {r.ProductID: r.TotalSold for r in top.collect()} == {p: sum(2 for i in range(40000) if i % 7 == p and i // 4 % 10) for p in range(7)}
    finally:
        TS.run_top_stream = real
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = {op: [r["count"] for r in made[0] if r.op == op] for op in ("insert", "delete")}
    assert len(files["insert"]) > 4 and len(files["delete"]) > 1 and sum(files["insert"]) == 40000 and sum(files["delete"]) == 4000
