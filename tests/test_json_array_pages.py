"""Array files read over many tasks, page directories, replayed change feeds."""
import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.operators import audit as A
from bazaar.operators import pages as P
from bazaar.sources import json_array as JA
from bazaar.sources import json_io as J
from bazaar.streaming import audit_stream as AS
from conftest import AS_OF, rows
from shopfix import small_shop

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()),
                       T.StructField("n", T.StructType([T.StructField("d", T.StringType()), T.StructField("l", T.ArrayType(T.LongType()))])),
                       T.StructField("_corrupt_record", T.StringType())])


def objects(rng, n):
    text = lambda: "".join(rng.choice('ab"\\{}[],: \n\té /') for _ in range(rng.randrange(0, 12)))
    return [{"k": i, "s": rng.choice([None, text(), text() + "\\"]), "n": rng.choice([None, {}, {"d": "}{" + text(), "l": [1, 2]}])} for i in range(n)]


def test_array_files_equal_the_json_parser(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for f, (indent, bom, n) in enumerate([(None, True, 400), (2, False, 150), (None, False, 1), (4, True, 0)]):
        made = objects(rng, n)
        path = tmp_path / "in" / f"f{f}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(("﻿" if bom else "") + json.dumps(made, indent=indent, ensure_ascii=f % 2 == 0) + "\n" * f, encoding="utf-8")
        want |= {(f, o["k"]): o for o in made}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
        got = JA.json_objects(spark, str(tmp_path / "in")).collect()
        parsed = JA.read_json_array(spark, str(tmp_path / "in"), SCHEMA).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(int(r.file[-6]), r.number): json.loads(r.text) for r in got} == want and len(got) == len(want)
    assert len(parsed) == len(want) and all(r["_corrupt_record"] is None for r in parsed)
    key = lambda o: json.dumps(o, sort_keys=True)
    flat = [{"k": r.k, "s": r.s, "n": None if r.n is None else {c: v for c, v in (("d", r.n.d), ("l", r.n.l)) if v is not None}} for r in parsed]
    assert sorted(map(key, flat)) == sorted(map(key, want.values()))


def test_a_broken_array_reports_its_rest(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"k": 1, "s": "a"}, {"k": 2, "s": "b"}, {"k": 3, "s": "no end')
    (tmp_path / "cut2.json").write_text('[{"k": 4, "s": "}"}, {"k": "x", "s": "b"}')
    got = JA.read_json_array(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r.k or 0, r.s or "") for r in got if r["_corrupt_record"] is None) == [(1, "a"), (2, "b"), (4, "}")]
    assert sum(r["_corrupt_record"] is not None for r in got) == 2


def test_products_come_back_from_array_files(spark, tmp_path):
    shop = small_shop(spark)
    J.export_products_array(shop.products, str(tmp_path / "out"))
    added, rejects = J.import_products(spark, shop.products, str(tmp_path / "out"))[1:]
    cols = ["ProductName", "Description", "CategoryID", "Price", "StockQuantity"]
    assert rows(added, *cols) == rows(shop.products.where("CategoryID is not null"), *cols)
    assert [r.ProductName for r in rejects.collect()] == ["Lost"]


def test_every_page_opens_the_ranges_it_needs(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 250).alias("ProductID"), F.when(F.col("id") >= 250, F.floor(F.col("id") / 250)).alias("PromoID"),
                                  (F.col("id") * 7).alias("x"))
    book = P.write_pages(df, ["ProductID", "PromoID"], str(tmp_path / "book"), rows_per_range=100)
    want = sorted(rows(df), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    opened = {}
    for page in (1, 2, 10, P.last_page(book, 52), P.last_page(book, 52) + 1):
        got = P.read_page(book, page, 52)
        assert [tuple(r) for r in got.collect()] == want[(page - 1) * 52:page * 52]
        opened[page] = len({f.split("range=")[1].split("/")[0] for f in got.inputFiles()})
    assert len(book.starts) >= 8 and set(opened.values()) <= {0, 1, 2} and opened[P.last_page(book, 52)] <= 2
    again = P.open_pages(df, ["ProductID", "PromoID"], str(tmp_path / "book"))
    assert again.starts == book.starts and P.last_page(again, 52) == 20
    none = P.write_pages(df.limit(0), ["ProductID", "PromoID"], str(tmp_path / "none"))
    assert P.read_page(none, 1, 52).count() == 0 and P.last_page(none, 52) == 1


def test_a_feed_delivered_twice_logs_once(spark):
    shop = small_shop(spark)
    new = shop.products.withColumn("Price", (F.col("Price") + 1).cast("decimal(10,2)")).filter("ProductID != 3")
    feed = AS.product_change_feed(shop.products, new, 1, AS_OF)
    root = AS.stream_root(spark, "test-replayed")
    for _ in range(3):
        feed.coalesce(1).write.mode("append").parquet(f"{root}/src")
        AS.run_audit_stream(spark, f"{root}/src", f"{root}/sink", f"{root}/ck", replayed_within="1 hour")
    assert rows(spark.read.parquet(f"{root}/sink"), "Key", "Action") == rows(A.audit_products(shop.products, new, 1, AS_OF), "Key", "Action")
