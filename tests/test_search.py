"""Search of many keywords at once against the one-keyword search and a plain loop."""
import random
import re
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.functions.exprs import like_regex
from bazaar.operators import catalog as C
from bazaar.operators import search as S
from bazaar.plans.registry import QUERIES
from bazaar.sources import tables as Tb
from conftest import AS_OF, rows
from shopfix import small_shop

ALPHABET = "ab%_[^-]\\.c A*\x00é"


def shop_of(spark, rng):
    text = lambda: "".join(rng.choice("abcAB []%_\\.*é-^") for _ in range(rng.randrange(0, 9)))
    products = [(i, text(), rng.choice([None, text()]), rng.choice([1, 2, 3, None]), D("10.00"), 1, None) for i in range(120)]
    return small_shop(spark, products=products), products


def test_many_keywords_equal_a_loop_over_keywords(spark):
    rng = random.Random(4)
    shop, products = shop_of(spark, rng)
    names = {1: "Shirts", 2: "Caps", 3: "Shoes"}
    keywords = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    keywords += [None, "", "  ", "shi", "CAPS", "sh%t", "[sc]", "[^a]", "[]", "[^]", "[a", "hoe", "caps", "_", "%", "ab", "ab"]
    want = set()
    for kw in {k for k in keywords if k is not None and k.strip(" ")}:
        pattern = re.compile(like_regex(kw.strip(" ").lower()))
        for pid, name, about, cat, *_ in products:
            if cat is not None and any(t is not None and pattern.search(t.lower()) for t in (name, about, names[cat])):
                want.add((kw, pid))
    df = spark.createDataFrame([(k,) for k in keywords], "Keyword string")
    got = S.search_many(shop, df, AS_OF)
    assert {(r.Keyword, r.ProductID) for r in got.collect()} == want and len(want) > 1000
    index = S.postings(shop.named_products)
    some = df.where(F.col("Keyword").isin("shi", "CAPS", "[sc]", "sh%t"))
    for kw in ("shi", "CAPS", "[sc]", "sh%t"):
        one = rows(C.search_products(shop, kw, AS_OF), "ProductID", "DiscountedPrice")
        many = rows(S.search_many(shop, some, AS_OF, index).where(F.col("Keyword") == kw), "ProductID", "DiscountedPrice")
        assert one == many and one


def test_no_keywords_and_no_products(spark):
    shop, _ = shop_of(spark, random.Random(1))
    none = spark.createDataFrame([], "Keyword string")
    assert S.search_many(shop, none, AS_OF).count() == 0
    assert S.search_many(shop, spark.createDataFrame([("a",)], "Keyword string"), AS_OF, S.postings(shop.named_products.limit(0))).count() == 0


def test_postings_are_not_broadcast(spark, tmp_path):
    """The product file is far under the broadcast bound, the postings made of it are not."""
    spark.createDataFrame([(i, f"thing {i}", "Brand#1", "LARGE BRASS", 5, 10.0) for i in range(50)], Tb.DRIVER_SCHEMAS["part"]).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "thing 1", 1)], Tb.DRIVER_SCHEMAS["nation"]).coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    got = QUERIES["search_many"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sent and not [s for s in sent if "gram#" in s and "ProductID#" in s]
    assert got.where("Keyword = 'thing 1'").count() == 11
