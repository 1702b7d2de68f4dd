"""F1-F12 on hand-made frames (FIXTURES.md section 3)."""
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from bazaar.functions import exprs as X
from bazaar.sources.json_io import normalize_image_url
from conftest import AS_OF


def test_discounted_price_table(spark):
    cases = [(D("10.05"), 50, D("5.03")), (D("10.00"), None, D("10.00")), (D("10.00"), 0, D("10.00")),
             (None, 10, None), (D("99.99"), 100, D("0.00"))]
    df = spark.createDataFrame(cases, "price decimal(10,2), pct int, expected decimal(10,2)")
    out = df.select(X.discounted_price("price", "pct").alias("got"), "expected").collect()
    assert all(r.got == r.expected for r in out)


def test_discounted_price_raw_keeps_four_places(spark):
    df = spark.createDataFrame([(D("10.05"), 50)], "price decimal(10,2), pct int")
    assert df.select(X.discounted_price_raw("price", "pct")).first()[0] == D("5.0250")


def test_promo_active_inclusive_and_null_bounds(spark):
    df = spark.createDataFrame([
        (dt.datetime(2024, 1, 15), dt.datetime(2024, 2, 1), True),
        (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15), True),
        (dt.datetime(2024, 1, 15, 0, 0, 1), dt.datetime(2024, 2, 1), False),
        (None, dt.datetime(2024, 2, 1), None),
    ], "f timestamp, t timestamp, expected boolean")
    got = [r[0] for r in df.select(X.promo_active("f", "t", AS_OF)).collect()]
    assert got == [r.expected for r in df.collect()]
    opn = [r[0] for r in df.select(X.promo_active_open("f", "t", AS_OF)).collect()]
    assert opn == [True, True, False, True]


def test_promo_applies_null_safe(spark):
    df = spark.createDataFrame([(True, None, 3), (False, 3, 3), (False, 2, 3), (None, None, 3), (False, 1, None)],
                               "g boolean, pc long, ic long")
    assert [r[0] for r in df.select(X.promo_applies("g", "pc", "ic")).collect()] == [True, True, False, False, False]


def test_keyword_match_rules(spark):
    df = spark.createDataFrame([("Red Shirt", "cotton 100%"), ("blue_cap", None), ("Шапка", "зима")],
                               "name string, descr string")

    def hits(kw, escape=False):
        return sorted(r.name for r in df.filter(X.keyword_match(["name", "descr"], kw, escape)).collect())

    assert hits(None) == [] and hits("   ") == []
    assert hits("  SHIRT ") == ["Red Shirt"]
    assert hits("%") == sorted(["Red Shirt", "blue_cap", "Шапка"])        # unescaped wildcard
    assert hits("100%", escape=True) == ["Red Shirt"]
    assert hits("e_c") == ["blue_cap"] and hits("e_c", escape=True) == ["blue_cap"]
    assert hits("d_s") == ["Red Shirt"] and hits("d_s", escape=True) == []
    assert hits("ШАП") == ["Шапка"]


def test_regex_match_case_insensitive(spark):
    df = spark.createDataFrame([("Red ring",), ("bored",)], "n string")
    assert [r.n for r in df.filter(X.regex_match("n", "^RED")).collect()] == ["Red ring"]


def test_audit_text_format_and_nulls(spark):
    df = spark.createDataFrame([("Jence", D("82.00"), 12), ("X", None, 1)], "n string, p decimal(10,2), s int")
    got = [r[0] for r in df.select(X.product_audit_text("n", "p", "s")).collect()]
    assert got == ["Jence 82.00 12", None]
    pr = spark.createDataFrame([("WINTER50", 50)], "c string, d int")
    assert pr.select(X.promo_audit_text("c", "d")).first()[0] == "WINTER50 50%"


def test_stock_label_display_price_to_number(spark):
    df = spark.createDataFrame([(3,), (0,), (-1,)], "s int")
    labels = [r[0] for r in df.select(X.stock_label("s")).collect()]
    assert labels[0] == X.IN_STOCK_LABEL % 3 and labels[1] == labels[2] == X.OUT_OF_STOCK_LABEL
    dp = spark.createDataFrame([(None, D("5.00")), (D("4.00"), D("5.00"))], "d decimal(10,2), p decimal(10,2)")
    assert [r[0] for r in dp.select(X.display_price("d", "p")).collect()] == [D("5.00"), D("4.00")]
    nums = spark.createDataFrame([("",), (" 12 ",), ("1.5",), ("abc",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in nums.select(X.to_number("v", 7)).collect()] == [7.0, 12.0, 1.5, 7.0, 7.0, 7.0]


def test_normalize_image_url(spark):
    cases = [("C:\\Users\\u\\images\\a.jpg", "/images/a.jpg"), ("D:/pics/b.png", "/pics/b.png"),
             ("", ""), (None, None), ("/x/images/y/images/c.jpg", "/images/c.jpg")]
    df = spark.createDataFrame(cases, "u string, e string")
    got = df.select(normalize_image_url("u").alias("g"), "e").collect()
    assert all(r.g == r.e for r in got)
    assert df.select(F.count("*")).first()[0] == 5


def test_sum_line_totals_equals_decimal_sum(spark):
    import random
    rnd = random.Random(9)
    data = [(k % 7, rnd.randint(-5, 10_000), D(rnd.randint(0, 99_999_999)) / 100) for k in range(3000)]
    df = spark.createDataFrame(data, "k long, q int, p decimal(10,2)")
    got = {r.k: r.t for r in df.groupBy("k").agg(X.sum_line_totals("q", "p").alias("t")).collect()}
    want = {}
    for k, q, p in data:
        want[k] = want.get(k, D(0)) + q * p
    assert got == want and all(v.as_tuple().exponent == -2 for v in got.values())


def test_search_backslash_and_character_classes(spark):
    from bazaar.functions.exprs import keyword_match
    names = ["a\\b", "xa\\", "cat", "cot", "cut", "c[t", "100% wool", "snake_case"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def hits(kw, **how):
        return sorted(r.name for r in df.filter(keyword_match(["name"], kw, **how)).collect())
    assert hits("a\\b") == ["a\\b"] and hits("a\\") == ["a\\b", "xa\\"]
    assert hits("C[ao]T") == ["cat", "cot"] and hits("c[a-o]t") == ["cat", "cot"] and hits("c[^a]t") == ["c[t", "cot", "cut"]
    assert hits("c[t") == [] and hits("c[[]t") == ["c[t"] and hits("c[ou]%") == ["cot", "cut"]
    assert hits("c[t", escape=True) == ["c[t"] and hits("100%", escape=True) == ["100% wool"] and hits("e_c", escape=True) == ["snake_case"]
    assert hits("c_t") == ["c[t", "cat", "cot", "cut"]


def test_numbers_without_type_suffixes(spark):
    from bazaar.functions.exprs import to_number
    df = spark.createDataFrame([("1.5d",), ("1.5",), (" 2e3 ",), ("0x10",), ("7f",), (".5",), ("5.",), ("-1",), ("NaN",), ("",), (None,)], "v string")
    assert [r.n for r in df.select(to_number("v").alias("n")).collect()] == [None, 1.5, 2000.0, None, None, 0.5, 5.0, -1.0, None, None, None]
