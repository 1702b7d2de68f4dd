"""J4 / L2 for many keywords at once: n-gram postings, intersection, verification.

One plan answers a whole frame of keywords.  A keyword's literal parts give
its grams (of three characters, fewer for shorter parts); a product whose
name, description or category matches must hold all of them in that field.
The rarest grams of every keyword are looked up in the postings, the fields
that hold all of these are the candidates, and the shop's rule (F7, with its
``%``, ``_`` and ``[...]`` wildcards) is tested on them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.catalog import CATALOG_COLS, priced_products
from bazaar.sources.tables import Shop

#: Fields that are searched, by their number in the postings.
FIELDS = ("ProductName", "Description", "CategoryName")
GRAM = 3
#: Postings intersected per keyword, the rarest first; the rest of its grams is left to the verification.
LOOKUPS = 3

_CLASS = r"\[[^\]]*\]"


def keyword_regex(keyword: Column) -> Column:
    """F7's 'contains' search as a regular expression, from a trimmed, lowercased keyword column."""
    tokens = F.regexp_extract_all(keyword, F.lit(rf"(?s){_CLASS}|."), F.lit(0))

    def one(t: Column) -> Column:
        body = F.substring(t, F.lit(2), F.length(t) - 2)
        negated = body.startswith("^")
        members = F.regexp_replace(F.when(negated, F.substring(body, F.lit(2), F.length(body))).otherwise(body),
                                   r"([\\\[\]^&~|])", r"\\$1")
        chars = (F.when(members != "", F.concat(F.lit("["), F.when(negated, "^").otherwise(""), members, F.lit("]")))
                 .otherwise(F.when(negated, "(?s:.)").otherwise("(?!)")))
        plain = F.concat(F.lit("\\x{"), F.lower(F.hex(F.encode(t, "UTF-32"))), F.lit("}"))
        return (F.when(t == "%", "(?s:.*)").when(t == "_", "(?s:.)").when(t == "[", "(?!)")
                .when(F.length(t) > 1, chars).otherwise(plain))

    return F.array_join(F.transform(tokens, one), "")


def _literal_parts(keyword: Column) -> Column:
    """What stands between the wildcards; a class that is not closed ends the literal before it."""
    return F.split(F.regexp_replace(keyword, rf"{_CLASS}|[%_\[]", "\x00"), "\x00")


def _grams(part: Column, size: Column) -> Column:
    starts = F.when((size > 0) & (F.length(part) >= size), F.sequence(F.lit(1), F.length(part) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(part, i, size))


def keyword_grams(keywords: DataFrame) -> DataFrame:
    """(Keyword, regex, gram): every gram of every distinct keyword that is not blank.

    The gram size is that of the longest literal part, three at most; a
    keyword of wildcards only has the empty gram, which every field holds.
    """
    kw = keywords.select("Keyword").distinct().withColumn("kw", F.lower(F.trim("Keyword"))).where("kw != ''")
    parts = kw.withColumn("parts", _literal_parts(F.col("kw")))
    longest = F.array_max(F.transform("parts", lambda p: F.length(p)))
    sized = parts.withColumn("size", F.least(longest, F.lit(GRAM)))
    grams = F.array_distinct(F.flatten(F.transform("parts", lambda p: _grams(p, F.col("size")))))
    return sized.select("Keyword", keyword_regex(F.col("kw")).alias("regex"),
                        F.explode(F.when(F.col("size") > 0, grams).otherwise(F.array(F.lit("")))).alias("gram"))


def _spots(named_products: DataFrame) -> DataFrame:
    """(gram, ProductID, field): the grams of up to three characters of every searched field, as often as they stand there."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.lower(c).alias("text")) for i, c in enumerate(FIELDS)])
    texts = named_products.select("ProductID", F.explode(fields).alias("f")).select("ProductID", "f.field", "f.text").where("text is not null")
    spots = texts.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))).alias("at"))
    sized = spots.select("*", F.explode(F.array(*[F.lit(k) for k in range(GRAM + 1)])).alias("size"))
    # the empty gram once per field, others where they fit
    fits = ((F.col("size") == 0) & (F.col("at") == 1)) | ((F.col("size") > 0) & (F.col("at") + F.col("size") - 1 <= F.length("text")))
    return sized.where(fits).select(F.expr("substring(text, at, size)").alias("gram"), "ProductID", "field")


def postings(named_products: DataFrame) -> DataFrame:
    """(gram, ProductID, field): the grams of up to three characters of every searched field, once each.

    Can be written once (sorted by gram, so that lookups are pushed into the
    scan) and handed to ``search_many`` instead of being made anew.
    """
    return _spots(named_products).distinct()


def search_many(shop: Shop, keywords: DataFrame, as_of, index: DataFrame | None = None) -> DataFrame:
    """J4 for every distinct ``Keyword`` of a frame: (Keyword, the search's columns), one row per product and active promo.

    Blank and null keywords match nothing.  ``index``: postings written
    before (see ``postings``).  Cost per keyword follows the postings of its
    rarest grams, not the product table; a keyword of wildcards only is
    tested on every product.
    """
    wanted = keyword_grams(keywords)
    asked = wanted.select("gram").distinct()
    if index is not None:
        held = index.join(asked, "gram", "left_semi")
    else:       # grams that nobody asks for go before they are compared and shuffled
        held = _spots(shop.named_products).join(asked, "gram", "left_semi").distinct()
    counted = wanted.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("times")), "gram", "left")
    # a keyword with a gram that nobody holds has no match
    rare = Window.partitionBy("Keyword").orderBy(F.col("times").asc_nulls_first(), "gram")
    chosen = counted.withColumn("place", F.row_number().over(rare)).where(F.col("place") <= LOOKUPS)
    chosen = chosen.withColumn("need", F.max("place").over(Window.partitionBy("Keyword")))
    # postings grow with the products, many times their compressed files, by which Spark would judge and broadcast them
    hits = (chosen.where("times is not null").select("Keyword", "gram", "need").join(held.hint("merge"), "gram")
            .groupBy("Keyword", "ProductID", "field").agg(F.count(F.lit(1)).alias("n"), F.any_value("need").alias("need")))
    regexes = wanted.select("Keyword", "regex").distinct()
    candidates = hits.where("n = need").select("Keyword", "ProductID").distinct().join(regexes, "Keyword")
    rows = priced_products(shop, as_of, raw=True)
    match = F.lit(False)
    for c in FIELDS:
        match = match | F.coalesce(F.regexp_like(F.lower(c), F.col("regex")), F.lit(False))
    return candidates.join(rows, "ProductID").where(match).select("Keyword", *CATALOG_COLS)
