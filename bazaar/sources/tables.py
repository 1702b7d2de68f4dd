"""Typed shop tables.

``load_shop`` maps the driver's TPC-H-style parquet tables onto the
shop schema (mapping in FIXTURES.md).  ``shop_from_tables`` wraps shop
tables that already exist under their own names.  Every table is a lazy
DataFrame: the parquet scans keep their column pruning and filter
pushdown, because each operator selects only what it reads.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.exprs import MONEY
from bazaar.operators.joins import literal_dimension

L, I, S, B, TS = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PRODUCTS = _schema(("ProductID", L), ("ProductName", S), ("Description", S), ("CategoryID", L),
                   ("Price", MONEY), ("StockQuantity", I), ("ImageURL", S))
CATEGORIES = _schema(("CategoryID", L), ("CategoryName", S))
PROMOCODES = _schema(("PromoID", L), ("Code", S), ("DiscountPercent", I), ("IsGlobal", B),
                     ("CategoryID", L), ("ValidFrom", TS), ("ValidTo", TS))
USERS = _schema(("UserID", L), ("Username", S), ("PasswordHash", S), ("Email", S))
ROLES = _schema(("RoleID", L), ("RoleName", S))
USER_ROLES = _schema(("UserID", L), ("RoleID", L))
FAVORITES = _schema(("UserID", L), ("ProductID", L))
CART_ITEMS = _schema(("UserID", L), ("ProductID", L), ("Quantity", I))
CART_EVENTS = _schema(("event_id", L), ("ts", TS), ("UserID", L), ("ProductID", L), ("op", S), ("qty", I))
ORDERS = _schema(("OrderID", L), ("UserID", L), ("PromoID", L), ("StatusID", L))
ORDER_STATUSES = _schema(("StatusID", L), ("StatusCode", S), ("DisplayName", S))
ORDER_ITEMS = _schema(("OrderID", L), ("ProductID", L), ("Quantity", I), ("UnitPrice", MONEY))
LOGS = _schema(("LogID", L), ("UserID", L), ("Action", S), ("Timestamp", TS))

# Schemas of the driver tables read here (explicit: no footer inference).
DRIVER_SCHEMAS = {
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", T.DoubleType())),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", T.DoubleType()),
                        ("c_mktsegment", S)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", T.DoubleType()),
                      ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", T.DoubleType()), ("l_extendedprice", T.DoubleType()),
                        ("l_discount", T.DoubleType()), ("l_tax", T.DoubleType()), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", T.DoubleType()),
                      ("props", S)),
}

# Role names and order statuses of the shop.
ROLE_ROWS = [(1, "Admin"), (2, "User")]
STATUS_ROWS = [(1, "pending", "Pending"), (2, "processing", "Processing"), (3, "completed", "Completed")]

# The promo fixture of FIXTURES.md, evaluated at AS_OF.
AS_OF = dt.datetime(2024, 1, 15, 0, 0, 0)
PROMO_ROWS = [
    (1, "ECO10", 10, False, 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)),
    (2, "LARGE25", 25, False, 2, dt.datetime(2024, 1, 15), dt.datetime(2024, 2, 15)),
    (3, "MED15", 15, False, 3, dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 15)),
    (4, "MED33", 33, False, 3, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)),
    (5, "OLD50", 50, False, 4, dt.datetime(2023, 1, 1), dt.datetime(2023, 12, 31)),
    (6, "ALL20", 20, True, None, dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)),
    (7, "ZERO", 0, False, 5, dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)),
    (8, "SOON30", 30, False, 6, dt.datetime(2024, 1, 15, 0, 0, 1), dt.datetime(2024, 3, 1)),
]


class Shop:
    """The shop's tables as lazy DataFrames.

    Each table is built on first use, so a query touching two tables
    never lists or plans the others.
    """

    TABLES = ("products", "categories", "promocodes", "users", "roles", "user_roles", "favorites",
              "orders", "order_statuses", "order_items", "cart_events", "logs", "named_products")

    def __init__(self, **tables):
        self._made: dict[str, DataFrame | None] = {}
        self._factories = {}
        for name in self.TABLES:
            v = tables.pop(name, None)
            if callable(v) and not isinstance(v, DataFrame):
                self._factories[name] = v
            else:
                self._made[name] = v
        self._made["_cart_items"] = tables.pop("_cart_items", None)
        if tables:
            raise TypeError(f"unknown shop tables {sorted(tables)}")

    def __getattr__(self, name):
        if name.startswith("_") or name not in self.TABLES:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._factories[name]()
        if name == "named_products" and self._made[name] is None:
            self._made[name] = self.products.join(self.categories, "CategoryID", "inner")
        return self._made[name]

    @property
    def cart_items(self) -> DataFrame:
        """Current carts: the fold (D2) of the cart events, role-gated."""
        if self._made.get("_cart_items") is None:
            from bazaar.operators.writes import fold_cart_events
            self._made["_cart_items"] = fold_cart_events(self.cart_events, user_roles=self.user_roles,
                                                         roles=self.roles).items
        return self._made["_cart_items"]


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v.strftime('%Y-%m-%d %H:%M:%S.%f')}'"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small fixed table as an inline ``VALUES`` relation.

    Unlike ``createDataFrame(list)`` (an RDD of unknown size) this is a
    LocalRelation: Spark knows its exact size, so its joins are size-
    checked and broadcast by the planner itself.
    """
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    names = [f.name for f in schema.fields]
    cols = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS {f.name}"
                     for i, f in enumerate(schema.fields))
    aliases = ", ".join(f"c{i}" for i in range(len(names)))
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({aliases})")


def roles_frame(spark: SparkSession) -> DataFrame:
    return literal_dimension(literal_frame(spark, ROLE_ROWS, ROLES))


def statuses_frame(spark: SparkSession) -> DataFrame:
    return literal_dimension(literal_frame(spark, STATUS_ROWS, ORDER_STATUSES))


def promo_fixture(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, PROMO_ROWS, PROMOCODES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table with its explicit schema."""
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")



def categories_from_part(part: DataFrame) -> DataFrame:
    """One category per distinct p_type, numbered in name order.

    The distinct runs as a partial aggregate per task plus one shuffle;
    the numbering window then sees only the distinct type names.
    """
    types = part.select(F.col("p_type").alias("CategoryName")).distinct()
    return types.select(
        F.row_number().over(Window.orderBy("CategoryName")).cast("long").alias("CategoryID"),
        "CategoryName")


def load_shop(spark: SparkSession, sf_dir: str, promocodes: DataFrame | None = None) -> Shop:
    """Shop view of the driver's tables (FIXTURES.md section 2), built lazily."""
    def rd(name):
        return read_table(spark, sf_dir, name)

    made: dict[str, DataFrame] = {}

    def categories():
        if "categories" not in made:
            made["categories"] = categories_from_part(rd("part"))
        return made["categories"]

    def named_products():
        """Products with their category's name: id and name come with one join."""
        part, cats = rd("part"), categories()
        return (part.join(cats, part["p_type"] == cats["CategoryName"], "inner")
                .select(
                    "CategoryName",
                    F.col("p_partkey").alias("ProductID"),
                    F.col("p_name").alias("ProductName"),
                    F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit(" size "),
                             F.col("p_size").cast("string")).alias("Description"),
                    F.col("CategoryID"),
                    F.col("p_retailprice").cast(MONEY).alias("Price"),
                    (F.col("p_size") - 1).cast("int").alias("StockQuantity"),
                    F.when(F.col("p_partkey") % 5 != 0,
                           F.concat(F.lit("C:/shop/images/"), F.col("p_partkey").cast("string"),
                                    F.lit(".jpg"))).alias("ImageURL")))

    def products():
        return named_products().drop("CategoryName")

    def users():
        return rd("customer").select(
            F.col("c_custkey").alias("UserID"),
            F.col("c_name").alias("Username"),
            F.lit(None).cast("string").alias("PasswordHash"),
            F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("Email"))

    def user_roles():
        customer = rd("customer")
        return (customer.filter(F.col("c_custkey") % 50 != 49)
                .select(F.col("c_custkey").alias("UserID"), F.lit(2).cast("long").alias("RoleID"))
                .unionByName(customer.filter(F.col("c_custkey") % 20 == 0)
                             .select(F.col("c_custkey").alias("UserID"),
                                     F.lit(1).cast("long").alias("RoleID"))))

    def orders():
        return rd("orders").select(
            F.col("o_orderkey").alias("OrderID"),
            F.col("o_custkey").alias("UserID"),
            F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_orderkey") % 8 + 1).cast("long")).alias("PromoID"),
            F.when(F.col("o_orderstatus") == "O", F.lit(1)).when(F.col("o_orderstatus") == "P", F.lit(2))
            .otherwise(F.lit(3)).cast("long").alias("StatusID"))

    def order_items():
        return rd("lineitem").select(
            F.col("l_orderkey").alias("OrderID"),
            F.col("l_partkey").alias("ProductID"),
            F.col("l_quantity").cast("int").alias("Quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("UnitPrice"))

    product_key = F.regexp_extract(F.col("props"), "[0-9]+", 0).cast("long")

    def cart_events():
        return (rd("events").filter(F.col("event_type").isin("click", "error", "signup"))
                .select(
                    "event_id", "ts",
                    F.col("user_id").alias("UserID"),
                    product_key.alias("ProductID"),
                    F.when(F.col("event_type") == "click", F.lit("delta"))
                    .when(F.col("event_type") == "error", F.lit("set"))
                    .otherwise(F.lit("remove")).alias("op"),
                    F.when(F.col("event_type") == "click", F.col("event_id") % 5 - 1)
                    .when(F.col("event_type") == "error", F.col("event_id") % 4)
                    .cast("int").alias("qty")))

    def favorites():
        return (rd("events").filter(F.col("event_type") == "view")
                .select(F.col("user_id").alias("UserID"), product_key.alias("ProductID")))

    return Shop(
        products=products, named_products=named_products, categories=categories,
        promocodes=(lambda: promocodes) if promocodes is not None else (lambda: promo_fixture(spark)),
        users=users, roles=lambda: roles_frame(spark), user_roles=user_roles, favorites=favorites,
        orders=orders, order_statuses=lambda: statuses_frame(spark), order_items=order_items,
        cart_events=cart_events,
    )


def shop_from_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> Shop:
    """Wrap shop tables that already have the shop column names."""
    def get(name, schema):
        df = tables.get(name)
        return df if df is not None else spark.createDataFrame([], schema)
    return Shop(
        products=get("products", PRODUCTS), categories=get("categories", CATEGORIES),
        promocodes=get("promocodes", PROMOCODES), users=get("users", USERS),
        roles=tables.get("roles") if tables.get("roles") is not None else roles_frame(spark),
        user_roles=get("user_roles", USER_ROLES), favorites=get("favorites", FAVORITES),
        orders=get("orders", ORDERS),
        order_statuses=(tables.get("order_statuses") if tables.get("order_statuses") is not None
                        else statuses_frame(spark)),
        order_items=get("order_items", ORDER_ITEMS),
        cart_events=get("cart_events", CART_EVENTS), logs=tables.get("logs"),
        _cart_items=tables.get("cart_items"))
