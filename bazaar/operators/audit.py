"""Change capture: T1/T2 audit text from two table snapshots, J13 logs.

The shop's triggers write one log row per changed table row (they pick
one arbitrary row per statement; here every changed row is logged,
which equals the trigger whenever a statement touches one row).  A
snapshot diff is a full outer join on the key -- one shuffle per side,
no per-key state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.exprs import as_timestamp, product_audit_text, promo_audit_text
from bazaar.operators.ids import max_id, next_ids
from bazaar.operators.users import users_with_role
from bazaar.operators.writes import _gate_actor

# The audit log's action prefixes.
INSERT_PRODUCT = "Insert product: "
DELETE_PRODUCT = "Delete product: "
UPDATE_PRODUCT = "Update product: "
INSERT_PROMO = "Insert promocode: "
DELETE_PROMO = "Delete promocode: "
ARROW = " -> "

AUDIT_COLS = ["UserID", "Action", "Timestamp", "Key"]
PRODUCT_VALUE_COLS = ["ProductName", "Description", "CategoryID", "Price", "StockQuantity", "ImageURL"]


def _actor(actor_id) -> F.Column:
    return F.lit(actor_id).cast("long")


def _diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    o = old.select(F.col(key).alias("__key"), F.struct(*cols).alias("o"))
    n = new.select(F.col(key).alias("__key"), F.struct(*cols).alias("n"))
    return o.join(n, "__key", "full_outer")


def audit_products(old: DataFrame, new: DataFrame, actor_id, as_of) -> DataFrame:
    """T1: 'Insert product: t', 'Delete product: t', 'Update product: t -> t'
    with t = 'name price stock'; nothing when the actor is null.  An
    update is a row whose columns differ (null-safe)."""
    if actor_id is None:
        return new.sparkSession.createDataFrame([], "UserID long, Action string, Timestamp timestamp, Key long")
    d = _diff(old, new, "ProductID", PRODUCT_VALUE_COLS)
    text_o = product_audit_text("o.ProductName", "o.Price", "o.StockQuantity")
    text_n = product_audit_text("n.ProductName", "n.Price", "n.StockQuantity")
    changed = ~F.col("o").eqNullSafe(F.col("n"))
    action = (F.when(F.col("o").isNull(), F.concat(F.lit(INSERT_PRODUCT), text_n))
              .when(F.col("n").isNull(), F.concat(F.lit(DELETE_PRODUCT), text_o))
              .otherwise(F.concat(F.lit(UPDATE_PRODUCT), text_o, F.lit(ARROW), text_n)))
    return (d.filter(F.col("o").isNull() | F.col("n").isNull() | changed)
            .select(_actor(actor_id).alias("UserID"), action.alias("Action"),
                    as_timestamp(as_of).alias("Timestamp"), F.col("__key").alias("Key")))


def audit_promocodes(old: DataFrame, new: DataFrame, actor_id, as_of) -> DataFrame:
    """Inserts and deletes of promo codes ('code pct%'); updates are
    not logged."""
    if actor_id is None:
        return new.sparkSession.createDataFrame([], "UserID long, Action string, Timestamp timestamp, Key long")
    d = _diff(old, new, "PromoID", ["Code", "DiscountPercent"])
    action = (F.when(F.col("o").isNull(), F.concat(F.lit(INSERT_PROMO), promo_audit_text("n.Code", "n.DiscountPercent")))
              .when(F.col("n").isNull(), F.concat(F.lit(DELETE_PROMO), promo_audit_text("o.Code", "o.DiscountPercent"))))
    return (d.filter(F.col("o").isNull() | F.col("n").isNull())
            .select(_actor(actor_id).alias("UserID"), action.alias("Action"),
                    as_timestamp(as_of).alias("Timestamp"), F.col("__key").alias("Key")))


def append_logs(logs: DataFrame | None, entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Give new log entries LogIDs after the existing ones and append."""
    order = order or ["Timestamp", "Action", "Key"]
    start = max_id(logs, "LogID") if logs is not None else 0
    numbered = next_ids(entries, order, start, "LogID").select("LogID", "UserID", "Action", "Timestamp")
    return numbered if logs is None else logs.select("LogID", "UserID", "Action", "Timestamp").unionByName(numbered)


def logs(log_table: DataFrame, user_roles: DataFrame | None = None, roles: DataFrame | None = None,
         actor_id: int | None = None) -> DataFrame:
    """Every log row.  With the role tables the log is for admins:
    for any other ``actor_id`` the result is empty."""
    out = log_table.select("LogID", "UserID", "Action", "Timestamp")
    if user_roles is None or roles is None:
        return out
    admins = users_with_role(user_roles, roles, "Admin")
    return out if not admins.filter(F.col("UserID") == F.lit(actor_id)).isEmpty() else out.limit(0)


def log_requests(actors: DataFrame, user_roles: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who may read the log: (requests of admins, the others with a reason)."""
    return _gate_actor(actors, user_roles, roles, "Admin")
