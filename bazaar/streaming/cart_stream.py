"""T4: the cart fold (D2) run incrementally on Spark's own streaming state.

``transformWithState`` keeps a cart per user, one value state: of every product
the folded line and what later events can still change, the events since the
last reset (set / remove / starting line), so a new event meets every event it could
concern and the result does not depend on the order in which files arrive:
it is that of the batch fold over all events.  A user's new events cost one
read and one write of the cart, not several calls to the state per line.  The state schema is declared
in ``CartProcessor.init``; the carts are read from the state store with the
``statestore`` source, so nothing else is written for them.

``lateness`` bounds the state by Spark's watermark: an event-time timer per
user folds events behind the watermark into one base row a product, and events that
arrive behind it go to the ``late`` table.  Events of users without the User
role go to ``rejects``.  Both are parquet sinks, written exactly once.

State is partitioned by the user and stored by RocksDB with changelogs under
the query's checkpoint folder; a replayed micro-batch starts from the last
committed version, and the number of state partitions is the session's
``spark.sql.shuffle.partitions`` at the first start.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bazaar.operators.users import users_with_role
from bazaar.operators.writes import KEYS, NOT_A_SHOP_USER
from bazaar.sources.tables import CART_EVENTS

REASONED = T.StructType([*CART_EVENTS.fields, T.StructField("reason", T.StringType())])
LATE = "late event"

#: State of a user: by product the events that are not closed yet, and the line they and the closed ones fold to.
CART = ("lines array<struct<ProductID: bigint, quantity: int, present: boolean, "
        "open: array<struct<event_id: bigint, at: bigint, op: string, qty: int>>>>")

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass",
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Place of a starting line: before every time; events without a time stand before it.
_FIRST = -(2 ** 62)
_UNTIMED = _FIRST - 1


def _since_reset(events: list[tuple]) -> list[tuple]:
    """(at, event_id, op, qty) in time order from the last reset on."""
    events = sorted(events, key=lambda e: e[:2])
    last = max((i for i, e in enumerate(events) if e[2] != "delta"), default=0)
    return events[last:]


def _line(events: list[tuple]) -> tuple[int, bool]:
    """(quantity, whether there is a line) after events from ``_since_reset``."""
    quantity, present = 0, False
    for _, _, op, qty in events:
        if op == "delta":
            quantity, present = quantity + (qty or 0), True
        elif op == "base" or (op == "set" and qty is not None and qty > 0):
            quantity, present = qty, True
        else:
            quantity, present = 0, False
    return quantity, present


class CartProcessor(StatefulProcessor):
    """Folds the events of one user; emits the events that came too late."""

    def __init__(self, closing: bool):
        self.closing = closing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cart = handle.getValueState("open", CART)

    def _held(self) -> dict:
        """Open events by product."""
        cart = self.cart.get()
        return {} if cart is None else {p: [(e[1], e[0], e[2], e[3]) for e in events] for p, _, _, events in cart[0]}

    def _keep(self, cart: dict) -> None:
        if cart:
            self.cart.update(([(p, *_line(events), [(i, at, op, q) for at, i, op, q in events]) for p, events in cart.items()],))
        else:                     # nothing later can bring a line back but a new event
            self.cart.clear()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep(self._held() | {initialState["ProductID"]: [(_FIRST, -(2 ** 63), "base", initialState["Quantity"])]})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() if self.closing else None
        new = {}
        for r in rows:
            at = _UNTIMED if r["at"] is None else r["at"]
            if now is not None and _FIRST < at < now * 1000:
                yield Row(event_id=r["event_id"], at=r["at"], UserID=key[0], ProductID=r["ProductID"], op=r["op"], qty=r["qty"])
            else:
                new.setdefault(r["ProductID"], []).append((at, r["event_id"], r["op"], r["qty"]))
        if new:
            cart, times = self._held(), []
            for product, events in new.items():
                events = cart.get(product, []) + events
                times.append(min(e[0] for e in events))
                cart[product] = _since_reset(events)
            self._keep(cart)
            if self.closing:
                # the first moment at which an event of these products can be closed
                self.handle.registerTimer(max(min(times) // 1000 + 1, now + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Fold the events of a product behind the watermark into one base row at the place of the last of them."""
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        cart, later = {}, []
        for product, events in self._held().items():
            events = _since_reset(events)
            old = [e for e in events if e[0] < closed]
            rest = events[len(old):]
            later += [e[0] for e in rest[:1]]
            quantity, present = _line(old)
            if old and present:
                rest = [(old[-1][0], old[-1][1], "base", quantity), *rest]
            if rest:              # closed without a line: the product goes
                cart[product] = rest
        self._keep(cart)
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store provider that transformWithState needs, for queries started inside."""
    name, value = _PROVIDER
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def fold_stream(events: DataFrame, lateness: dt.timedelta | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The late events of a stream of cart events, folding the others into the state of the query."""
    timed = events
    if lateness is not None:
        timed = timed.withWatermark("ts", f"{int(lateness.total_seconds() * 1000)} milliseconds")
    # the time goes on as a number: Spark would drop late rows by a time column, here they are answered
    rows = timed.select("event_id", F.unix_micros("ts").alias("at"), *KEYS, "op", "qty")
    start = None if initial is None else initial.select(*KEYS, "Quantity").groupBy("UserID")
    out = rows.groupBy("UserID").transformWithState(
        CartProcessor(lateness is not None), "event_id long, at long, UserID long, ProductID long, op string, qty int", "Append",
        "EventTime" if lateness is not None else "None", initialState=start)
    return out.select("event_id", F.timestamp_micros("at").alias("ts"), *KEYS, "op", "qty", F.lit(LATE).alias("reason"))


def _state(root: str) -> str:
    return f"{root.rstrip('/')}/checkpoint/carts"


def read_carts(spark: SparkSession, root: str) -> DataFrame:
    """The carts as the last committed batch left them, read from the state store."""
    with _rocksdb(spark):
        state = spark.read.format("statestore").option("path", _state(root)).option("stateVarName", "open").load()
    lines = state.select(F.col("key.UserID").alias("UserID"), F.explode("value.lines").alias("line")).where("line.present")
    return lines.select("UserID", "line.ProductID", F.col("line.quantity").alias("Quantity"))


def read_side(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The ``rejects`` or ``late`` events of all complete batches."""
    return spark.read.schema(REASONED).parquet(f"{root.rstrip('/')}/{kind}")


def _run(stream: DataFrame, root: str, kind: str, name: str) -> None:
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint/{name}")
         .trigger(availableNow=True).start(f"{root.rstrip('/')}/{kind}"))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_cart_stream(spark: SparkSession, source_dir: str, root: str, user_roles: DataFrame | None = None,
                    roles: DataFrame | None = None, max_files_per_trigger: int | None = 1,
                    initial: DataFrame | None = None, lateness: dt.timedelta | None = None) -> DataFrame:
    """Fold every new cart-event parquet file under ``source_dir``
    (``max_files_per_trigger`` files per micro-batch) and return the carts.
    Run again later, it goes on where it stopped.  ``initial``: starting
    carts, taken up by the first run."""
    reader = spark.readStream.schema(CART_EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    names = [f.name for f in CART_EVENTS]
    good = reader.parquet(source_dir).select(*names)
    if user_roles is not None and roles is not None:
        shop_users = users_with_role(user_roles, roles, "User").select("UserID").distinct()
        refused = good.join(shop_users.withColumn("__user", F.lit(True)), "UserID", "left").where("__user is null")
        _run(refused.select(*names, F.lit(NOT_A_SHOP_USER).alias("reason")), root, "rejects", "rejects")
        good = good.join(shop_users, "UserID").select(*names)
    with _rocksdb(spark):
        _run(fold_stream(good, lateness, initial), root, "late", "carts")
    return read_carts(spark, root)
