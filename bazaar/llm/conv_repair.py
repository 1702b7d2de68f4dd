"""Conversation structure repair: cheapest edits that make the turns alternate.

A row is a symbol (role initial and fault); a conversation is fit when its
role initials read ``(s?(ua)+)?``.  Equal consecutive symbols are collapsed,
each run is advanced through cached binary powers of the symbol's min-plus
transition over the four states of that pattern, and the choices are then
unrolled into the audit.  Transitions of parts of a conversation compose, so
long conversations are cut into blocks that are solved apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from bazaar.llm.common import cut, map_runs

#: Rows of a block: 2 ** BLOCK_BITS.
BLOCK_BITS = 16

DELETE, INSERT, RENAME, CUT_OFF = 2, 5, 1, 5

#: States: nothing yet, after s, after u, after a.  The user or assistant row that a state calls for leads to NEXT.
NEXT = (2, 2, 3, 2)
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Cost to finish after the last row, from each state.
FINISH = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
MUST_GO = 8
FAR = 1 << 40

_SPACE = "\\x20\\x09-\\x0D"


def called_for(state: int) -> str:
    return "assistant" if state == 2 else "user"


@lru_cache(maxsize=None)
def _edits(symbol: int) -> tuple[tuple[str, tuple[tuple[int, int] | None, ...]], ...]:
    """(letter, per state (cost, next state) or None), in ASCII order of the letters that use up a row."""
    gone = ("D", tuple((DELETE, q) for q in range(4)))
    if symbol == MUST_GO:
        return (gone,)
    extra, initial = (CUT_OFF if symbol >= 4 else 0), (INITIALS + "?")[symbol % 4]
    keep = tuple((extra, KEPT[initial, q]) if (initial, q) in KEPT else None for q in range(4))
    return gone, ("K", keep), ("R", tuple((RENAME + extra, NEXT[q]) for q in range(4)))


@lru_cache(maxsize=None)
def _power(symbol: int, j: int) -> np.ndarray:
    """Min-plus transition (from, to) of 2 ** j rows of a symbol, each with any inserts before it."""
    if j:
        half = _power(symbol, j - 1)
        return (half[:, :, None] + half[None, :, :]).min(axis=1)
    out = np.full((4, 4), FAR, np.int64)
    for q in range(4):
        at, paid = q, 0
        for _ in range(4):
            for _, moves in _edits(symbol):
                if moves[at] is not None:
                    cost, to = moves[at]
                    out[q, to] = min(out[q, to], paid + cost)
            at, paid = NEXT[at], paid + INSERT
    return out


@lru_cache(maxsize=65536)
def _advanced(symbol: int, j: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    return tuple((_power(symbol, j) + np.array(ahead)).min(axis=1).tolist())


def _before(symbol: int, count: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go before ``count`` rows of a symbol, from the cost to go after them."""
    j = 0
    while count:
        if count & 1:
            low = min(ahead)
            ahead = tuple(x + low for x in _advanced(symbol, j, tuple(x - low for x in ahead)))
        count >>= 1
        j += 1
    return ahead


@lru_cache(maxsize=65536)
def _choice(symbol: int, state: int, ahead: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest letters up to and with the next row's, and the state after it."""
    row = [min(m[q][0] + ahead[m[q][1]] for _, m in _edits(symbol) if m[q] is not None) for q in range(4)]

    def best(q: int) -> int:
        costs, paid = [], 0
        for _ in range(4):
            costs.append(paid + row[q])
            q, paid = NEXT[q], paid + INSERT
        return min(costs)

    letters = ""
    while True:
        left = best(state)
        options = dict(_edits(symbol))
        for letter in "DIKR":
            if letter == "I":
                if INSERT + best(NEXT[state]) == left:
                    letters, state = letters + "I", NEXT[state]
                    break
            elif letter in options and options[letter][state] is not None:
                cost, to = options[letter][state]
                if cost + ahead[to] == left:
                    return letters + letter, to


def _tails(runs: list[tuple[int, int]], ahead: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost to go before each run and after the last."""
    out = [ahead]
    for symbol, count in reversed(runs):
        out.append(_before(symbol, count, out[-1]))
    return out[::-1]


def unroll(runs: list[tuple[int, int]], state: int, ahead: tuple[int, ...], last: bool = True) -> tuple[str, int, int]:
    """(audit, state after it, cost to go at its start) of collapsed symbol runs.

    ``ahead`` is the cost to go after them; the inserts that finish a
    conversation are added for its ``last`` part.
    """
    tails, letters, start = _tails(runs, ahead), [], state
    for i, (symbol, count) in enumerate(runs):
        steps = [tails[i + 1]]
        for _ in range(count - 1):
            steps.append(_before(symbol, 1, steps[-1]))
        for after in reversed(steps):
            low = min(after)
            more, state = _choice(symbol, state, tuple(x - low for x in after))
            letters.append(more)
    while last and state in (1, 2):
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state, tails[0][start]


def transition(runs: list[tuple[int, int]]) -> np.ndarray:
    """Min-plus transition (from, to) of collapsed symbol runs."""
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for symbol, count in reversed(runs):
        j = 0
        while count:
            if count & 1:
                out = np.minimum((_power(symbol, j)[:, :, None] + out[None, :, :]).min(axis=1), FAR)
            count >>= 1
            j += 1
    return out


def faults(role: Column, text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no sign but white space; last sign other than ``.``, ``!`` or ``?``."""
    return ~text.rlike(f"[^{_SPACE}]"), ~text.rlike(f"[.!?][{_SPACE}]*\\z")


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv, seq, turn, symbol columns): one row per different (conv, turn, role, text), ``seq`` in conversation order.

    Equal rows are collapsed by an aggregate (so copies cost one row per map
    task), an earlier equal (role, text) is found by another one, and a range
    partitioning numbers the rows: no conversation has to fit a task.
    """
    blank, cut_off = faults(F.col("role"), F.col("text"))
    light = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), blank.alias("blank"), cut_off.alias("cut_off"))
    one = light.groupBy("conv", "turn", "role", "digest", "blank", "cut_off").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = (one.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
             .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    met = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.coalesce(F.col("first.has") != F.col("turn").isNotNull(), F.lit(False)) | F.coalesce(F.col("first.turn") != F.col("turn"), F.lit(False))
    by = ["conv", "turn", "role", "digest"]
    known = one.join(first, met, "left").select(
        *by, "blank", "cut_off", "copies", again.alias("again"), F.substring("role", 1, 1).alias("initial"))
    return cut(known.repartitionByRange(*by).sortWithinPartitions(*by)
               .select("conv", F.monotonically_increasing_id().alias("seq"), "turn", "initial", "blank", "cut_off", "again", "copies"), "turns")


class _Part:
    """The rows of one conversation inside one block, in order."""

    def __init__(self, initial: list[str], blank: list[bool], cut_off: list[bool], again: list[bool], copies: list[int],
                 turn: list[int | None]):
        self.runs: list[tuple[int, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        before = None
        for z, b, t, d, n in zip(initial, blank, cut_off, again, copies):
            if b:
                self.blank += n
                self._add(MUST_GO, n)
            else:
                self.duplicate += n if d else n - 1
                self.truncated += not d and t
                self._add(MUST_GO if d else (4 if t else 0) + (INITIALS.find(z) % 4 if z else 3), 1)
                self._add(MUST_GO, n - 1)
            self.illegal += (before is not None and (before, z) not in LEGAL) + n - 1
            before = z
        some = [t for t in turn if t is not None]
        self.first, self.last = initial[0], before
        self.low, self.high = (some[0], some[-1]) if some else (None, None)
        self.turns = sum(1 for _ in groupby(some))

    def _add(self, symbol: int, count: int) -> None:
        if count and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + count)
        elif count:
            self.runs.append((symbol, count))


_COLUMNS = ("initial", "blank", "cut_off", "again", "copies", "turn")


def _parts(cols: dict) -> Iterator[tuple[int, bool, _Part, int]]:
    """(first row, at an edge of the block, part, its first row in order) of every conversation in a block."""
    order = np.argsort(cols["seq"].to_numpy(zero_copy_only=False))
    conv = cols["conv"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[order]
    starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)])).tolist()
    lists = [cols[c].take(pa.array(order)).to_pylist() for c in _COLUMNS]
    for a, b in zip(starts[:-1], starts[1:]):
        yield int(order[a]), a == 0 or b == len(conv), _Part(*[x[a:b] for x in lists]), a


_STATS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
_STAT_TYPES = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"


def _arrow(kind: DataType, name: str = "conv") -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(name, to_arrow_type(kind))


def _solve_blocks(turns: DataFrame, kind: DataType) -> DataFrame:
    """One row per (conv, block): solved where the conversation lies inside, else with its transition."""
    def solve(key: tuple, cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("conv", "block", "edge", "audit", "cost", "matrix", *_STATS)}
        for at, edge, part, _ in _parts(cols):
            audit, _, cost = (None, 0, 0) if edge else unroll(part.runs, 0, FINISH)
            row = (cols["conv"][at].as_py(), key[0], edge, audit, cost, transition(part.runs).ravel().tolist() if edge else None,
                   *[getattr(part, s) for s in _STATS])
            for c, x in zip(out, row):
                out[c].append(x)
        return out

    long, text = pa.int64(), pa.string()
    types = pa.schema([_arrow(kind), ("block", long), ("edge", pa.bool_()), ("audit", text), ("cost", long), ("matrix", pa.list_(long)),
                       *[(s, text if s in ("first", "last") else long) for s in _STATS]])
    return map_runs(turns, ["block"], solve, f"conv {kind.simpleString()}, block long, edge boolean, audit string, cost long, "
                    f"matrix array<long>, {_STAT_TYPES}", types)


def _ahead(parts: DataFrame, kind: DataType) -> DataFrame:
    """(conv, block, ahead, last): the cost to go after every part of the conversations that cross blocks.

    A group holds one 4 x 4 matrix per 2 ** BLOCK_BITS rows of a conversation.
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        ahead, costs = [], np.array(FINISH)
        for m in reversed(pdf["matrix"].tolist()):
            ahead.append(costs.tolist())
            costs = (np.array(m).reshape(4, 4) + costs).min(axis=1)
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "ahead": ahead[::-1], "last": [False] * (len(pdf) - 1) + [True]})

    return (parts.select("conv", "block", "matrix").groupBy("conv")
            .applyInPandas(walk, f"conv {kind.simpleString()}, block long, ahead array<long>, last boolean"))


def _unroll_parts(turns: DataFrame, ahead: DataFrame, kind: DataType) -> DataFrame:
    """(conv, block, audits, states): a part's letters and the state after it, for each of the four states before it."""
    a = ahead.select(F.col("conv").alias("c"), F.col("block").alias("b"), "ahead", "last")
    rows = turns.join(a, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    def solve(key: tuple, cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("conv", "block", "audits", "states", "costs")}
        for at, _, part, _ in _parts(cols):
            found = [unroll(part.runs, q, tuple(cols["ahead"][at].as_py()), cols["last"][at].as_py()) for q in range(4)]
            for c, x in zip(out, (cols["conv"][at].as_py(), key[0], *[list(f) for f in zip(*found)])):
                out[c].append(x)
        return out

    long = pa.int64()
    types = pa.schema([_arrow(kind), ("block", long), ("audits", pa.list_(pa.string())), ("states", pa.list_(long)), ("costs", pa.list_(long))])
    return map_runs(rows, ["block"], solve, f"conv {kind.simpleString()}, block long, audits array<string>, states array<long>, "
                    "costs array<long>", types)


def _join_parts(parts: DataFrame, solved: DataFrame, kind: DataType) -> DataFrame:
    """Per conversation that crosses blocks: the letters of its parts in order, and its counts."""
    s = solved.select(F.col("conv").alias("c"), F.col("block").alias("b"), "audits", "states", "costs")
    both = parts.drop("audit", "cost", "matrix", "edge").join(s, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("block").astype(object).where(pdf.notna(), None).to_dict("records")
        state, letters, before, last_turn = 0, [], None, None
        illegal, turns = 0, 0
        for r in rows:
            letters.append(r["audits"][state])
            state = int(r["states"][state])
            illegal += r["illegal"]
            turns += r["turns"]
            if before is not None:
                illegal += (before["last"], r["first"]) not in LEGAL
                turns -= last_turn is not None and r["low"] == last_turn
            before, last_turn = r, r["high"]
        low, high = ([r[k] for r in rows if r[k] is not None] for k in ("low", "high"))
        return pd.DataFrame({"conv": [rows[0]["conv"]], "audit": ["".join(letters)], "cost": [int(rows[0]["costs"][0])],
                             **{k: [sum(int(r[k]) for r in rows)] for k in ("blank", "duplicate", "truncated")}, "illegal": [illegal],
                             "turns": [turns], "low": pd.array([min(low, default=None)], "Int64"), "high": pd.array([max(high, default=None)], "Int64")})

    return both.drop("c", "b").groupBy("conv").applyInPandas(
        walk, f"conv {kind.simpleString()}, audit string, cost long, blank long, duplicate long, truncated long, illegal long, "
              "turns long, low long, high long")


@dataclass
class Repair:
    """``summary``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.  ``rows``: conv, edit, role, text
    of every row that the edits keep, rename, insert or delete, conversation by conversation in order."""

    summary: DataFrame
    rows: DataFrame


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hand the letters of each conversation (its first row) to its rows, in order."""
    audit, at, state, conv, rows_end = "", 0, 0, None, 0
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])

        def put(*row: object) -> None:
            for c, x in zip(out, row):
                c.append(x)

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                put(conv, "I", called_for(state), "")
                at, state = at + 1, NEXT[state]

        convs, controls, roles, texts = (batch.column(i).to_pylist() for i in range(4))
        for c, control, role, text in zip(convs, controls, roles, texts):
            if control:
                audit, at, state, conv, rows_end = text, 0, 0, c, len(text.rstrip("I"))
                continue
            inserts()
            letter, at = audit[at], at + 1
            if letter == "R":
                role, state = called_for(state), NEXT[state]
            elif letter == "K":
                state = KEPT[role[:1], state]
            put(conv, letter, role, text)
            if at >= rows_end:
                inserts()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *[pa.array(x, pa.string()) for x in out[1:]]],
                                         names=["conv", "edit", "role", "text"])


def repair(rows: DataFrame) -> Repair:
    """Cheapest repair of every conversation of ``rows`` (conv, turn, role, text; other columns are not read).

    Rows are taken by turn, nulls first; rows of one turn by role, then by
    the text's SHA-256 (a defined order for rows the table leaves unordered).
    A null conv is a conversation of its own, null role and text are one space.
    Blank and duplicate (role and text seen earlier) rows must go; a row whose
    last sign is not ``.``, ``!`` or ``?`` costs 5 more unless it goes.  Keep
    costs 0, rename to user or assistant 1, delete 2, insert 5; of the
    cheapest edits the ASCII-least letters win.  An empty table gives empty frames.

    No conversation is gathered in one task but where ``rows`` of the result
    is used: it streams each conversation through one task, in order and in
    bounded memory but for the letters, as a hash over a whole conversation
    cannot be split.  Turns are written once without their texts.
    """
    kind = rows.schema["conv"].dataType
    clean = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    turns = _ordered(clean).withColumn("block", F.shiftright("seq", BLOCK_BITS))
    parts = cut(_solve_blocks(turns, kind), "blocks")
    edge = parts.where("edge")
    solved = cut(_unroll_parts(turns, _ahead(edge, kind), kind), "edges")
    counts = ("blank", "duplicate", "truncated", "illegal")
    inner = parts.where("not edge").select("conv", "audit", "cost", *counts, "turns", "low", "high")
    whole = cut(inner.unionByName(_join_parts(edge, solved, kind)), "repairs")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    summary = whole.select("conv", gaps.alias("gaps"), *counts, "cost", "audit")
    none = F.lit(None)
    control = whole.select("conv", F.lit(True).alias("control"), none.cast("string").alias("role"), F.col("audit").alias("text"),
                           none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("binary").alias("digest"))
    texts = clean.select("conv", F.lit(False).alias("control"), "role", "text", "turn", F.unhex(F.sha2("text", 256)).alias("digest"))
    by = [F.col("conv"), F.col("control").desc(), F.col("turn"), F.col("role"), F.col("digest")]
    dealt = control.unionByName(texts).repartition("conv").sortWithinPartitions(*by).select("conv", "control", "role", "text")
    return Repair(summary, dealt.mapInArrow(_apply, f"conv {kind.simpleString()}, edit string, role string, text string"))


def repaired_hashes(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) over the ``role:text`` lines left by the repair, joined by newlines.

    ``repaired`` are the rows of a ``Repair``, as they come (a conversation in a row).
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, lines, kind = object(), None, 0, None
        nothing = held
        done: list = []
        for batch in batches:
            kind = batch.column(0).type
            for conv, edit, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if held is nothing or conv != held:
                    if held is not nothing:
                        done.append((held, state.hexdigest()))
                    held, state, lines = conv, hashlib.sha256(), 0
                if edit != "D":
                    state.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
                    lines += 1
            if len(done) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "sha256"])
                done = []
        if held is not nothing:
            done.append((held, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "sha256"])

    return repaired.mapInArrow(digest, f"conv {repaired.schema['conv'].dataType.simpleString()}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): a fixed fault by crc32("conv_id:turn") % 20 in a quarter of the rows.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4 makes its
    role user.  Nulls count as one space, in the key as well; null ids and turns stay null.
    """
    def space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.where(kind != 0).select(
        F.col("conv_id").alias("conv"), "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("time")).drop("time")
