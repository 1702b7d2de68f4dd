"""Scalar functions and predicates as plain Column expressions.

Nothing here is a Python UDF: every function builds a Catalyst
expression, so it is evaluated inside whole-stage codegen next to the
scan and the join that feed it.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)        # Price, UnitPrice
RAW_MONEY = T.DecimalType(14, 4)    # unrounded search price
LINE_MONEY = T.DecimalType(21, 2)   # quantity x unit price
SUM_MONEY = T.DecimalType(38, 2)    # sums of line totals

# The shop's stock labels, as the client prints them.
IN_STOCK_LABEL = "В наличии (%d шт.)"
OUT_OF_STOCK_LABEL = "Нет в наличии"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_timestamp(as_of) -> Column:
    """``as_of`` as a timestamp Column.  A naive datetime is a wall-clock
    value in the session time zone (it is sent as text, so the Python
    process's own zone never shifts it)."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.to_timestamp(F.lit(as_of))
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is not None:
            return F.lit(as_of).cast("timestamp")
        return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    raise TypeError(f"as_of must be a timestamp, string or Column, got {type(as_of)!r}")


# F1 -------------------------------------------------------------------------
def discounted_price(price, pct) -> Column:
    """Null or zero percent keeps the price; else price - price*pct/100,
    rounded half-up to two places (decimal arithmetic throughout)."""
    price, pct = _col(price), _col(pct)
    cut = price - price * pct * F.lit(0.01).cast(T.DecimalType(2, 2))
    return F.when(pct.isNull() | (pct == 0), price.cast(MONEY)).otherwise(cut.cast(MONEY))


# F2 -------------------------------------------------------------------------
def discounted_price_raw(price, pct) -> Column:
    """Same rule, unrounded: four decimal places (search form)."""
    price, pct = _col(price), _col(pct)
    cut = price - price * pct * F.lit(0.01).cast(T.DecimalType(2, 2))
    return F.when(pct.isNull() | (pct == 0), price.cast(RAW_MONEY)).otherwise(cut.cast(RAW_MONEY))


# F3 -------------------------------------------------------------------------
def promo_active(valid_from, valid_to, as_of) -> Column:
    """Inclusive validity test; a null bound is never active."""
    return as_timestamp(as_of).between(_col(valid_from), _col(valid_to))


# F4 -------------------------------------------------------------------------
def promo_active_open(valid_from, valid_to, as_of) -> Column:
    """Client form: a missing bound is unbounded."""
    t, lo, hi = as_timestamp(as_of), _col(valid_from), _col(valid_to)
    return (lo.isNull() | (t >= lo)) & (hi.isNull() | (t <= hi))


# F5 -------------------------------------------------------------------------
def promo_applies(is_global, promo_category, item_category) -> Column:
    """Global promo, or same category; nulls count as 'does not apply'."""
    return (F.coalesce(_col(is_global), F.lit(False))
            | F.coalesce(_col(item_category) == _col(promo_category), F.lit(False)))


# F6 -------------------------------------------------------------------------
def line_total(qty, unit_price) -> Column:
    return (_col(qty).cast(T.DecimalType(10, 0)) * _col(unit_price)).cast(LINE_MONEY)


def money_cents(price) -> Column:
    """A two-place money value as a long number of cents (exact)."""
    return (_col(price) * F.lit(100)).cast("long")


def sum_line_totals(qty, unit_price) -> Column:
    """Sum of quantity x unit price as ``decimal(38,2)``, added up in long
    cents.  Exact like decimal arithmetic, but it stays on Spark's
    primitive fast path (a decimal(21,2) product would be summed with
    BigDecimal); under ANSI mode (Spark's default) an overflow past
    9.2e16 per group raises instead of wrapping."""
    cents = F.sum(_col(qty).cast("long") * money_cents(unit_price))
    return (cents.cast(T.DecimalType(38, 0)) / F.lit(100)).cast(SUM_MONEY)


# F7 -------------------------------------------------------------------------
def keyword_pattern(keyword: str | None, escape: bool = False) -> str | None:
    """Trimmed, lowercased '%kw%' pattern; None when the keyword is blank."""
    if keyword is None:
        return None
    kw = keyword.strip(" ").lower()
    if not kw:
        return None
    kw = kw.replace("\\", "\\\\")       # a backslash is a plain character in the shop's search
    if escape:
        kw = kw.replace("%", "\\%").replace("_", "\\_")
    return f"%{kw}%"


def like_regex(keyword: str) -> str:
    """Regular expression of a 'contains' search whose keyword may hold
    ``%``, ``_`` and character classes (``[abc]``, ``[a-f]``, ``[^x]``).  A
    class that is not closed matches nothing, as in the shop's search."""
    out, i = [], 0
    while i < len(keyword):
        c = keyword[i]
        if c == "[":
            end = keyword.find("]", i + 1)
            if end < 0:
                return "(?!)"
            body = keyword[i + 1:end]
            negated = body.startswith("^")
            members = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{members}]" if members else ("(?s:.)" if negated else "(?!)"))
            i = end
        else:
            out.append("(?s:.*)" if c == "%" else "(?s:.)" if c == "_" else re.escape(c))
        i += 1
    return "".join(out)


def keyword_match(cols, keyword: str | None, escape: bool = False) -> Column:
    """Case-insensitive 'contains' over several columns (null-tolerant OR).

    Without ``escape`` the keyword's own ``%``, ``_`` and ``[...]`` act as
    wildcards, as in the shop's search; a blank keyword matches nothing.
    """
    pattern = keyword_pattern(keyword, escape)
    if pattern is None:
        return F.lit(False)
    classes = not escape and "[" in keyword
    cond = None
    for c in cols:
        low = F.lower(_col(c))
        m = low.rlike(like_regex(keyword.strip(" ").lower())) if classes else low.like(pattern)
        cond = m if cond is None else (cond | m)
    return cond


# F8 -------------------------------------------------------------------------
def regex_match(col, keyword: str) -> Column:
    """Case-insensitive regular expression, keyword used unescaped."""
    return _col(col).rlike("(?i)" + keyword)


# F9 -------------------------------------------------------------------------
def product_audit_text(name, price, stock) -> Column:
    """'name price stock'; any null part makes the whole text null."""
    return F.concat(_col(name), F.lit(" "), _col(price).cast(MONEY).cast("string"),
                    F.lit(" "), _col(stock).cast("string"))


def promo_audit_text(code, pct) -> Column:
    """'code pct%'; null-propagating like the product form."""
    return F.concat(_col(code), F.lit(" "), _col(pct).cast("string"), F.lit("%"))


# F10 ------------------------------------------------------------------------
def stock_label(stock) -> Column:
    s = _col(stock)
    return F.when(s > 0, F.format_string(IN_STOCK_LABEL, s)).otherwise(F.lit(OUT_OF_STOCK_LABEL))


# F11 ------------------------------------------------------------------------
def display_price(discounted, price) -> Column:
    return F.coalesce(_col(discounted), _col(price))


# F12 ------------------------------------------------------------------------
def to_number(value, fallback=None) -> Column:
    """Lenient number parse: null, empty, non-numeric or non-finite -> fallback.
    Only plain decimal notation counts (no type suffixes such as "1.5d")."""
    raw = F.trim(_col(value).cast("string"))
    plain = raw.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    parsed = F.when(plain, raw.try_cast("double"))
    finite = F.when(F.isnan(parsed) | (F.abs(parsed) == F.lit(float("inf"))), F.lit(None)).otherwise(parsed)
    fb = F.lit(fallback).cast("double") if fallback is not None else F.lit(None).cast("double")
    return F.coalesce(finite, fb)
