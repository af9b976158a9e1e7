"""Filters given as tuples, as column expressions that reach the Parquet scan."""

from __future__ import annotations

import datetime
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ValidationError

_COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _value(x):
    """A numpy or pandas value as a Python one."""
    if hasattr(x, "to_pydatetime"):
        return x.to_pydatetime()
    return x.item() if hasattr(x, "item") and not hasattr(x, "__len__") else x


def _literal(x):
    x = _value(x)
    # a naive instant stays one, whatever the session's time zone
    if hasattr(x, "tzinfo") and hasattr(x, "hour") and hasattr(x, "year") and x.tzinfo is None:
        return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(x)


def _one(column: str, op: str, value) -> Column:
    c = F.col(f"`{column}`")
    if op in _COMPARE:
        return _COMPARE[op](c, _literal(value))
    if op == "in":
        return c.isin([_value(v) for v in value]) if len(value) else F.lit(False)
    if op == "not in":
        return ~c.isin([_value(v) for v in value]) if len(value) else c.isNotNull()
    raise ValidationError(f"unknown operator {op!r} in a filter")


def normal_form(filters) -> list[list[tuple]]:
    """Filters as a list of alternatives, each a list of (column, operator, value) that must all hold."""
    if not filters:
        return []
    return [list(filters)] if isinstance(filters[0], tuple) else [list(x) for x in filters]


def compile_filters(filters, columns: list[str]) -> Column | None:
    """A list of tuples (all must hold) or a list of such lists (any must hold) as one expression.

    Operators: = == != < <= > >= in, not in.  Rows with a null in the column
    never pass, as in SQL.  Unknown columns raise a ValidationError.
    """
    alternatives = normal_form(filters)
    unknown = sorted({str(c) for every in alternatives for c, _, _ in every} - set(columns))
    if unknown:
        raise ValidationError(f"unknown columns in filters: {unknown}")
    if not alternatives:
        return None
    return reduce(operator.or_, (reduce(operator.and_, (_one(*x) for x in every), F.lit(True)) for every in alternatives))


def _micros(value, zoned: bool) -> int:
    """An instant's microseconds since 1970.  A value of another kind than the key's has another meaning in each time
    zone of a session, so it raises a TypeError, and nothing is left out for it."""
    if not isinstance(value, datetime.datetime) or (value.tzinfo is not None) != zoned:
        raise TypeError(f"{value!r} can't be compared with the key's bounds")
    passed = value - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC if zoned else None)
    return (passed.days * 86_400 + passed.seconds) * 1_000_000 + passed.microseconds


def may_match(filters, key: str, low, high) -> bool:
    """Whether a segment whose first key lies between ``low`` and ``high`` can hold a row that passes.

    Bounds of instants are ``{"us": microseconds since 1970 in UTC, "zoned": whether the key has a zone}``.
    """
    alternatives = normal_form(filters)
    if not alternatives or low is None or high is None:
        return True
    plain = _value
    if isinstance(low, dict):
        zoned, low, high = low.get("zoned"), low.get("us"), high.get("us")
        if low is None or high is None:
            return True
        plain = lambda x: _micros(_value(x), zoned)

    def possible(op: str, value) -> bool:
        try:
            if op == "in":
                return any(low <= plain(v) <= high for v in value)
            if op in ("=", "=="):
                return low <= plain(value) <= high
            if op in ("<", "<="):
                return low < plain(value) or (op == "<=" and low == plain(value))
            if op in (">", ">="):
                return high > plain(value) or (op == ">=" and high == plain(value))
        except TypeError:
            pass
        return True

    return any(all(c != key or possible(op, v) for c, op, v in every) for every in alternatives)
