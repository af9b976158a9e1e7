"""Columns that read dirty notations as values: instants, numbers, JSON lines, delimited lines.

All of these are built-in expressions, so they stay in the JVM and in
whole-stage code.  None depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps from any notation to one, each on the result of the one before: parts of ISO 8601's basic form get their
#: marks, a date alone gets its midnight, a time its seconds, one without an offset gets UTC, an offset of hours gets its minutes.
_STEPS = [
    (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"),
    (r"(?<=[T ])(\d{2})(\d{2})(\d{2})(?=$|[.Z+-])", "$1:$2:$3"),
    (r"(?<=[T ])(\d{2})(\d{2})(?=$|[Z+-])", "$1:$2"),
    (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"),
    (r"(?<=[T ]\d{2}:\d{2})(?=$|[Z+-])", ":00"),
    (r"^(\d{4}-\d{2}-\d{2}[T ][0-9:.]+)$", "$1Z"),
    (r"(?<=[T ][0-9:.]{1,32})([+-]\d{2})$", "$1:00"),
]
_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


#: What may follow the seconds in the notations that are read without the steps, digits written as 0.  Fixed values.
_FRACTIONS, _ZONES = ["", ".000", ".000000"], ["", "Z", "+00:00", "-00:00"]


def instant_us(text: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a text in ISO 8601, extended or basic; null if it isn't a valid instant.

    An offset holds where given, else the text is in UTC; a date alone means
    its midnight.  Texts in the usual extended forms are told by their shape
    and cast as they are; only others go through the steps.
    """
    t = F.upper(F.trim(text))
    shape = F.translate(t, "123456789", "000000000")
    usual = {zone: [f"0000-00-00{mark}00:00:00{part}{zone}" for mark in "T " for part in _FRACTIONS] for zone in _ZONES}
    steps = t
    for pattern, by in _STEPS:
        steps = F.regexp_replace(steps, pattern, by)
    readable = F.when(shape.isin(usual[""]), F.concat(t, F.lit("Z"))).when(shape.isin([x for z in _ZONES[1:] for x in usual[z]]), t).otherwise(F.regexp_extract(steps, _INSTANT, 0))
    return F.unix_micros(readable.try_cast("timestamp"))


def ntz_us(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, which means UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def number(text: Column) -> Column:
    """A text's value as a double; null if it doesn't read as a decimal number.  The text is evaluated once."""
    return F.regexp_extract(F.trim(text), _NUMBER, 0).try_cast("double")


def floor_div(x: Column, by: Column) -> Column:
    """The floor of a quotient of integers, exact, also for negative ones."""
    return F.call_function("div", x - F.pmod(x, by), by)


def json_objects(line: Column, fields: list[str]) -> Column:
    """A list of one struct, the fields as text, for a line that is one valid JSON object; an empty list for others.

    Wrapped into a list with a sentinel behind it, the line must be exactly
    the first of two elements, so that nothing may follow the object, which a
    plain parse would not notice.  Each line is parsed once.
    """
    struct = ", ".join(f"`{x}` string" for x in fields)
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
    trimmed = F.trim(line, F.lit(" \t\r\n"))
    parsed = F.from_json(F.concat(F.lit("["), trimmed, F.lit(',{"~end":"1"}]')), f"array<struct<{struct}, `~end` string>>", options)
    whole = F.filter(F.array(parsed), lambda p: F.coalesce((F.size(p) == 2) & (p[1]["~end"] == "1"), F.lit(False)))
    return F.when(trimmed.startswith("{"), F.transform(whole, lambda p: p[0])).otherwise(F.array())
