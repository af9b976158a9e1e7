"""Rows by key: one of each, and instants of two frames in one zone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduplicate(df: DataFrame, keys: list[str], order: list[str | Column], keep: str = "last") -> DataFrame:
    """The ``first`` or ``last`` row of each key by ``order`` (``all``: every row).  Null keys equal each other.

    Rows shrink to one of a key before they are shuffled, so a key that has a
    third of all rows is no large task.
    """
    if keep not in ("first", "last", "all"):
        raise ValueError("keep must be first, last or all")
    if keep == "all":
        return df
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    quoted = lambda c: F.col(f"`{c}`")
    by = F.struct(*(quoted(c) if isinstance(c, str) else c for c in order))
    row = F.struct(*map(quoted, rest)) if rest else F.lit(True)
    picked = df.groupBy(*map(quoted, keys)).agg(pick(row, by).alias("~row"))
    return picked.select(*(quoted(c) if c in keys else F.col("`~row`")[c].alias(c) for c in df.columns))


def _in_zone(df, names: set[str], zone: str):
    if isinstance(df, pd.DataFrame):
        df = df.copy()
        moved = lambda x: x.tz_convert(zone) if x.tz is not None else x.tz_localize(zone)
        for c in names & set(df.columns):
            df[c] = moved(pd.DatetimeIndex(df[c]))
        if isinstance(df.index, pd.DatetimeIndex) and "" in names:
            df.index = moved(df.index)
        return df
    # a zone-less instant is one in the zone; as an instant it no longer depends on the session's
    utc = lambda c: F.convert_timezone(F.lit(zone), F.lit("UTC"), c)
    return df.withColumns({c: F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc(F.col(f"`{c}`")))) for c in names & set(df.columns) if isinstance(df.schema[c].dataType, T.TimestampNTZType)})


def _instants(df) -> dict[str, bool]:
    """The columns of instants, and whether each has a zone; a pandas index under the empty name."""
    if isinstance(df, pd.DataFrame):
        found = {c: df[c].dtype.tz is not None if isinstance(df[c].dtype, pd.DatetimeTZDtype) else False for c in df.columns if pd.api.types.is_datetime64_any_dtype(df[c].dtype)}
        return found | ({"": df.index.tz is not None} if isinstance(df.index, pd.DatetimeIndex) else {})
    return {f.name: isinstance(f.dataType, T.TimestampType) for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}


def align_timezones(one, two, zone: str = "UTC"):
    """Two pandas or two Spark frames whose common columns of instants (and pandas indexes) are in one zone, where at
    least one of them has a zone: zoned ones are converted, zone-less ones are taken as being in ``zone``.

    Spark's zoned instants have no zone of their own, so there only zone-less
    ones change.  Columns that are zone-less in both stay as they are.
    """
    a, b = _instants(one), _instants(two)
    names = {c for c in a.keys() & b.keys() if a[c] or b[c]}
    return _in_zone(one, names, zone), _in_zone(two, names, zone)
