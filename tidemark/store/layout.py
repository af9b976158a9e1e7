"""How many files an item gets, by size and by time range; rewriting an item's layout."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ValidationError

MB = 1 << 20
#: Rows from which on an item with a time key is laid out by time.
TIME_ROWS = 10_000
#: Days up to which (exclusive) the ranges are so long, in order; longer spans get years.  Fixed values.
FREQUENCIES = [(365, "month"), (1095, "quarter")]
MOST_RANGES = 100


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size: nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def folder_bytes(path: str) -> int:
    return sum(p.stat().st_size for p in Path(path.removeprefix("file:")).rglob("*.parquet"))


def files_for(size: int, target: int) -> int:
    """Files of about ``target`` bytes."""
    return 1 + size // target


def calculate_optimal_partitions(data, target_size_mb: float = 128, min_partitions: int = 1, max_partitions: int = 100) -> int:
    """Partitions of about the target size for a pandas or Spark frame, within the two bounds."""
    size = int(data.memory_usage(deep=True).sum()) if isinstance(data, pd.DataFrame) else plan_bytes(data)
    return max(min_partitions, min(max_partitions, int(size / MB / target_size_mb)))


def frequency(days: int) -> str:
    """The length of time ranges for a span of so many whole days."""
    return next((name for limit, name in FREQUENCIES if days < limit), "year")


def time_ranges(df: DataFrame, key: str, freq: str = "auto") -> tuple[str | None, int]:
    """The length of ranges for a time key, and how many of them the rows span; None for an unknown length."""
    row = df.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if row.a is None:
        return None, 0
    freq = frequency((row.b - row.a).days) if freq == "auto" else {"M": "month", "Q": "quarter", "Y": "year"}.get(freq, freq)
    months = {"month": 1, "quarter": 3, "year": 12}.get(freq)
    if months is None:
        return None, 0
    place = lambda t: (t.year * 12 + t.month - 1) // months
    return freq, place(row.b) - place(row.a) + 1


def optimize_time_series_partitions(data, key: str | None = None, freq: str = "auto") -> DataFrame:
    """A frame partitioned by ranges of its time key, one for each month, quarter or year that it spans.

    A pandas frame is taken with its index as the key.  More than 100 ranges,
    or an unknown length, leave the number to the size.  Ranges are cut by
    rows, so a busy month is no oversized task.
    """
    size = None
    if isinstance(data, pd.DataFrame):
        from .catalog import get_client
        from .types import encode_frame

        made, size = encode_frame(data), calculate_optimal_partitions(data)
        data = get_client().createDataFrame(made.table, made.schema)
        key = key or next(iter(made.keys), None)
    if key is None or not isinstance(data.schema[key].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise ValidationError("ranges of time need a key of instants")
    _, n = time_ranges(data, f"`{key}`", {"monthly": "month", "quarterly": "quarter", "yearly": "year"}.get(freq, freq))
    if not n or n > MOST_RANGES:
        n = size or calculate_optimal_partitions(data)
    return data.repartitionByRange(n, key).sortWithinPartitions(key)


def choose(made, target: int) -> tuple[int | None, dict | None]:
    """The number of files for new rows, and the strategy.  Rows of a Spark plan, whose size isn't known before it
    has run, get no number: the writer divides them by range and joins small ranges by their true sizes."""
    if made.rows is None:
        return None, {"type": "adaptive"}
    by_size = files_for(made.bytes, target)
    if made.rows > TIME_ROWS and len(made.keys) == 1 and isinstance(made.df.schema[made.keys[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        freq, n = time_ranges(made.df, f"`{made.keys[0]}`")
        if freq and n <= MOST_RANGES:
            return max(n, by_size), {"type": "time", "freq": freq}
    return by_size, {"type": "size", "target": target}


def rebalance_partitions(collection, item: str, target_size_mb: float = 128, time_based: bool = True) -> None:
    """Rewrite an item's segments as one, in files of about the target size or by time; its rows stay the same."""
    from .catalog import SEQ, Input, _now, _read_as

    with collection._lock(item):
        old = collection._manifest_of(item)
        df = _read_as(collection.spark, old)
        size = sum(folder_bytes(s["path"]) for s in old["segments"])
        n, strategy = files_for(size, int(target_size_mb * MB)), {"type": "size", "target": int(target_size_mb * MB)}
        key = old["keys"][0] if len(old["keys"]) == 1 else None
        if time_based and key and isinstance(df.schema[key].dataType, (T.TimestampType, T.TimestampNTZType)):
            freq, ranges = time_ranges(df, f"`{key}`")
            if freq and ranges <= MOST_RANGES:
                n, strategy = max(n, ranges), {"type": "time", "freq": freq}
        made = Input(df.select(*(F.col(f"`{c}`") for c in df.columns if c != SEQ), SEQ), old["keys"], old["tags"], old["unnamed"], size)
        segment = collection._segment(item, made, n)
        system = dict(old["system"], _partitions=n, _partition_strategy=strategy)
        collection._publish({item: dict(old, version=old["version"] + 1, segments=[segment], system=system, updated=_now())})
