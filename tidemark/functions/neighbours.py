"""The next row of a key, without putting all rows of a key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, keys: list[str], position: str, carried: list[str], width: int | Column) -> DataFrame:
    """``df`` with ``next_<position>`` and ``next_<c>`` of each carried column: those of the key's next position.

    Positions are integers, at most one row for each of a key.  A key's rows
    are divided into buckets of ``width`` positions, and each bucket is a
    group of its own; what the last row of a bucket needs is the first row of
    the key's next bucket, found among the buckets' first rows.  So no group
    has more than ``width`` rows, or more than one row for each bucket.
    The width may differ from key to key.
    """
    row = F.struct(position, *carried)
    inner = df.withColumn("_bucket", F.floor(F.col(position) / width).cast("bigint"))
    first = inner.groupBy(*keys, "_bucket").agg(F.min_by(row, position).alias("_first"))
    later = first.select(*keys, "_bucket", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_later"))
    within = inner.withColumn("_within", F.lead(row).over(Window.partitionBy(*keys, "_bucket").orderBy(position)))
    joined = within.join(later, [*keys, "_bucket"], "left")
    after = F.coalesce("_within", "_later")
    return joined.select(*df.columns, *(after[c].alias(f"next_{c}") for c in [position, *carried]))
