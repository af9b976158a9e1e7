"""Reading in bounded pieces, narrower types, and the driver's memory."""

from __future__ import annotations

import gc
import logging
import os
import resource
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import Collection, get_client
from .types import SEQ, decode_frame

WARN, CRITICAL = 0.8, 0.9
#: Distinct values up to which floats, and the share of distinct values below which texts, count as categories.
FEW_FLOATS, FEW_TEXTS = 1000, 0.5
_log = logging.getLogger("tidemark")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one binary value in Arrow's stream format."""
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])


def read_in_chunks(collection: Collection, item: str, chunk_size: int = 100_000, columns: list[str] | None = None) -> Iterator[pd.DataFrame]:
    """The rows in order as pandas frames of exactly ``chunk_size`` rows (the last one may have fewer).

    Rows come as Arrow batches, partition by partition, so the driver holds
    no more than two partitions and a chunk; its memory is checked after each
    chunk.
    """
    it = collection.item(item, columns=columns)
    order = [F.col(f"`{k}`") for k in it.keys] + [SEQ]
    names = it._names(columns)
    ordered = it._rows().orderBy(*order).select(*(F.col(f"`{c}`") for c in names))
    frame = lambda table: decode_frame(table, it.keys, it._manifest["tags"], it._manifest["unnamed"])
    held: pa.Table | None = None
    for row in ordered.mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        more = pa.ipc.open_stream(row["batch"]).read_all()
        held = more if held is None else pa.concat_tables([held, more])
        while held.num_rows >= chunk_size:
            yield frame(held.slice(0, chunk_size).combine_chunks())
            held = held.slice(chunk_size)
            check_memory_usage()
    if held is not None and held.num_rows:
        yield frame(held.combine_chunks())


@contextmanager
def memory_efficient_read(chunk_size: int = 50_000):
    """Arrow batches of so many rows within the block; the setting is put back at its end."""
    spark, key = get_client(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(chunk_size))
    try:
        yield
    finally:
        spark.conf.set(key, before)
        gc.collect()


def downcast_stats(df: DataFrame, distinct: bool = True) -> dict[str, dict]:
    """Least and greatest value, nulls and (about) distinct values of each plain column, in one pass."""
    kinds = (T.NumericType, T.StringType)
    names = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    if not names:
        return {}
    made = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(names):
        x = F.col(f"`{c}`")
        made += [F.min(x).alias(f"a{k}"), F.max(x).alias(f"b{k}"), F.count_if(x.isNull()).alias(f"z{k}")] + ([F.approx_count_distinct(x).alias(f"d{k}")] if distinct else [])
    row = df.agg(*made).first()
    return {c: {"rows": row["n"], "min": row[f"a{k}"], "max": row[f"b{k}"], "nulls": row[f"z{k}"]} | ({"distinct": row[f"d{k}"]} if distinct else {}) for k, c in enumerate(names)}


_INTEGERS = [(T.ByteType(), 1 << 7), (T.ShortType(), 1 << 15), (T.IntegerType(), 1 << 31)]


def optimize_dataframe_memory(df, deep: bool = True):
    """Integers in the narrowest type that holds them all, doubles as floats where no value changes.

    Of a pandas frame, texts with few distinct values (and with ``deep``
    floats with few) also become categories; in Spark, Parquet's dictionaries
    do the same.
    """
    if isinstance(df, pd.DataFrame):
        return _optimize_pandas(df, deep)
    stats = downcast_stats(df, distinct=False)
    exact = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    lossy = df.agg(*(F.count_if(F.col(f"`{c}`").cast("float").cast("double") != F.col(f"`{c}`")).alias(c) for c in exact)).first().asDict() if exact else {}

    def narrow(f: T.StructField):
        c, s = F.col(f"`{f.name}`"), stats.get(f.name)
        if s and s["min"] is not None and isinstance(f.dataType, T.IntegralType):
            kind = next((t for t, limit in _INTEGERS if -limit <= s["min"] and s["max"] < limit), T.LongType())
            return c.cast(kind).alias(f.name)
        return c.cast("float").alias(f.name) if lossy.get(f.name) == 0 else c

    return df.select(*map(narrow, df.schema.fields))


def _optimize_pandas(df: pd.DataFrame, deep: bool) -> pd.DataFrame:
    made = df.copy()
    for name in made.columns:
        values = made[name]
        if pd.api.types.is_bool_dtype(values):
            continue
        if pd.api.types.is_integer_dtype(values.dtype) and isinstance(values.dtype, np.dtype):
            made[name] = pd.to_numeric(values, downcast="integer" if (values < 0).any() or values.dtype.kind == "i" else "unsigned")
        elif pd.api.types.is_float_dtype(values.dtype) and isinstance(values.dtype, np.dtype):
            narrow = values.astype("float32")
            if not deep or values.nunique() >= min(FEW_FLOATS, max(1, len(values) // 2)):
                made[name] = narrow if np.array_equal(narrow.astype("float64"), values, equal_nan=True) else values
            else:
                made[name] = values.astype("category")
        elif values.dtype == object and len(values) and values.map(lambda x: x is None or isinstance(x, str)).all():
            if values.nunique() / len(values) < FEW_TEXTS:
                made[name] = values.astype("category")
    return made


def estimate_dataframe_memory(df) -> float:
    """MB of a pandas frame, or what the optimizer estimates of a Spark frame."""
    if isinstance(df, pd.DataFrame):
        return float(df.memory_usage(deep=True).sum()) / (1 << 20)
    from .layout import plan_bytes

    return plan_bytes(df) / (1 << 20)


def get_memory_info() -> dict:
    """The driver's memory in GB: of the process, the machine's total, what's available, and the used share."""
    fields = dict(line.split(":", 1) for line in open("/proc/meminfo"))
    kb = lambda name: int(fields[name].split()[0]) / (1 << 20)
    rss = int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / (1 << 30)
    total, free = kb("MemTotal"), kb("MemAvailable")
    return {"rss_gb": rss, "peak_gb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1 << 20), "total_gb": total, "available_gb": free, "percent": 100 * (1 - free / total)}


def check_memory_usage(warn: float = WARN, critical: float = CRITICAL) -> float:
    """Log where the machine's memory runs out, and collect garbage near the end; the used share."""
    used = get_memory_info()["percent"] / 100
    if used > critical:
        _log.error("memory is at %.0f %%", 100 * used)
        gc.collect()
    elif used > warn:
        _log.warning("memory is at %.0f %%", 100 * used)
    return used


class MemoryMonitor:
    """``with MemoryMonitor() as m:`` logs how much the process grew, if by over 0.1 GB; ``m.growth_gb`` has it."""

    def __init__(self, warn_threshold: float = WARN):
        self.warn_threshold, self.start, self.growth_gb = warn_threshold, 0.0, 0.0

    def __enter__(self) -> MemoryMonitor:
        self.start = get_memory_info()["rss_gb"]
        check_memory_usage(self.warn_threshold)
        return self

    def __exit__(self, *_) -> None:
        self.growth_gb = get_memory_info()["rss_gb"] - self.start
        if self.growth_gb > 0.1:
            _log.info("the process grew by %.2f GB", self.growth_gb)
