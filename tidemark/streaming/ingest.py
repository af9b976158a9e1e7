"""Streams into items, and windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store.catalog import Collection


def append_stream(stream: DataFrame, collection: Collection, item: str, index: list[str], checkpoint: str, duplicate_handling: str = "keep_last", available_now: bool = True):
    """Append a streaming frame to an item, micro-batch by micro-batch; the item is made from the first one.

    A batch's number is recorded in the manifest that publishes its rows, so
    a batch that is delivered again after a failure is passed over.
    """
    stream_id = checkpoint.rstrip("/")

    def take(batch: DataFrame, number: int) -> None:
        with collection._lock(item):
            # read under the lock: what's built on it must be current when it's published
            old = collection._load(item)
            done = ((old or {}).get("system") or {}).get("_streams", {})
            if old is not None and done.get(stream_id, -1) >= number or batch.isEmpty():
                return
            if old is None:
                new = collection._built(item, batch, None, None, False, index, True)
            else:
                new = collection._appended(item, old, batch, None, False, duplicate_handling, None, index, True) or dict(old)
            new["system"] = dict(new["system"], _streams=done | {stream_id: number})
            collection._publish({item: new})

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, ts: str, late: str, length: str, slide: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Rows by event-time window and keys; rows more than ``late`` behind are dropped by the watermark."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key: runs of rows without a gap of the given length."""
    held = stream.withWatermark(ts, late) if late else stream
    return held.groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
