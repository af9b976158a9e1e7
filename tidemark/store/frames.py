"""Pandas frames of tasks: rows with types that Spark lacks are encoded and decoded where they are, batch by batch.

A pandas frame of the driver can be no larger than the driver.  :class:`Frames`
stands for the frames that a function makes of a Spark table's batches, and is
written and appended as if they were one frame.  The types of the first rows
are taken for those of all, and each task tells what types its batches have.
Only where these turn out to be others are all encoded again, in the types
that they agree on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .errors import ValidationError
from .merging import common_type, merged_tag
from .types import SEQ, Encoded, decode_frame, encode_frame, epoch_numbers

#: Rows and bytes of the batches that make one pandas frame in a task.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 25
#: Rows whose types are tried first.
SAMPLE = 20
#: The hidden column for what describes a batch.
FOUND = "__found"


@dataclass
class Frames:
    """The pandas frames that ``make`` gives for the batches of a Spark frame, as one frame; its index is the keys'.

    ``make`` runs in tasks, once or twice for each batch, and must see rows only, not where batches end.
    """

    df: DataFrame
    make: Callable[[pd.DataFrame], pd.DataFrame]

    def written(self, path: str, epochdate: bool = False) -> tuple[T.StructType, list[str], dict, bool]:
        """Write the rows in Spark's types, with SEQ; their schema, the keys, tags and whether the key has no name."""
        guess = _description(encode_frame(self.make(_pandas(self.df.limit(SAMPLE).toArrow())), epochdate))
        found = self._write(path, epochdate, guess) or guess
        if _types(found) != _types(guess):
            target, found = found, self._write(path, epochdate, found)
            if found is None or _types(found) != _types(target):
                raise ValidationError("the frames of the batches aren't the same when they're made again")
        return _schema(found), found["keys"], _tags(found), found["unnamed"]

    def _write(self, path: str, epochdate: bool, target: dict) -> dict | None:
        """Write the rows in the target's types, and tell what describes all of them; None if there are none.  A batch
        that needs other types isn't written, since then all must be written again."""
        make, schema, tags = self.make, _schema(target), _tags(target)
        arrow = to_arrow_schema(schema).append(pa.field(FOUND, pa.string()))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = None
            for table in gathered(batches):
                made = encode_frame(make(_pandas(table)), epochdate)
                if not made.table.num_rows:
                    continue
                own = _description(made)
                fits, more = _types(_united(target, own)) == _types(target), _united(told, own)
                rows = _fitted(made, schema, tags) if fits else pa.table([pa.nulls(1, f.type) for f in arrow][:-1], schema=to_arrow_schema(schema))
                # only the first row of a batch tells, and only what its task hasn't told before
                text, told = json.dumps(own) if more != told else None, more
                yield from rows.append_column(arrow[-1], pa.array([text] + [None] * (rows.num_rows - 1), pa.string())).to_batches()

        spark = self.df.sparkSession
        rows = self.df.mapInArrow(encode, T.StructType([*schema.fields, T.StructField(FOUND, T.StringType())]))
        rows.withColumn(SEQ, F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(path)
        found = None
        texts = spark.read.schema(f"`{FOUND}` string").parquet(path).where(F.col(f"`{FOUND}`").isNotNull()).distinct().collect()
        for row in sorted(texts):
            found = _united(found, json.loads(row[0]))
        return found


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to tables of a fair size; empty ones are left out."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _pandas(table: pa.Table) -> pd.DataFrame:
    return table.to_pandas(coerce_temporal_nanoseconds=True)


def _description(made: Encoded) -> dict:
    """Keys, types and tags of an encoded frame.  A column of objects without a value has no type of its own."""
    columns = {}
    for f in made.schema.fields:
        tag, array = made.tags.get(f.name), made.table.column(f.name)
        untyped = array.null_count == len(array) and (tag or {}).get("kind") in ("object", "category") and not (tag or {}).get("categories")
        columns[f.name] = {"type": f.dataType.jsonValue(), "tag": tag, "untyped": untyped}
    return {"keys": made.keys, "unnamed": made.unnamed, "columns": columns}


def _types(found: dict) -> dict:
    return {name: c["type"] for name, c in found["columns"].items()}


def _schema(found: dict) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_json_value(c["type"]), True) for name, c in found["columns"].items()])


def _tags(found: dict) -> dict:
    return {name: c["tag"] for name, c in found["columns"].items() if c["tag"]}


def _united(a: dict | None, b: dict) -> dict:
    """What describes two frames that are parts of one."""
    if a is None:
        return b
    if a["keys"] != b["keys"] or list(a["columns"]) != list(b["columns"]):
        raise ValidationError(f"the frames of the batches differ: keys {a['keys']}, {b['keys']}, columns {list(a['columns'])}, {list(b['columns'])}")
    return a | {"columns": {name: _united_column(name, c, b["columns"][name]) for name, c in a["columns"].items()}}


def _united_column(name: str, a: dict, b: dict) -> dict:
    # categories are united even where one side has no value
    if {(x["tag"] or {}).get("kind") for x in (a, b)} != {"category"} or not (a["tag"]["categories"] and b["tag"]["categories"]):
        if a["untyped"] or b["untyped"]:
            return b if a["untyped"] else a
    old, new = (T._parse_datatype_json_value(x["type"]) for x in (a, b))
    kinds = {(x["tag"] or {}).get("kind") for x in (a, b)}
    for fine in ("instant_ns", "duration_ns"):
        # nanoseconds in one batch are nanoseconds in all
        if kinds == {fine, fine.removesuffix("_ns")} and a["tag"].get("tz") == b["tag"].get("tz"):
            return a if a["tag"]["kind"] == fine else b
    kind = common_type(old, new)
    if kind is None or kinds <= {"instant", "instant_ns"} and a["tag"].get("tz") != b["tag"].get("tz"):
        raise ValidationError(f"column '{name}' is {old.simpleString()} in one batch and {new.simpleString()} in another, or of another zone")
    tag = merged_tag(name, a["tag"], b["tag"], old == kind)
    if kinds == {"category"}:
        own = [x["tag"]["categories"] for x in (a, b)]
        if a["tag"]["ordered"] != b["tag"]["ordered"] or a["tag"]["ordered"] and own[0] != own[1]:
            raise ValidationError(f"column '{name}' is an ordered category that differs between batches")
        if all(x == sorted(x) for x in own):
            tag = dict(tag, categories=sorted(tag["categories"]))
    return {"type": kind.jsonValue(), "tag": tag, "untyped": False}


def _fitted(made: Encoded, schema: T.StructType, tags: dict) -> pa.Table:
    """An encoded batch in the types of all; a value that they can't hold raises an error."""
    arrays = []
    for f in schema.fields:
        array, kind = made.table.column(f.name), to_arrow_type(f.dataType)
        own, whole = ((x.get(f.name) or {}).get("kind") for x in (made.tags, tags))
        if array.null_count == len(array):
            array = pa.nulls(len(array), kind)
        elif (own, whole) in (("instant", "instant_ns"), ("duration", "duration_ns")):
            array = pc.multiply_checked(array.cast(pa.int64()), 1000)
        arrays.append(array if array.type == kind else array.cast(kind))
    return pa.table(arrays, schema=to_arrow_schema(schema))


def mapped(rows: DataFrame, manifest: dict, make: Callable, schema: str | T.StructType) -> DataFrame:
    """``make`` of each batch of an item's stored rows; see Item.map_pandas."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    keys, tags, unnamed, names = manifest["keys"], manifest["tags"], manifest["unnamed"], kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):

            def read(restore_tz: bool = False, parse_dates: bool = True) -> pd.DataFrame:
                frame = decode_frame(table, keys, tags, unnamed, restore_tz)  # noqa: B023 - read is called at once
                return frame if parse_dates else epoch_numbers(frame)

            yield from pa.Table.from_pandas(make(read)[names], schema=to_arrow_schema(kind), preserve_index=False).to_batches()

    return rows.mapInArrow(run, kind)
