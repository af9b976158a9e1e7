"""Between pandas frames and typed Spark tables: what Spark has no type for is stored with a tag.

A tag is a small dictionary for a column in the item's manifest.  Values are
stored in the nearest Spark type, so filters and aggregates work on them; the
tag restores the pandas type on the way out.
"""

from __future__ import annotations

import datetime
import decimal
import json
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from .errors import ValidationError

SEQ = "__seq"
WIDE_COLUMNS, DEEP_KEYS = 1000, 5


@dataclass
class Encoded:
    """A pandas frame as an Arrow table with explicit Spark types; keys are its first columns."""

    table: pa.Table
    schema: T.StructType
    keys: list[str]
    tags: dict[str, dict] = field(default_factory=dict)
    unnamed: bool = False


def check_columns(names: list, n_keys: int = 0) -> None:
    """Reject repeated names, also those that differ in case only; warn of very wide tables and deep keys."""
    texts = [str(c) for c in names]
    if len({c.lower() for c in texts}) < len(texts):
        repeated = sorted({c for c in texts if [x.lower() for x in texts].count(c.lower()) > 1})
        raise ValidationError(f"Duplicate column names: {repeated}")
    if len(texts) - n_keys > WIDE_COLUMNS:
        warnings.warn(f"{len(texts)} columns are many", stacklevel=3)
    if n_keys > DEEP_KEYS:
        warnings.warn(f"{n_keys} key columns are many", stacklevel=3)


def encode_frame(pdf: pd.DataFrame, epochdate: bool = False) -> Encoded:
    """A pandas frame for storage.  A default index is no key; any other one, of any depth, becomes key columns."""
    if not len(pdf.columns) and not len(pdf):
        raise ValidationError("A frame without columns and rows can't be stored")
    index, unnamed = pdf.index, False
    if isinstance(index, pd.MultiIndex):
        keys = {name if name is not None else f"level_{k}": index.get_level_values(k) for k, name in enumerate(index.names)}
    elif isinstance(index, pd.RangeIndex) and index.name is None:
        keys = {}
    else:
        unnamed = index.name in (None, "")
        keys = {"index" if unnamed else index.name: index}
    check_columns([*keys, *pdf.columns], len(keys))
    columns = {str(name): pd.Series(values.array if hasattr(values, "array") else values) for name, values in keys.items()}
    columns |= {str(name): pdf.iloc[:, k].reset_index(drop=True) for k, name in enumerate(pdf.columns)}
    arrays, fields, tags = [], [], {}
    for name, values in columns.items():
        array, kind, tag = _encode(values, epochdate and name in map(str, keys))
        arrays.append(array)
        fields.append(T.StructField(name, kind, True))
        if tag:
            tags[name] = tag
    return Encoded(pa.table(arrays, names=list(columns)), T.StructType(fields), [str(k) for k in keys], tags, unnamed)


_SIGNED = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType()}
_NUMPY = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType()}
_ARROW = {T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}


def _instants(values: pd.Series, epoch: bool) -> tuple[pa.Array, T.DataType, dict]:
    zone = getattr(values.dtype, "tz", None)
    utc = (values.dt.tz_convert("UTC").dt.tz_localize(None) if zone is not None else values).astype("datetime64[ns]")
    nanos, missing = utc.astype("int64").to_numpy(), utc.isna().to_numpy()
    tag = {"kind": "instant", "dtype": str(values.dtype), "tz": str(zone) if zone is not None else None}
    if epoch or (nanos[~missing] % 1000).any():
        return pa.array(nanos, mask=missing), T.LongType(), tag | {"kind": "instant_ns"}
    micros = pa.array(nanos // 1000, pa.int64(), mask=missing)
    if zone is not None:
        return micros.cast(pa.timestamp("us", "UTC")), T.TimestampType(), tag
    return micros.cast(pa.timestamp("us")), T.TimestampNTZType(), tag


def _encode(values: pd.Series, epoch: bool = False) -> tuple[pa.Array, T.DataType, dict | None]:
    kind, name = values.dtype, str(values.dtype)
    if isinstance(kind, pd.CategoricalDtype):
        if kind.categories.inferred_type == "string":
            codes = values.cat.codes.to_numpy()
            array, spark = pa.array(kind.categories.tolist(), pa.string()).take(pa.array(codes, mask=codes < 0)), T.StringType()
        else:
            array, spark, _ = _encode(pd.Series(values.astype(kind.categories.dtype) if kind.categories.dtype.kind not in "iub" or not values.isna().any() else values.astype(object)))
        return array, spark, {"kind": "category", "categories": json.loads(_dumps(kind.categories.tolist())), "ordered": bool(kind.ordered)}
    if isinstance(kind, pd.PeriodDtype):
        codes, distinct = pd.factorize(values.array)
        texts = pa.array([str(x) for x in distinct], pa.string()).take(pa.array(codes, pa.int64(), mask=codes < 0))
        return texts, T.StringType(), {"kind": "period", "freq": name[len("period[") : -1]}
    if isinstance(kind, pd.IntervalDtype):
        sides = pd.arrays.IntervalArray(values.array)
        left, spark, inner = _encode(pd.Series(sides.left))
        right, _, _ = _encode(pd.Series(sides.right))
        both = pa.StructArray.from_arrays([left, right], ["left", "right"], mask=pa.array(values.isna().to_numpy()))
        return both, T.StructType([T.StructField("left", spark), T.StructField("right", spark)]), {"kind": "interval", "closed": kind.closed, "inner": inner, "dtype": name}
    if isinstance(kind, pd.DatetimeTZDtype) or name.startswith("datetime64"):
        return _instants(values, epoch)
    if name.startswith("timedelta64"):
        nanos, missing = values.astype("timedelta64[ns]").astype("int64").to_numpy(), values.isna().to_numpy()
        if (nanos[~missing] % 1000).any():
            return pa.array(nanos, mask=missing), T.LongType(), {"kind": "duration_ns", "dtype": name}
        return pa.array(nanos // 1000, pa.int64(), mask=missing).cast(pa.duration("us")), T.DayTimeIntervalType(), {"kind": "duration", "dtype": name}
    if name in _NUMPY:
        missing = values.isna().to_numpy() if name.startswith("float") else None
        return pa.array(values.to_numpy(), _ARROW[_NUMPY[name]], mask=missing), _NUMPY[name], {"kind": "plain", "dtype": name}
    if name in _SIGNED:
        return pa.array(values.to_numpy().astype("int64")).cast(_ARROW[_SIGNED[name]]), _SIGNED[name], {"kind": "plain", "dtype": name}
    if name == "uint64":
        return pa.array([decimal.Decimal(int(x)) for x in values], pa.decimal128(20, 0)), T.DecimalType(20, 0), {"kind": "plain", "dtype": name}
    if name == "float16":
        return _encode(values.astype("float32"))[:2] + ({"kind": "plain", "dtype": name},)
    if name.lower() in _NUMPY or name == "boolean":
        spark = _NUMPY["bool" if name == "boolean" else name.lower()]
        return pa.array(values.astype(object).where(values.notna(), None).tolist(), _ARROW[spark]), spark, {"kind": "plain", "dtype": name}
    return _encode_objects(values)


def _encode_objects(values: pd.Series) -> tuple[pa.Array, T.DataType, dict | None]:
    items = [None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x) else x for x in values]
    kinds = {type(x) for x in items if x is not None}
    dtype = {"kind": "object", "dtype": str(values.dtype)}
    if not kinds or kinds == {str}:
        return pa.array(items, pa.string()), T.StringType(), dtype
    if kinds <= {bool, np.bool_}:
        return pa.array(items, pa.bool_()), T.BooleanType(), dtype
    if kinds == {bytes}:
        return pa.array(items, pa.binary()), T.BinaryType(), dtype
    if kinds == {decimal.Decimal}:
        return pa.array(items, pa.decimal128(38, 18)), T.DecimalType(38, 18), dtype
    if kinds == {datetime.date}:
        return pa.array(items, pa.date32()), T.DateType(), dtype
    if kinds <= {pd.Timestamp, datetime.datetime}:
        try:
            return _encode(pd.Series(pd.to_datetime(pd.Series(items, dtype=object))))
        except (TypeError, ValueError):
            pass
    if kinds <= {int, np.int64, np.int32}:
        try:
            return pa.array([None if x is None else int(x) for x in items], pa.int64()), T.LongType(), dtype
        except (OverflowError, pa.ArrowInvalid):
            pass
    if not kinds <= {list, dict, set, tuple, np.ndarray, pd.DataFrame}:
        warnings.warn(f"column {values.name!r} has values of several types; they're stored as JSON", stacklevel=4)
    return pa.array([None if x is None else _dumps(x) for x in items], pa.string()), T.StringType(), {"kind": "json"}


def _plain(x):
    if isinstance(x, (set, frozenset)):
        return {"~set": sorted(x, key=repr)}
    if isinstance(x, pd.DataFrame):
        return {"~frame": x.to_json(orient="split", date_format="iso")}
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    return str(x)


_encoder = json.JSONEncoder(default=_plain, ensure_ascii=False)


def _dumps(x) -> str:
    return _encoder.encode(x)


def _special(x: dict):
    if set(x) == {"~set"}:
        return set(x["~set"])
    if set(x) == {"~frame"}:
        import io

        return pd.read_json(io.StringIO(x["~frame"]), orient="split")
    return x


_decoder = json.JSONDecoder(object_hook=_special)


def _loaded(texts: list[str | None]) -> list:
    """The values of JSON texts, all parsed at once."""
    try:
        values = _decoder.decode(f"[{','.join('null' if x is None else x for x in texts)}]")
    except ValueError:
        values = []
    # texts that aren't one value each raise their own error
    return values if len(values) == len(texts) else [None if x is None else _decoder.decode(x) for x in texts]


def _decode(array: pa.ChunkedArray, tag: dict | None) -> pd.Series:
    kind = (tag or {}).get("kind")
    if kind == "instant_ns" or kind == "instant":
        stored = array if pa.types.is_integer(array.type) else array.cast(pa.timestamp("us", getattr(array.type, "tz", None))).cast(pa.int64())
        factor = 1 if pa.types.is_integer(array.type) else 1000
        missing = np.asarray(stored.is_null())
        nanos = stored.fill_null(0).to_numpy() * factor
        series = pd.Series(nanos.astype("datetime64[ns]")).mask(missing)
        unit = tag["dtype"].split("[")[1].split(",")[0].rstrip("]") if "[" in tag["dtype"] else "ns"
        series = series.astype(f"datetime64[{unit}]")
        return series.dt.tz_localize("UTC").dt.tz_convert(tag["tz"]) if tag.get("tz") else series
    if kind in ("duration", "duration_ns"):
        stored = array if pa.types.is_integer(array.type) else array.cast(pa.duration("us")).cast(pa.int64())
        factor = 1 if pa.types.is_integer(array.type) else 1000
        nanos = stored.fill_null(0).to_numpy() * factor
        return pd.Series(nanos.astype("timedelta64[ns]")).mask(np.asarray(stored.is_null())).astype(tag["dtype"])
    if kind == "period":
        codes, distinct = pd.factorize(array.to_pandas().astype(object))
        return pd.Series(pd.PeriodIndex(list(distinct), freq=tag["freq"]).array.take(codes, allow_fill=True))
    if kind == "interval":
        flat = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
        left, right = (_decode(pa.chunked_array([flat.field(k)]), tag["inner"]) for k in (0, 1))
        return pd.Series(pd.arrays.IntervalArray.from_arrays(left, right, closed=tag["closed"]))
    if kind == "category":
        return pd.Series(pd.Categorical(array.to_pandas(), categories=tag["categories"], ordered=tag["ordered"]))
    if kind == "json":
        return pd.Series(_loaded(array.to_pandas().tolist()), dtype=object)
    series = array.to_pandas()
    if kind in ("plain", "object"):
        try:
            if kind == "object" and tag["dtype"] == "object" and not pa.types.is_string(array.type):
                return pd.Series(array.to_pylist(), dtype=object)
            return series.astype(tag["dtype"])
        except (TypeError, ValueError):  # nulls that the type has no place for
            return series
    if pa.types.is_timestamp(array.type):
        return series.astype("datetime64[ns, UTC]" if array.type.tz else "datetime64[ns]")
    return series


def decode_frame(table: pa.Table, keys: list[str], tags: dict[str, dict], unnamed: bool, restore_tz: bool = False) -> pd.DataFrame:
    """The pandas frame of a stored table: tagged types are restored for the columns present, keys become the index.

    Zoned keys come out in UTC, or with ``restore_tz`` in the zone they had.
    """
    columns = {name: _decode(table.column(name), tags.get(name)) for name in table.column_names if name != SEQ}
    present = [k for k in keys if k in columns]
    if not restore_tz:
        for k in present:
            if getattr(columns[k].dtype, "tz", None) is not None:
                columns[k] = columns[k].dt.tz_convert("UTC")
    frame = pd.DataFrame({c: v for c, v in columns.items() if c not in present}, index=pd.RangeIndex(table.num_rows))
    if len(present) == 1:
        frame.index = pd.Index(columns[present[0]].array)
        frame.index.name = None if unnamed and present[0] == "index" else present[0]
    elif present:
        frame.index = pd.MultiIndex.from_arrays([columns[k] for k in present], names=present)
    return frame


def epoch_numbers(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame with an index of instants as nanoseconds since 1970; without one, as it is."""
    if isinstance(frame.index, pd.DatetimeIndex):
        frame.index = pd.Index(frame.index.astype("datetime64[ns]" if frame.index.tz is None else "datetime64[ns, UTC]").astype("int64"), name=frame.index.name)
    return frame
