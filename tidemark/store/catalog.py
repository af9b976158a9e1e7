"""Stores, collections and items: named, versioned tables in a folder.

An item is an ordered list of immutable segments (folders of Parquet files)
and one manifest, a small JSON file that is replaced in one step.  Writing
adds segments and publishes a new manifest; what no manifest names doesn't
exist.  A snapshot is a copy of manifests, not of data.  A change of several
items is recorded in one file first, and rolled forward from it if the
process dies in between.
"""

from __future__ import annotations

import concurrent.futures
import datetime
import json
import os
import shutil
import threading
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import same
from ..functions.normal import ntz_us
from . import layout
from .errors import (
    CollectionExistsError,
    CollectionNotFoundError,
    ConfigurationError,
    DataIntegrityError,
    ItemExistsError,
    ItemNotFoundError,
    SchemaError,
    SnapshotNotFoundError,
    StorageError,
    ValidationError,
)
from .evolution import EvolutionStrategy, Schema, SchemaEvolution, cast_to
from .filters import compile_filters, may_match, normal_form
from .frames import Frames, mapped
from .locks import ItemLock
from .merging import agreed_types, merged_tags
from .types import SEQ, check_columns, decode_frame, encode_frame, epoch_numbers

MANIFEST, SNAPSHOTS, RECORDS, LOCKS = "manifest.json", "_snapshots", "_commits", "_locks"
STRATEGIES = ("keep_last", "keep_first", "keep_all", "error")
CACHE_S = 300
#: Segments that no manifest names are left alone for so long: they may belong to a write that isn't published yet,
#: or to a reader that began before.
VACUUM_S = 86_400
#: Segments of an item from which on an append joins the small ones.
MOST_SEGMENTS = 32
_executor = concurrent.futures.ThreadPoolExecutor(8, thread_name_prefix="tidemark")
_locks: dict[str, ItemLock] = {}
_settings: dict = {"root": None, "session": None, "partition_bytes": 99_000_000}


# -- settings ---------------------------------------------------------------------------------------------------
def set_path(path: str | None = None) -> Path:
    """The folder of all stores: made if need be.  Without a path: $TIDEMARK_PATH, else ~/tidemark."""
    text = str(path or os.environ.get("TIDEMARK_PATH") or "~/tidemark")
    if "://" in text and not text.startswith("file://"):
        raise ValueError("a store only works with local file system paths")
    _settings["root"] = Path(text.removeprefix("file://")).expanduser().resolve()
    _settings["root"].mkdir(parents=True, exist_ok=True)
    return _settings["root"]


def get_path(*parts: str) -> Path:
    return (_settings["root"] or set_path()).joinpath(*parts)


def make_path(*parts) -> Path:
    return Path(*parts)


def path_exists(path) -> bool:
    return Path(path).exists()


def subdirs(path) -> list[str]:
    """The names of a folder's folders, those that the store keeps for itself left out."""
    return sorted(p.name for p in Path(path).iterdir() if p.is_dir() and not p.name.startswith((".", "_")))


def set_client(session: SparkSession | None) -> SparkSession | None:
    """The session that stores use; without one, the active one or a new one is."""
    _settings["session"] = session
    return session


def get_client() -> SparkSession:
    if _settings["session"] is None or _settings["session"].sparkContext._jsc is None:
        from ..session import session

        _settings["session"] = SparkSession.getActiveSession() or session()
    return _settings["session"]


def set_partition_size(size: int | None = None) -> int:
    """The bytes that a file of an item should have."""
    if size is not None and size <= 0:
        raise ConfigurationError("a partition size must be positive")
    _settings["partition_bytes"] = size or 99_000_000
    return _settings["partition_bytes"]


def get_partition_size() -> int:
    return _settings["partition_bytes"]


def list_stores() -> list[str]:
    root = get_path()
    return sorted(p.name for p in root.iterdir() if p.is_dir() and not p.name.startswith((".", "_"))) if root.exists() else []


def delete_store(name: str) -> bool:
    if name not in list_stores():
        raise ValueError(f"Store '{name}' does not exist")
    shutil.rmtree(get_path(name))
    return True


def delete_stores() -> bool:
    return all(delete_store(name) for name in list_stores())


# -- small files ------------------------------------------------------------------------------------------------
def _publish_json(path: Path, value: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    aside.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    os.replace(aside, path)


def _load_json(path: Path) -> dict | None:
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except FileNotFoundError:
        return None


#: The hidden column that names a row's segment and file, as "segment/file".
SEGMENT = "__segment"


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


@dataclass
class Input:
    """Data ready to be written: a Spark frame with keys first and SEQ last."""

    df: DataFrame
    keys: list[str]
    tags: dict
    unnamed: bool
    bytes: int
    rows: int | None = None
    tagged: bool = False
    #: A folder with the frame's rows, which goes once they're written.
    aside: Path | None = None


def _bounds(key, kind: T.DataType) -> list | None:
    """Aggregates for the bounds of a key: instants as microseconds since 1970, so that no time zone of the driver's
    or the session's comes in.  None for types without bounds."""
    if isinstance(kind, T.TimestampType):
        key = F.unix_micros(key)
    elif isinstance(kind, T.TimestampNTZType):
        key = ntz_us(key)
    elif not isinstance(kind, (T.IntegralType, T.StringType, T.FloatType, T.DoubleType)):
        return None
    return [F.min(key).alias("low"), F.max(key).alias("high"), F.count_if(key.isNull()).alias("unkeyed")]


def _bound(x, kind: T.DataType):
    return {"us": x, "zoned": isinstance(kind, T.TimestampType)} if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else x


def _meet(a: dict, b: dict) -> bool:
    """Whether the keys of two segments may meet."""
    plain = lambda x: x.get("us") if isinstance(x, dict) else x
    low, high, first, last = (plain(x) for x in (a["low"], a["high"], b["low"], b["high"]))
    if None in (low, high, first, last) or isinstance(low, str) != isinstance(first, str):
        return True
    return low <= last and first <= high


def _paths(segment: dict) -> list[str]:
    """What a segment is read from: its folder, or of its files those whose rows weren't all written anew since
    (``without``), or only some of them (``only``)."""
    if "only" in segment:
        return [f"{segment['path']}/{name}" for name in segment["only"]]
    if not segment.get("without"):
        return [segment["path"]]
    return sorted(str(p) for p in Path(segment["path"]).glob("*.parquet") if p.name not in segment["without"])


def _read_as(spark: SparkSession, manifest: dict, filters=None, columns: list[str] | None = None, source: bool = False) -> DataFrame:
    """All rows of a manifest's segments in its schema, with SEQ; segments that can't hold a wanted row are left out.

    Segments of one schema are one scan.  Filters are applied to the scans, so
    they and the column list reach Parquet.  With ``source``, the column
    SEGMENT names each row's segment and file.
    """
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    key = manifest["keys"][0] if manifest["keys"] else None
    groups: dict[str, list[str]] = {}
    for segment in manifest["segments"]:
        if key is None or may_match(filters, key, segment["low"], segment["high"]):
            groups.setdefault(segment["schema"], []).extend(_paths(segment))
    wanted = compile_filters(filters, schema.names)
    names = schema.names if columns is None else columns
    parts = []
    for text, paths in groups.items():
        own = T.StructType.fromJson(json.loads(text))
        part = spark.read.schema(T.StructType([*own.fields, T.StructField(SEQ, T.LongType())])).parquet(*paths)
        hidden = [SEQ, SEGMENT] if source else [SEQ]
        if source:
            part = part.withColumn(SEGMENT, F.regexp_extract("_metadata.file_path", r"/seg/([0-9a-f]+/[^/]*)$", 1))
        part = cast_to(part, own, schema, extra=hidden, fill=manifest.get("fill", False))
        part = part if wanted is None else part.where(wanted)
        parts.append(part.select(*(F.col(f"`{c}`") for c in names), *hidden))
    if not parts:
        fields = [schema[c] for c in names] + [T.StructField(SEQ, T.LongType())]
        return spark.createDataFrame([], T.StructType(fields))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


class Item:
    """A version of an item, read lazily: ``data`` is a Spark frame with the keys and the wanted columns."""

    def __init__(self, item: str, collection: Collection, snapshot: str | None = None, filters=None, columns: list[str] | None = None):
        self.item, self.collection, self.snapshot = item, collection, snapshot
        self._manifest = collection._manifest_of(item, snapshot)
        self._filters, self._columns = filters, columns
        self.keys = list(self._manifest["keys"])
        self.data  # noqa: B018 - unknown columns are reported here, not at the first action

    def __repr__(self) -> str:
        return f"Item({self.collection.collection}/{self.item}{f'@{self.snapshot}' if self.snapshot else ''})"

    @property
    def metadata(self) -> dict:
        return dict(self._manifest["meta"]) | {"_updated": self._manifest["updated"]}

    @property
    def path(self) -> list[str]:
        return [s["path"] for s in self._manifest["segments"]]

    def _names(self, columns: list[str] | None) -> list[str]:
        schema = T.StructType.fromJson(json.loads(self._manifest["schema"]))
        if columns is None:
            return schema.names
        unknown = [c for c in columns if c not in schema.names]
        if unknown:
            raise ValidationError(f"unknown columns: {unknown}")
        return self.keys + [c for c in columns if c not in self.keys]

    def _rows(self, columns=None, filters=None) -> DataFrame:
        both = [a + b for a in normal_form(self._filters) or [[]] for b in normal_form(filters) or [[]]]
        names = self._names(columns if columns is not None else self._columns)
        return _read_as(self.collection.spark, self._manifest, [x for x in both if x] or None, names)

    @property
    def data(self) -> DataFrame:
        return self._rows().drop(SEQ)

    def ordered(self, **kw) -> DataFrame:
        """The rows in the order of the contract: by key, rows of one key as they were written."""
        return self._rows(**kw).orderBy(*(F.col(f"`{k}`") for k in self.keys), SEQ).drop(SEQ)

    def _to_pandas(self, df: DataFrame, restore_tz: bool = False) -> pd.DataFrame:
        return decode_frame(df.toArrow(), self.keys, self._manifest["tags"], self._manifest["unnamed"], restore_tz)

    def to_pandas(self, columns: list[str] | None = None, filters=None, restore_tz: bool = False, parse_dates: bool = True) -> pd.DataFrame:
        """All rows in order, with the types that were written; ``parse_dates=False`` leaves epoch keys as numbers."""
        frame = self._to_pandas(self.ordered(columns=columns, filters=filters), restore_tz)
        return frame if parse_dates else epoch_numbers(frame)

    def map_pandas(self, make, schema: str | T.StructType, columns: list[str] | None = None, filters=None) -> DataFrame:
        """A Spark frame of what ``make`` gives for each batch of the rows, in tasks: none come to the driver.

        ``make`` is given a function with the options ``restore_tz`` and
        ``parse_dates`` of :meth:`to_pandas`, which gives the batch's rows
        with the types that were written, and returns a pandas frame with the
        columns of ``schema``.  Batches come in no order.
        """
        return mapped(self._rows(columns, filters).drop(SEQ), self._manifest, make, schema)

    def head(self, n: int = 5) -> pd.DataFrame:
        return self._to_pandas(self.ordered().limit(n))

    def tail(self, n: int = 5) -> pd.DataFrame:
        order = [F.col(f"`{k}`").desc_nulls_last() for k in self.keys] + [F.col(SEQ).desc()]
        last = self._rows().orderBy(*order).limit(n)
        return self._to_pandas(last.orderBy(*(F.col(f"`{k}`") for k in self.keys), SEQ).drop(SEQ))


class Collection:
    """A folder of items."""

    def __init__(self, collection: str, store: Store, spark: SparkSession | None = None):
        self.collection, self.datastore = collection, store.datastore
        self.root = Path(store.datastore) / collection
        self._spark = spark or store._spark
        self._validator, self._evolutions, self._cache = None, {}, {}
        self._recover()

    def __repr__(self) -> str:
        return f"Collection({self.collection})"

    @property
    def spark(self) -> SparkSession:
        return self._spark or get_client()

    # -- manifests
    def _path(self, item: str) -> Path:
        if not item or "/" in item or item in (".", "..") or item in (SNAPSHOTS, RECORDS, LOCKS):
            raise ValidationError(f"{item!r} can't name an item")
        return self.root / item

    def _lock(self, item: str) -> ItemLock:
        self._path(item)
        path = self.root / LOCKS / item
        return _locks.setdefault(str(path), ItemLock(path))

    def _load(self, item: str) -> dict | None:
        return _load_json(self._path(item) / MANIFEST)

    def _manifest_of(self, item: str, snapshot: str | None = None) -> dict:
        if snapshot is not None:
            saved = _load_json(self.root / SNAPSHOTS / f"{snapshot}.json")
            if saved is None:
                raise SnapshotNotFoundError(f"Snapshot '{snapshot}' doesn't exist")
            found = saved["items"].get(item)
        else:
            found = self._load(item)
        if found is None:
            raise ItemNotFoundError(f"Item '{item}' doesn't exist" + (f" in snapshot '{snapshot}'" if snapshot else ""))
        return found

    def _publish(self, changes: dict[str, dict | None]) -> None:
        """Make new manifests current (None deletes): one directly, several through a record that survives a crash.

        A manifest carries the token of the one that it was built on.  If
        that isn't the current one any more, somebody else's change would be
        lost, and a StorageError is raised.
        """
        locks = [self._lock(item) for item in sorted(changes)]
        for lock in locks:
            lock.acquire()
        try:
            bases = {item: (self._load(item) or {}).get("token") for item in changes}
            for item, manifest in changes.items():
                if manifest is not None and manifest.get("token") != bases[item]:
                    raise StorageError(f"Item '{item}' was changed by another process in the meantime")
            changes = {item: manifest and dict(manifest, token=uuid.uuid4().hex) for item, manifest in changes.items()}
            if len(changes) > 1:
                record = self.root / RECORDS / f"{uuid.uuid4().hex}.json"
                _publish_json(record, {"bases": bases, "changes": changes})
                self._apply(changes)
                record.unlink()
            else:
                self._apply(changes)
        finally:
            for lock in reversed(locks):
                lock.release()

    def _apply(self, changes: dict[str, dict | None]) -> None:
        for item, manifest in changes.items():
            self._cache.pop(item, None)
            if manifest is None:
                (self._path(item) / MANIFEST).unlink(missing_ok=True)
            else:
                _publish_json(self._path(item) / MANIFEST, manifest)

    def _recover(self) -> None:
        """Roll forward what a dead process left half published.  A record whose items are locked belongs to a living
        one; of the others, only manifests are put in place whose base is still the current one."""
        for record in sorted((self.root / RECORDS).glob("*.json")) if (self.root / RECORDS).exists() else []:
            saved = _load_json(record)
            if saved is None:
                continue
            locks, got = [self._lock(item) for item in sorted(saved["changes"])], []
            try:
                for lock in locks:
                    if not lock.acquire(blocking=False):
                        break
                    got.append(lock)
                if len(got) == len(locks) and record.exists():
                    self._apply({item: m for item, m in saved["changes"].items() if (self._load(item) or {}).get("token") == saved["bases"][item]})
                    record.unlink(missing_ok=True)
            finally:
                for lock in reversed(got):
                    lock.release()

    # -- catalog
    @property
    def items(self) -> set[str]:
        return self.list_items()

    @property
    def snapshots(self) -> set[str]:
        return self.list_snapshots()

    def list_items(self, **meta) -> set[str]:
        """The items' names; with ``meta``, of those whose metadata have all these values."""
        names = {p.parent.name for p in self.root.glob(f"*/{MANIFEST}")}
        if not meta:
            return names
        wanted = {k: v for k, v in meta.items() if k != "_updated"}
        return {n for n in names if all(self.get_item_metadata(n).get(k) == v for k, v in wanted.items())}

    def item(self, item: str, snapshot: str | None = None, filters=None, columns: list[str] | None = None) -> Item:
        return Item(item, self, snapshot, filters, columns)

    def get_item_metadata(self, item: str, use_cache: bool = True) -> dict:
        """The metadata of an item, empty if there's none; a cached copy counts while the manifest is unchanged."""
        try:
            stamp = (self._path(item) / MANIFEST).stat()
        except FileNotFoundError:
            self._cache.pop(item, None)
            return {}
        version, held = (stamp.st_mtime_ns, stamp.st_ino), self._cache.get(item)
        if not (use_cache and held and held[0] == version and time.time() - held[1] < CACHE_S):
            manifest = self._load(item) or {"meta": {}, "updated": None}
            held = self._cache[item] = (version, time.time(), dict(manifest["meta"]) | {"_updated": manifest["updated"]})
        return dict(held[2])

    read_metadata = get_item_metadata

    def write_metadata(self, item: str, metadata: dict) -> None:
        """Replace the metadata of an existing item; its rows stay as they are."""
        with self._lock(item):
            old = self._manifest_of(item)
            self._publish({item: dict(old, version=old["version"] + 1, meta={k: v for k, v in metadata.items() if k != "_updated"}, updated=_now())})

    def clear_metadata_cache(self, item: str | None = None) -> None:
        self._cache.pop(item, None) if item else self._cache.clear()

    def get_item_path(self, item: str) -> list[str]:
        return self.item(item).path

    def index(self, item: str, last: bool = False):
        """An item's keys in order as a Spark frame; with ``last``, the greatest first key."""
        it = self.item(item)
        if not it.keys:
            raise ValidationError("the item has no keys")
        if last:
            return it.data.agg(F.max(F.col(f"`{it.keys[0]}`")).alias("last")).first()["last"]
        return it.ordered(columns=[])

    def delete_item(self, item: str, reload_items: bool = False) -> bool:
        self._manifest_of(item)
        self._publish({item: None})
        return True

    def vacuum(self, older_than_s: float = VACUUM_S) -> int:
        """Delete the segments that neither an item nor a snapshot names and that were made so long ago; the number
        of them."""
        named = {s["path"] for n in self.list_items() for s in self._manifest_of(n)["segments"]}
        for snapshot in self.list_snapshots():
            named |= {s["path"] for m in _load_json(self.root / SNAPSHOTS / f"{snapshot}.json")["items"].values() for s in m["segments"]}
        until = time.time() - older_than_s
        gone = [p for p in self.root.glob("*/seg/*") if str(p) not in named and p.stat().st_mtime <= until]
        for p in gone:
            shutil.rmtree(p)
        return len(gone)

    # -- input
    def _input(self, item: str, data, index: list[str] | None, epochdate: bool) -> Input:
        spark = self.spark
        if isinstance(data, Frames):
            # encoded once, though ranges are sampled first; if the process dies, it's a segment that no manifest names
            aside = self._path(item) / "seg" / uuid.uuid4().hex
            try:
                schema, keys, tags, unnamed = (data if not index else Frames(data.df, _indexed(data.make, index))).written(str(aside), epochdate)
            except Exception:
                shutil.rmtree(aside, ignore_errors=True)
                raise
            held = spark.read.schema(T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])).parquet(str(aside))
            return Input(held, keys, tags, unnamed, layout.folder_bytes(str(aside)), None, True, aside)
        if isinstance(data, Item):
            keys = index or data.keys
            df = data._rows()
            return Input(self._keys_first(df, keys), keys, data._manifest["tags"], data._manifest["unnamed"], layout.plan_bytes(df))
        if isinstance(data, pa.Table):
            data = spark.createDataFrame(data)
        if isinstance(data, DataFrame):
            keys = [index] if isinstance(index, str) else list(index or [])
            missing = [k for k in keys if k not in data.columns]
            if missing:
                raise ValidationError(f"unknown key columns: {missing}")
            if not data.columns:
                raise ValidationError("A frame without columns can't be stored")
            check_columns(data.columns, len(keys))
            # NaN and null are one no-value in a store
            floats = {f.name for f in data.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
            plain = data.select(*(F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in data.columns))
            return Input(self._keys_first(plain.withColumn(SEQ, F.monotonically_increasing_id()), keys), keys, {}, False, layout.plan_bytes(data))
        if isinstance(data, pd.Series):
            data = data.to_frame()
        if not isinstance(data, pd.DataFrame):
            raise ValidationError(f"{type(data).__name__} can't be stored")
        frame = data.set_index(index) if index else data
        made = encode_frame(frame, epochdate)
        table = made.table.append_column(SEQ, pa.array(range(made.table.num_rows), pa.int64()))
        df = spark.createDataFrame(table, T.StructType([*made.schema.fields, T.StructField(SEQ, T.LongType())]))
        return Input(df, made.keys, made.tags, made.unnamed, made.table.nbytes, made.table.num_rows, True)

    @staticmethod
    def _keys_first(df: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in keys and c != SEQ]
        return df.select(*(F.col(f"`{c}`") for c in [*keys, *rest]), SEQ)

    def _segment(self, item: str, made: Input, npartitions: int | None, base: int = 0) -> dict | None:
        """Write rows as a new segment, in ranges of the key, sorted; None if there are no rows."""
        schema = T.StructType([f for f in made.df.schema.fields if f.name != SEQ])
        path = self._path(item) / "seg" / uuid.uuid4().hex
        keys = [F.col(f"`{k}`") for k in made.keys]
        # the optimizer's estimate of a plan is no measure: without a number, ranges are coalesced by their true sizes
        n = npartitions or (layout.files_for(made.bytes, get_partition_size()) if made.rows is not None else None)
        df = made.df.withColumn(SEQ, F.col(SEQ) + base)
        seen = Observation()
        stats = [F.count(F.lit(1)).alias("rows"), F.max(SEQ).alias("top")]
        kind = schema[made.keys[0]].dataType if made.keys else None
        bounds = _bounds(keys[0], kind) if made.keys else None
        stats += bounds or []
        df = df.observe(seen, *stats)
        if n == 1:
            df = df.coalesce(1).sortWithinPartitions(*keys, SEQ)
        else:
            df = df.repartitionByRange(*([n] if n else []), *keys, SEQ).sortWithinPartitions(*keys, SEQ)
        try:
            df.write.option("compression", "snappy").parquet(str(path))
        except Exception as e:
            shutil.rmtree(path, ignore_errors=True)
            raise StorageError(f"Item '{item}' could not be written: {e}") from e
        try:
            got = seen.get
        except Exception:
            # where a shuffle turns out to be empty, the rest of the plan is dropped, and what was observed with it
            got = self.spark.read.schema(df.schema).parquet(str(path)).agg(*stats).first().asDict()
        if not got["rows"]:
            return {"path": str(path), "rows": 0, "schema": schema.json(), "low": None, "high": None, "top": base - 1}
        prune = bounds and not got["unkeyed"]
        return {"path": str(path), "rows": got["rows"], "schema": schema.json(), "low": _bound(got["low"], kind) if prune else None, "high": _bound(got["high"], kind) if prune else None, "top": got["top"]}

    def _validate(self, made: Input) -> None:
        if self._validator is not None:
            self._validator.validate(made.df.drop(SEQ), keys=made.keys, order=made.df)

    # -- writing
    def set_validator(self, validator) -> None:
        self._validator = validator

    def get_validator(self):
        return self._validator

    def _built(self, item: str, data, metadata: dict | None, npartitions: int | None, epochdate: bool, index, validate: bool, old: dict | None = None) -> dict:
        made = self._input(item, data, index, epochdate)
        if validate:
            self._validate(made)
        strategy = None
        if npartitions is None:
            npartitions, strategy = layout.choose(made, get_partition_size())
        segment = self._segment(item, made, npartitions)
        if made.aside:
            shutil.rmtree(made.aside, ignore_errors=True)
        schema = T.StructType([f for f in made.df.schema.fields if f.name != SEQ])
        return {
            "token": (old or {}).get("token"),
            "version": (old or {}).get("version", 0) + 1,
            "keys": made.keys,
            "unnamed": made.unnamed,
            "tags": made.tags,
            "schema": schema.json(),
            "schema_version": 1,
            "segments": [segment],
            "meta": dict(metadata or {}),
            "system": {"_partitions": npartitions, "_partition_strategy": strategy} | ({"_schema_evolution": self._evolutions[item].to_dict()} if item in self._evolutions else {}),
            "updated": _now(),
        }

    def write(self, item: str, data, metadata: dict | None = None, npartitions: int | None = None, overwrite: bool = False, epochdate: bool = False, reload_items: bool = False, index=None, validate: bool = True) -> None:
        """Create an item, or with ``overwrite`` replace its rows and metadata.

        ``data``: a pandas frame or series (its index becomes the keys), the
        Frames that tasks make (so do theirs), a Spark frame or Arrow table
        (``index`` names the keys) or an Item.  All
        rows are kept, also those of one key.
        """
        with self._lock(item):
            old = self._load(item)
            if old is not None and not overwrite:
                raise ItemExistsError(f"There's an item '{item}' already; overwrite=True replaces it")
            self._publish({item: self._built(item, data, metadata, npartitions, epochdate, index, validate, old)})

    def write_threaded(self, *args, **kw) -> concurrent.futures.Future:
        return _executor.submit(self.write, *args, **kw)

    def write_batch(self, items_data: dict, metadata: dict | None = None, npartitions: int | None = None, overwrite: bool = False, epochdate: bool = False, parallel: bool = True) -> None:
        """Write many items; all are tried, and a StorageError names those that failed.

        ``metadata`` holds for all, or has a dictionary for each item's name.
        """
        own = bool(metadata) and all(isinstance(v, dict) and k in items_data for k, v in metadata.items())
        meta = lambda name: (metadata or {}).get(name, {}) if own else metadata
        one = lambda name, data: self.write(name, data, meta(name), npartitions, overwrite, epochdate)
        failed = {}
        jobs = {name: (_executor.submit(one, name, data) if parallel else (lambda n=name, d=data: one(n, d))) for name, data in items_data.items()}
        for name, job in jobs.items():
            try:
                job.result() if parallel else job()
            except Exception as e:
                failed[name] = e
        if failed:
            raise StorageError(f"{len(failed)} of {len(items_data)} items failed: " + "; ".join(f"{k}: {v}" for k, v in failed.items()))

    def read_batch(self, items: list[str], columns: list[str] | None = None, filters=None) -> dict:
        """Name -> pandas frame, read concurrently; None for what can't be read."""

        def one(name: str):
            try:
                return self.item(name, filters=filters, columns=columns).to_pandas()
            except Exception:
                return None

        return dict(zip(items, _executor.map(one, items)))

    def read_batch_union(self, items: list[str], columns: list[str] | None = None, filters=None) -> DataFrame:
        """The rows of several items as one Spark frame, with the column ``item``.

        Items that are alike (schema, segments of one schema) are one scan, in
        which a row's item is told from its file; so the plan grows with the
        number of schemas, not of items.
        """
        groups: dict[str, list[Item]] = {}
        for it in dict.fromkeys(items):
            it = self.item(it, filters=filters, columns=columns)
            m = it._manifest
            alike = json.dumps([m["schema"], m["keys"], m.get("fill", False), sorted({x["schema"] for x in m["segments"]})])
            groups.setdefault(alike, []).append(it)
        merged = None
        for own in groups.values():
            first = own[0]
            segments = [(x, it.item) for it in own for x in it._manifest["segments"]]
            rows = _read_as(self.spark, dict(first._manifest, segments=[x for x, _ in segments]), normal_form(filters) or None, first._names(columns), source=True)
            names = self.spark.createDataFrame([(Path(x["path"]).name, name) for x, name in segments], f"`{SEGMENT}` string, item string")
            part = rows.withColumn(SEGMENT, F.substring_index(SEGMENT, "/", 1)).join(F.broadcast(names), SEGMENT).drop(SEQ, SEGMENT)
            merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
        return merged

    # -- appending
    def append(self, item: str, data, npartitions: int | None = None, epochdate: bool = False, threaded: bool = False, reload_items: bool = False, duplicate_handling: str = "keep_last", validate_schema: bool | None = None, index=None, validate: bool = True) -> None:
        """Add rows to an item.

        What happens to a key that the item has: ``keep_last`` replaces its
        rows, ``keep_first`` leaves the new ones out, ``keep_all`` keeps all,
        ``error`` raises.  Under the first two also the new rows are reduced
        to one for each key.  Null keys equal each other; items without keys
        keep all.  Only files that hold such keys are written anew.
        """
        if threaded:
            _executor.submit(self.append, item, data, npartitions, epochdate, False, reload_items, duplicate_handling, validate_schema, index, validate).result()
            return
        with self._lock(item):
            new = self._appended(item, self._manifest_of(item), data, npartitions, epochdate, duplicate_handling, validate_schema, index, validate)
            if new is not None:
                self._publish({item: new})

    def _appended(self, item, old: dict, data, npartitions, epochdate, duplicate_handling, validate_schema, index, validate) -> dict | None:
        if duplicate_handling not in STRATEGIES:
            raise ValueError(f"duplicate_handling must be one of {STRATEGIES}")
        epochdate = epochdate or any((old["tags"].get(k) or {}).get("kind") == "instant_ns" for k in old["keys"])
        made = self._input(item, data, index or (old["keys"] if isinstance(data, (DataFrame, pa.Table)) else None), epochdate)
        if made.rows == 0:
            return None
        if made.keys != old["keys"]:
            raise ValidationError(f"keys {made.keys} don't match the item's keys {old['keys']}")
        if validate:
            self._validate(made)
        schema, made, tags, nulled = self._agreed(item, old, made, validate_schema)
        keys, spark = old["keys"], self.spark
        segments, base = list(old["segments"]), max([s["top"] for s in old["segments"]], default=-1) + 1
        if keys and duplicate_handling in ("keep_first", "keep_last"):
            made.df = _one_per_key(made.df, keys, last=duplicate_handling == "keep_last")
        # under evolution, columns that older rows lack get the default of their type
        fill = old.get("fill", False) or self.get_item_evolution(item) is not None
        current = dict(old, schema=schema.json(), fill=fill)
        # the new rows are computed once, here; what they meet is looked for with what has been written
        segment = self._segment(item, made, npartitions, base)
        if made.aside:
            shutil.rmtree(made.aside, ignore_errors=True)
        if not segment["rows"]:
            shutil.rmtree(segment["path"], ignore_errors=True)
            return None
        touched = [s for s in segments if s["rows"] and _meet(s, segment)] if keys and duplicate_handling != "keep_all" else []
        if touched:
            delta = _read_as(spark, dict(current, segments=[segment]))
            new_keys = delta.select(*(F.col(f"`{k}`") for k in keys))
            held = same(_read_as(spark, dict(current, segments=touched), None, keys, source=True).drop(SEQ), new_keys, keys, "left_semi")
            if duplicate_handling == "error" and not held.isEmpty():
                shutil.rmtree(segment["path"], ignore_errors=True)
                raise DataIntegrityError("duplicate indices: the item already has some of the new keys")
            if duplicate_handling == "keep_first":
                left = self._segment(item, Input(same(delta, held.drop(SEGMENT), keys, "left_anti"), keys, {}, False, made.bytes, made.rows), npartitions)
                shutil.rmtree(segment["path"], ignore_errors=True)
                if not left["rows"]:
                    shutil.rmtree(left["path"], ignore_errors=True)
                    return None
                segment = left
            if duplicate_handling == "keep_last":
                # no more names than there are files
                hit = [r[0] for r in held.select(SEGMENT).distinct().collect()]
                segments = self._without(item, current, hit, new_keys)
        segments = self._joined(item, current, [*segments, segment])
        system = dict(old["system"], _failed_casts={c: old["system"].get("_failed_casts", {}).get(c, 0) + n for c, n in nulled.items()}) if nulled else old["system"]
        return dict(old, version=old["version"] + 1, schema=schema.json(), tags=tags, segments=segments, fill=fill, system=system, updated=_now())

    def _agreed(self, item: str, old: dict, made: Input, validate_schema: bool | None) -> tuple[T.StructType, Input, dict, dict[str, int]]:
        """The schema that the item has from now on, the new rows in it, its tags, and what new values become null."""
        have, new = T.StructType.fromJson(json.loads(old["schema"])), T.StructType([f for f in made.df.schema.fields if f.name != SEQ])
        evolution = self.get_item_evolution(item)
        if evolution is not None:
            if not evolution.validate_evolution(Schema.of(have, old["keys"]), Schema.of(new, old["keys"])):
                raise SchemaError(f"the change of schema isn't allowed under {evolution.strategy.name}")
        elif set(have.names) != set(new.names):
            if validate_schema is not False:
                lacking, extra = sorted(set(have.names) - set(new.names)), sorted(set(new.names) - set(have.names))
                raise ValidationError(f"Schema mismatch detected: missing columns {lacking}, extra columns {extra}")
        target, nulled = agreed_types(have, new, _read_as(self.spark, old), made.df, evolution)
        tags = merged_tags(old["tags"], made.tags, have, new, target, made.tagged)
        df = cast_to(made.df, new, target, extra=[SEQ], fill=evolution is not None)
        return target, Input(df, made.keys, made.tags, made.unnamed, made.bytes, made.rows, made.tagged, made.aside), tags, nulled

    def _without(self, item: str, manifest: dict, hit: list[str], new_keys: DataFrame) -> list[dict]:
        """The segments without the rows of the new keys: the files that have some (``segment/file``) are written
        anew as one segment, in one job; the others stay as they are."""
        if not hit:
            return list(manifest["segments"])
        by_segment: dict[str, list[str]] = {}
        for name in hit:
            segment, _, file = name.partition("/")
            by_segment.setdefault(segment, []).append(file)
        old = [dict(s, only=by_segment[Path(s["path"]).name]) for s in manifest["segments"] if Path(s["path"]).name in by_segment]
        size = sum(Path(p).stat().st_size for s in old for p in _paths(s))
        left = same(_read_as(self.spark, dict(manifest, segments=old)), new_keys, manifest["keys"], "left_anti")
        made = self._segment(item, Input(left, manifest["keys"], {}, False, size), None)
        kept = []
        for s in manifest["segments"]:
            if (files := by_segment.get(Path(s["path"]).name)) is not None:
                s = dict(s, without=sorted({*s.get("without", ()), *files}))
            if not s.get("without") or _paths(s):
                kept.append(s)
        return [*kept, made] if made["rows"] else kept

    def _joined(self, item: str, manifest: dict, segments: list[dict]) -> list[dict]:
        """Segments, of which the small ones (under a file's size) are joined to one if there are many."""
        if len(segments) <= MOST_SEGMENTS:
            return segments
        sizes = [layout.folder_bytes(s["path"]) for s in segments]
        small = [k for k, n in enumerate(sizes) if n < get_partition_size()]
        if len(small) <= MOST_SEGMENTS // 2:
            return segments
        rows = _read_as(self.spark, dict(manifest, segments=[segments[k] for k in small]))
        made = self._segment(item, Input(rows, manifest["keys"], {}, False, sum(sizes[k] for k in small)), None)
        return [s for k, s in enumerate(segments) if k not in small] + [made]

    def append_stream(self, item: str, data_iterator, chunk_size: int = 10_000, epochdate: bool = False, duplicate_handling: str = "keep_last", validate_schema: bool = True, reload_items: bool = True) -> int:
        """Append the frames of an iterator, gathered up to about ``chunk_size`` rows at a time; returns the rows taken.

        Empty frames are passed over; what isn't a frame raises a
        ValidationError.  The schema is checked on the first frame.
        """
        held, size, total, first = [], 0, 0, True

        def flush() -> None:
            nonlocal held, size, first
            if held:
                indexed = not (isinstance(held[0].index, pd.RangeIndex) and held[0].index.name is None)
                frame = held[0] if len(held) == 1 else pd.concat(held, ignore_index=not indexed)
                self.append(item, frame, epochdate=epochdate, duplicate_handling=duplicate_handling, validate_schema=validate_schema if first else False)
                held, size, first = [], 0, False

        self._manifest_of(item)
        for chunk in data_iterator:
            if isinstance(chunk, DataFrame):
                flush()
                self.append(item, chunk, duplicate_handling=duplicate_handling, validate_schema=validate_schema if first else False)
                first = False
                continue
            if not isinstance(chunk, pd.DataFrame):
                raise ValidationError(f"a stream must give frames, not {type(chunk).__name__}")
            if not len(chunk):
                continue
            held.append(chunk)
            size, total = size + len(chunk), total + len(chunk)
            if size >= chunk_size:
                flush()
        flush()
        return total

    # -- snapshots
    def create_snapshot(self, snapshot: str | None = None) -> bool:
        """Pin the present versions of all items under a name (reduced to letters, digits, dots and underscores)."""
        name = "".join(c for c in snapshot if c.isalnum() or c in "._") if snapshot else str(int(time.time() * 1_000_000))
        if not name.strip("."):
            raise ValidationError(f"{snapshot!r} can't name a snapshot")
        _publish_json(self.root / SNAPSHOTS / f"{name}.json", {"taken": _now(), "items": {n: self._manifest_of(n) for n in self.list_items()}})
        return True

    def list_snapshots(self) -> set[str]:
        return {p.name[:-5] for p in (self.root / SNAPSHOTS).glob("*.json") if not p.name.startswith(".")}

    def delete_snapshot(self, snapshot: str) -> bool:
        (self.root / SNAPSHOTS / f"{snapshot}.json").unlink(missing_ok=True)
        return True

    def delete_snapshots(self) -> bool:
        return all(self.delete_snapshot(n) for n in self.list_snapshots())

    # -- schema evolution
    def enable_schema_evolution(self, item: str, strategy: EvolutionStrategy = EvolutionStrategy.COMPATIBLE) -> SchemaEvolution:
        evolution = self._evolutions[item] = SchemaEvolution(strategy)
        manifest = self._load(item)
        if manifest is not None:
            evolution.register_schema(T.StructType.fromJson(json.loads(manifest["schema"])), manifest["keys"])
            system = dict(manifest["system"], _schema_evolution=evolution.to_dict())
            self._publish({item: dict(manifest, system=system)})
        return evolution

    def get_item_evolution(self, item: str) -> SchemaEvolution | None:
        if item not in self._evolutions:
            saved = ((self._load(item) or {}).get("system") or {}).get("_schema_evolution")
            if saved:
                self._evolutions[item] = SchemaEvolution.from_dict(saved)
        return self._evolutions.get(item)

    def migrate_item_to_version(self, item: str, to_version: int) -> None:
        """Rewrite an item by the registered migrations from its present schema version."""
        evolution = self.get_item_evolution(item)
        if evolution is None:
            raise SchemaError(f"schema evolution isn't enabled for '{item}'")
        with self._lock(item):
            old = self._manifest_of(item)
            df = evolution.migrate(_read_as(self.spark, old), old["schema_version"], to_version, hidden=[SEQ])
            keys = [k for k in old["keys"] if k in df.columns]
            made = Input(self._keys_first(df, keys), keys, {k: v for k, v in old["tags"].items() if k in df.columns}, old["unnamed"], layout.plan_bytes(df))
            segment = self._segment(item, made, None)
            self._publish({item: dict(old, version=old["version"] + 1, schema=segment["schema"], schema_version=to_version, keys=keys, tags=made.tags, segments=[segment], updated=_now())})


def _indexed(make, index):
    return lambda frame: make(frame).set_index(index)


def _one_per_key(df: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """The first or last row of each key, in the order of SEQ; partly done before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(F.col(f"`{c}`") for c in rest))
    pick = (F.max_by if last else F.min_by)(row, F.col(SEQ))
    picked = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(pick.alias("~row"))
    return picked.select(*(F.col(f"`{k}`") for k in keys), *(F.col("`~row`")[c].alias(c) for c in rest))


class Store:
    """A folder of collections."""

    def __init__(self, name: str, spark: SparkSession | None = None):
        if not name or "/" in name or name.startswith("."):
            raise ValidationError(f"{name!r} can't name a store")
        self._spark = spark
        path = get_path(name)
        path.mkdir(parents=True, exist_ok=True)
        self.datastore, self.name = str(path), name
        if not (path / "store.json").exists():
            _publish_json(path / "store.json", {"engine": "spark"})

    def __repr__(self) -> str:
        return f"Store({self.datastore})"

    @property
    def collections(self) -> list[str]:
        return self.list_collections()

    def list_collections(self) -> list[str]:
        return sorted(p.name for p in Path(self.datastore).iterdir() if p.is_dir() and (p / SNAPSHOTS).exists())

    def create_collection(self, name: str, overwrite: bool = False) -> Collection:
        path = Path(self.datastore) / name
        if (path / SNAPSHOTS).exists():
            if not overwrite:
                raise CollectionExistsError(f"Collection '{name}' already exists")
            shutil.rmtree(path)
        (path / SNAPSHOTS).mkdir(parents=True)
        return Collection(name, self)

    def collection(self, name: str, overwrite: bool = False) -> Collection:
        """Get a collection, or create it; with ``overwrite`` it's emptied."""
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValidationError(f"{name!r} can't name a collection")
        if overwrite or name not in self.list_collections():
            return self.create_collection(name, overwrite)
        return Collection(name, self)

    def delete_collection(self, name: str) -> bool:
        if name not in self.list_collections():
            raise CollectionNotFoundError(f"Collection '{name}' doesn't exist")
        shutil.rmtree(Path(self.datastore) / name)
        return True

    def item(self, collection: str, item: str) -> Item:
        if collection not in self.list_collections():
            raise CollectionNotFoundError(f"Collection '{collection}' doesn't exist")
        return Collection(collection, self).item(item)


def store(name: str, spark: SparkSession | None = None) -> Store:
    """Connect to a store, or create it."""
    return Store(name, spark)
