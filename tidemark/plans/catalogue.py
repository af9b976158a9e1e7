"""All queries of the engine's own operators, and the same in SQL.

Each query of the store writes its table into an item of a store of its own
and reads it back through the operator that it's named after.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import same
from ..functions.keys import align_timezones, deduplicate
from ..shared import shared_dir
from ..store import catalog, errors, evolution, layout, memory
from ..store.frames import Frames
from ..store.types import SEQ
from ..store.validation import DataValidator, NoNullRule, RangeRule, SortedKeyRule, UniqueRule, create_financial_validator
from . import problems

CLICKS = [("event_type", "==", "click"), ("value", ">", 100.0)]
EITHER = [[("event_type", "in", ["click", "view"]), ("value", ">", 100.0)], [("event_type", "not in", ["click", "view", "purchase"]), ("value", "<=", 10.0)]]


def _collection(spark: SparkSession) -> catalog.Collection:
    """A collection of a store of its own in the folder that all executors share."""
    catalog.set_path(f"{shared_dir(spark)}/stores".replace("file:", "", 1) if shared_dir(spark).startswith("file:") else f"{shared_dir(spark)}/stores")
    return catalog.store(f"s{uuid.uuid4().hex}", spark).collection("data")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _held(spark: SparkSession, d: str, name: str, index: list[str], **kw) -> catalog.Collection:
    c = _collection(spark)
    c.write("item", _table(spark, d, name), index=index, **kw)
    return c


def flagship(spark: SparkSession, d: str) -> DataFrame:
    clicks = _held(spark, d, "events", ["ts"]).item("item", filters=CLICKS, columns=["ts", "event_type", "value"]).data
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return clicks.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.max("value").alias("most"))


# -- scans and writes
def _read(name: str, index: list[str], **kw) -> Callable:
    return lambda spark, d: _held(spark, d, name, index).item("item", **kw).data


def _ends(first: bool) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        it = _held(spark, d, "events", ["ts"]).item("item")
        rows = it.head(10) if first else it.tail(10)
        return spark.createDataFrame(rows.reset_index()[it.data.columns], it.data.schema)

    return run


def index_last(spark, d):
    last = _held(spark, d, "events", ["ts"]).index("item", last=True)
    return spark.createDataFrame([(last,)], "last_ts timestamp_ntz")


def chunk_rows(spark, d):
    c = _held(spark, d, "events", ["ts"])
    sizes = [(k, len(x)) for k, x in enumerate(memory.read_in_chunks(c, "item", 1000, columns=["ts"]))]
    return spark.createDataFrame(sizes, "chunk bigint, n bigint")


def scan_filter_zoned(spark, d):
    """Instants as keys: the manifest's bounds and the filter must mean the same in every time zone."""
    t = _table(spark, d, "events").withColumn("at", F.timestamp_micros(_us("ts"))).select("at", "event_id")
    c, middle = _collection(spark), pd.Timestamp("2024-01-02 02:00", tz="UTC")
    for k, part in enumerate((t.where(F.col("at") < F.lit(middle)), t.where(F.col("at") >= F.lit(middle)))):
        (c.append if k else c.write)("item", part, index=["at"])
    return c.item("item", filters=[("at", ">=", middle)]).data.select("event_id")


def _us(column: str) -> Column:
    from ..functions.normal import ntz_us

    return ntz_us(F.col(column))


# -- appends: old and new rows overlap in a tenth of the keys
def _old_new(spark, d, name: str, by: str, changed: Column, column: str) -> tuple[DataFrame, DataFrame]:
    t = _table(spark, d, name)
    return t.where(F.col(by) % 10 < 6), t.where(F.col(by) % 10 >= 5).withColumn(column, changed)


def _append(how: str) -> Callable:
    def run(spark, d):
        old, new = _old_new(spark, d, "events", "event_id", F.col("value") * 10, "value")
        c = _collection(spark)
        c.write("item", old, index=["ts"])
        c.append("item", new, duplicate_handling=how)
        return c.item("item").data

    return run


def append_multikey(spark, d):
    old, new = _old_new(spark, d, "orders", "o_orderkey", F.col("o_totalprice") * 10, "o_totalprice")
    c = _collection(spark)
    c.write("item", old, index=["o_custkey", "o_orderkey"])
    c.append("item", new, duplicate_handling="keep_last")
    return c.item("item").data


def append_widen(spark, d):
    """Integers, then fractions: the column is double from then on, and no value is cut off."""
    t, c = _table(spark, d, "events"), _collection(spark)
    c.write("item", t.where("event_id % 2 = 0").select("event_id", F.col("user_id").alias("v")), index=["event_id"])
    c.append("item", t.where("event_id % 2 = 1").select("event_id", F.col("value").alias("v")))
    return c.item("item").data


def append_type_error(spark, d):
    """Texts can't become integers: the append is refused, and the item stays as it was."""
    t, c, refused = _table(spark, d, "events"), _collection(spark), 0
    c.write("item", t.select("event_id", F.col("user_id").alias("v")), index=["event_id"])
    try:
        c.append("item", t.select((F.col("event_id") + 1_000_000).alias("event_id"), F.col("event_type").alias("v")))
    except errors.ValidationError:
        refused = 1
    return c.item("item").data.agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


def dup_keys(spark, d):
    old, new = _old_new(spark, d, "events", "event_id", F.col("value") * 10, "value")
    return same(old.select("ts"), new.select("ts"), ["ts"], "left_semi").agg(F.count("*").alias("n"))


def _dedup(keep: str) -> Callable:
    def run(spark, d):
        t = _held(spark, d, "events", ["user_id", "ts"]).item("item").data
        return deduplicate(t, ["user_id"], ["ts", "event_id"], keep)

    return run


def distinct_rows(spark, d):
    return _held(spark, d, "events", ["ts"]).item("item", columns=["event_type", "user_id"]).data.select("event_type", "user_id").dropDuplicates()


def read_batch_union(spark, d):
    t = _table(spark, d, "events")
    c = _collection(spark)
    c.write_batch({"clicks": t.where("event_type = 'click'"), "views": t.where("event_type = 'view'")})
    return c.read_batch_union(["clicks", "views"], columns=["event_id", "value"])


def stream_append(spark, d):
    from ..streaming.ingest import append_stream

    source, c = _table(spark, d, "events"), _collection(spark)
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events*").parquet(d)
    append_stream(stream, c, "item", ["ts"], f"{c.root}/_streams/{uuid.uuid4().hex}").awaitTermination()
    return c.item("item").data


def stream_windows(spark, d):
    """Event-time windows of a day over the stream; all of it is read, then the state is complete."""
    from ..streaming.ingest import windowed_counts

    source, name = _table(spark, d, "events"), f"w{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events*").parquet(d)
    counts = windowed_counts(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", "1 day", keys=["event_type"])
    flat = counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    flat.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# -- versions and layout
def snapshot_read(spark, d):
    c = _held(spark, d, "events", ["ts"])
    c.create_snapshot("before")
    c.write("item", _table(spark, d, "events").where("value > 100"), index=["ts"], overwrite=True)
    return c.item("item", snapshot="before").data


def rebalance_same_rows(spark, d):
    c = _held(spark, d, "events", ["ts"], npartitions=16)
    layout.rebalance_partitions(c, "item", target_size_mb=1)
    return c.item("item").data


def transaction_rows(spark, d):
    from ..store.transactions import batch_transaction

    c, t = _collection(spark), _table(spark, d, "events")
    c.write("gone", t, index=["ts"])
    with batch_transaction(c) as txn:
        txn.append("item", t.where("event_id % 2 = 1"))
        txn.write("item", t.where("event_id % 2 = 0"), index=["ts"])
        txn.delete("gone")
    return c.item("item").data.select("event_id", "ts", "value").withColumn("items", F.lit(len(c.list_items())))


def _bucket(unit: str) -> Callable:
    def run(spark, d):
        t = _held(spark, d, "events", ["ts"]).item("item", columns=["ts"]).data
        return t.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))

    return run


def span_days(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item", columns=["ts"]).data
    return t.agg(F.datediff(F.max("ts"), F.min("ts")).cast("bigint").alias("days"))


# -- types
def tz_to_utc(spark, d):
    """Zone-less local times beside zoned ones: both in one zone, then kept as instants, which come out in UTC."""
    t = _table(spark, d, "events").select("event_id", F.col("ts").alias("utc"))
    zoned = spark.createDataFrame([], "event_id bigint, utc timestamp")
    local, _ = align_timezones(t, zoned, "US/Eastern")
    c = _collection(spark)
    c.write("item", local, index=["event_id"])
    us = F.unix_micros("utc").cast("decimal(20,0)")
    return c.item("item").data.select("event_id", (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(us / 1_000_000).cast("decimal(18,6)"))).alias("utc"))


def _rich(t: pd.DataFrame) -> pd.DataFrame:
    """Events with types that Spark lacks."""
    t = t.set_index("event_id")
    return pd.DataFrame({
        "month": t["ts"].dt.to_period("M"),
        "lasted": pd.to_timedelta(t["value"].round(2) * 1000, unit="ms").dt.round("ms"),
        "kind": pd.Categorical(t["event_type"]),
        "bin": pd.arrays.IntervalArray.from_arrays((t["value"] // 10 * 10).astype("int64"), (t["value"] // 10 * 10 + 10).astype("int64"), closed="left"),
        "local": t["ts"].dt.tz_localize("UTC").dt.tz_convert("US/Eastern"),
        "tags": [{"props": x} for x in t["props"]],
    }, index=t.index)


def _typed(spark, d) -> catalog.Item:
    """The events as pandas frames with types that Spark lacks, made in tasks, written, appended to, and read with their tags."""
    t = _table(spark, d, "events").select("event_id", "ts", "event_type", "value", "props")
    low, high = t.agg(F.min("event_id"), F.max("event_id")).first()
    key, middle = F.col("event_id"), F.lit(None if low is None else (low + high + 1) // 2)
    c = _collection(spark)
    c.write("item", Frames(t.where(key < middle), _rich))
    c.append("item", Frames(t.where((key >= middle) | key.isNull()), _rich))
    return c.item("item")


def _flat(read: Callable[..., pd.DataFrame]) -> pd.DataFrame:
    got = read()
    kinds = [isinstance(got["month"].dtype, pd.PeriodDtype), got["lasted"].dtype.kind == "m", isinstance(got["kind"].dtype, pd.CategoricalDtype), isinstance(got["bin"].dtype, pd.IntervalDtype), str(got["local"].dt.tz) == "US/Eastern"]
    codes, months = pd.factorize(got["month"])
    return pd.DataFrame({
        "event_id": got.index, "month": pd.Series(months.strftime("%Y-%m"), dtype=object).reindex(codes).to_numpy(), "ms": (got["lasted"] / pd.Timedelta("1ms")).round().astype("int64").to_numpy(), "kind": got["kind"].astype(object).to_numpy(),
        "lo": got["bin"].array.left, "hi": got["bin"].array.right, "hour": got["local"].dt.hour.astype("int64").to_numpy(), "props": [x["props"] for x in got["tags"]], "restored": sum(map(bool, kinds)),
    })


def typed_columns(spark, d):
    """Periods, durations, intervals, zoned instants and nested objects, as they come out again."""
    return _typed(spark, d).map_pandas(_flat, "event_id bigint, month string, ms bigint, kind string, lo bigint, hi bigint, hour bigint, props string, restored bigint")


def _counted(read: Callable[..., pd.DataFrame]) -> pd.DataFrame:
    kinds = read()["kind"]
    counts = kinds.astype(object).value_counts(dropna=False)
    return pd.DataFrame({"kind": counts.index, "n": counts.to_numpy(), "categories": len(kinds.cat.categories)})


def append_category(spark, d):
    """Categories that only come with the second append are united with the first ones'."""
    counts = _typed(spark, d).map_pandas(_counted, "kind string, n bigint, categories bigint", columns=["kind"])
    return counts.groupBy("kind").agg(F.sum("n").alias("n"), F.max("categories").alias("categories"))


def _by_ts(t: pd.DataFrame) -> pd.DataFrame:
    return t.set_index("ts")


def _both_ways(read: Callable[..., pd.DataFrame]) -> pd.DataFrame:
    numbers, instants = read(parse_dates=False), read()
    return pd.DataFrame({"event_id": numbers["event_id"].to_numpy(), "us": pd.Series(numbers.index.to_numpy() // 1000).where(instants.index.notna()), "ts": instants.index.to_numpy()})


def epoch_roundtrip(spark, d):
    """Keys kept as epoch nanoseconds, which come out as instants, or as numbers if asked for."""
    c = _collection(spark)
    c.write("item", Frames(_table(spark, d, "events").select("event_id", "ts"), _by_ts), epochdate=True)
    return c.item("item").map_pandas(_both_ways, "event_id bigint, us bigint, ts timestamp_ntz")


def json_extract(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item", columns=["event_id", "props"]).data
    return t.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def interval_struct(spark, d):
    it = _typed(spark, d)
    # intervals are structs in Spark, so that their sides can be used there
    return it.data.select("event_id", F.col("bin.left").alias("lo"), F.col("bin.right").alias("hi"))


def nested_roundtrip(spark, d):
    t = _held(spark, d, "embeddings", ["vec_id"]).item("item").data
    return t.select("vec_id", F.size("embedding").cast("bigint").alias("dims"), F.col("embedding")[0].cast("double").alias("first"), "label")


def category_counts(spark, d):
    return _typed(spark, d).data.groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))


# -- validation: all rules' counts in one pass
def val_counts(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item").data
    rules = [RangeRule("value", 10, 500), NoNullRule(["value", "user_id"])]
    counts = [c for r in rules for c in r.counts(t).values()]
    return t.agg(*(c.alias(n) for c, n in zip(counts, ("below", "above", "null_value", "null_user"))))


def val_range(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item").data
    counts = RangeRule("value", 10, 500).counts(t)
    passed = DataValidator([RangeRule("value", 10, 500)]).validate(t, raise_on_error=False)
    return t.agg(*(c.alias(n) for c, n in zip(counts.values(), ("below", "above")))).withColumn("passed", F.lit(passed))


def val_nulls(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item").data.withColumn("value", F.when(F.col("event_id") % 7 > 0, F.col("value")))
    passed = [DataValidator([NoNullRule([c])]).validate(t, raise_on_error=False) for c in ("value", "user_id")]
    return t.agg(*(c.alias("nulls") for c in NoNullRule(["value"]).counts(t).values())).select("nulls", F.lit(passed[0]).alias("value_full"), F.lit(passed[1]).alias("user_full"))


def val_unique(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item").data
    passed = [DataValidator([UniqueRule([c])]).validate(t, raise_on_error=False) for c in ("event_id", "user_id")]
    return t.groupBy("user_id").count().agg(F.sum(F.col("count") - 1).alias("repeats")).select("repeats", F.lit(passed[0]).alias("id_unique"), F.lit(passed[1]).alias("user_unique"))


def val_sorted(spark, d):
    return SortedKeyRule().falls(_table(spark, d, "events").select(F.col("event_id").alias(SEQ), "value"), "value")


def val_ohlc(spark, d):
    """Bars by hour; those of every fifth hour have got a high below their low, which the validator must count."""
    t = _held(spark, d, "events", ["ts"]).item("item", columns=["ts", "value"]).data
    bars = t.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"))
    planted = bars.withColumn("high", F.when(F.hour("hour") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")))
    validator = create_financial_validator(volume_column=None)
    fine = validator.rules[-1].validate_func(planted)
    passed = [validator.validate(x, raise_on_error=False) for x in (bars, planted)]
    return planted.agg(F.count("*").alias("bars"), F.count_if(~fine).alias("bad")).select("bars", "bad", *(F.lit(p).alias(n) for p, n in zip(passed, ("whole_passed", "planted_passed"))))


# -- schema evolution
def _evolved(spark, d, strategy) -> catalog.Collection:
    t, c = _table(spark, d, "events"), _collection(spark)
    c.write("item", t.where("event_id % 10 < 6").select("ts", "event_id", "user_id"), index=["ts"])
    c.enable_schema_evolution("item", strategy)
    return c


def evolve_add(spark, d):
    c = _evolved(spark, d, evolution.EvolutionStrategy.ADD_ONLY)
    c.append("item", _table(spark, d, "events").where("event_id % 10 >= 6").select("ts", "event_id", "user_id", "value"))
    return c.item("item").data


def evolve_add_overlap(spark, d):
    """A column comes with rows of which some replace old ones: old rows have its default, wherever they're kept."""
    c = _evolved(spark, d, evolution.EvolutionStrategy.ADD_ONLY)
    c.append("item", _table(spark, d, "events").where("event_id % 10 >= 5").select("ts", "event_id", "user_id", "value"))
    return c.item("item").data


def evolve_widen(spark, d):
    """A bigint column becomes double with the second append; the first segment is read as it is, then cast."""
    c = _evolved(spark, d, evolution.EvolutionStrategy.COMPATIBLE)
    c.append("item", _table(spark, d, "events").where("event_id % 10 >= 6").select("ts", "event_id", (F.col("user_id") + 0.5).alias("user_id")))
    return c.item("item").data


def evolve_coerce(spark, d):
    t = _table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")).alias("raw"))
    from pyspark.sql import types as T

    made = evolution.cast_to(t, t.schema, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("raw", T.LongType())]))
    return made.withColumnRenamed("raw", "as_int")


def migrate_rename(spark, d):
    c = _held(spark, d, "events", ["ts"])
    e = c.enable_schema_evolution("item")
    e.register_migration(1, 2, evolution.rename_columns({"value": "amount"}))
    c.migrate_item_to_version("item", 2)
    return c.item("item").data.select("event_id", "amount")


def migrate_calc(spark, d):
    c = _held(spark, d, "events", ["ts"])
    e = c.enable_schema_evolution("item")
    e.register_migration(1, 2, evolution.add_calculated_column("twice", "value * 2"))
    c.migrate_item_to_version("item", 2)
    return c.item("item").data.select("event_id", "twice")


def schema_changes(spark, d):
    old = evolution.Schema.of(_table(spark, d, "events").schema)
    new = evolution.Schema.of(_table(spark, d, "events").select("ts", "event_id", F.col("user_id").cast("int"), F.lit(1).alias("extra")).schema)
    return spark.createDataFrame([(x.change_type, x.column) for x in old.detect_changes(new)], "change_type string, column_name string")


def downcast_stats(spark, d):
    t = _held(spark, d, "events", ["ts"]).item("item").data
    stats = memory.downcast_stats(t.select("event_id", "user_id", "value"), distinct=False)
    rows = [(c, float(s["min"]), float(s["max"]), s["nulls"]) for c, s in stats.items()]
    return spark.createDataFrame(rows, "column_name string, least double, greatest double, nulls bigint")


def downcast(spark, d):
    narrow = memory.optimize_dataframe_memory(_table(spark, d, "events").select("event_id", "user_id"))
    return narrow.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"), F.lit(narrow.schema["user_id"].dataType.simpleString()).alias("kind"))


# -- what an item's lazy frame inherits
def lazy_join_agg(spark, d):
    c = _collection(spark)
    c.write_batch({"orders": _table(spark, d, "orders"), "customer": _table(spark, d, "customer")})
    orders, customer = c.item("orders", columns=["o_custkey", "o_totalprice"]).data, c.item("customer", columns=["c_custkey", "c_mktsegment"]).data
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


def lazy_asof(spark, d):
    """For each event its user's last purchase before it."""
    t = _held(spark, d, "events", ["user_id", "ts"]).item("item").data
    before = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before).alias("purchase_id"))


def lazy_rollup(spark, d):
    t = _held(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]).item("item", columns=["l_returnflag", "l_linestatus", "l_quantity"]).data
    return t.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


_OWN: dict[str, tuple[Callable, str | None]] = {
    "flagship": (flagship, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, max(value) AS most FROM events WHERE event_type = 'click' AND value > 100 GROUP BY 1"),
    "scan_full": (_read("events", ["ts"]), "SELECT * FROM events"),
    "scan_project": (_read("events", ["ts"], columns=["ts", "value"]), "SELECT ts, value FROM events"),
    "scan_filter": (_read("events", ["ts"], filters=CLICKS), "SELECT * FROM events WHERE event_type = 'click' AND value > 100"),
    "scan_filter_dnf": (
        _read("events", ["ts"], filters=EITHER),
        "SELECT * FROM events WHERE (event_type IN ('click', 'view') AND value > 100) OR (event_type NOT IN ('click', 'view', 'purchase') AND value <= 10)",
    ),
    "write_roundtrip": (_read("orders", ["o_orderkey"]), "SELECT * FROM orders"),
    "scan_filter_zoned": (scan_filter_zoned, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 02:00:00'"),
    "index_last": (index_last, "SELECT max(ts) AS last_ts FROM events"),
    "head_k": (_ends(True), "SELECT * FROM events ORDER BY ts LIMIT 10"),
    "tail_k": (_ends(False), "SELECT * FROM events ORDER BY ts DESC LIMIT 10"),
    "chunk_rows": (chunk_rows, "SELECT chunk, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY ts) - 1) // 1000 AS chunk FROM events) GROUP BY chunk"),
    "append_keep_first": (_append("keep_first"), "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 10 < 6 THEN value ELSE value * 10 END AS value, props FROM events"),
    "append_keep_last": (_append("keep_last"), "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 10 < 5 THEN value ELSE value * 10 END AS value, props FROM events"),
    "append_keep_all": (
        _append("keep_all"),
        "SELECT * FROM events WHERE event_id % 10 < 6 UNION ALL SELECT event_id, ts, user_id, event_type, value * 10 AS value, props FROM events WHERE event_id % 10 >= 5",
    ),
    "append_multikey": (append_multikey, "SELECT * REPLACE (CASE WHEN o_orderkey % 10 < 5 THEN o_totalprice ELSE o_totalprice * 10 END AS o_totalprice) FROM orders"),
    "append_widen": (append_widen, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE value END AS v FROM events"),
    "append_type_error": (append_type_error, "SELECT count(*) AS n, CAST(1 AS INT) AS refused FROM events"),
    "append_category": (append_category, "SELECT event_type AS kind, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events) AS categories FROM events GROUP BY 1"),
    "dup_keys": (dup_keys, "SELECT count(*) AS n FROM events o WHERE event_id % 10 < 6 AND EXISTS (SELECT 1 FROM events n WHERE n.event_id % 10 >= 5 AND n.ts = o.ts)"),
    "dedup_first": (_dedup("first"), "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
    "dedup_last": (_dedup("last"), "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "distinct_rows": (distinct_rows, "SELECT DISTINCT event_type, user_id FROM events"),
    "read_batch_union": (read_batch_union, "SELECT event_id, value, event_type || 's' AS item FROM events WHERE event_type IN ('click', 'view')"),
    "snapshot_read": (snapshot_read, "SELECT * FROM events"),
    "rebalance_same_rows": (rebalance_same_rows, "SELECT * FROM events"),
    "transaction_rows": (transaction_rows, "SELECT event_id, ts, value, CAST(1 AS INT) AS items FROM events"),
    "stream_append": (stream_append, "SELECT * FROM events"),
    "stream_windows": (stream_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "time_bucket_month": (_bucket("month"), "SELECT date_trunc('month', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "time_bucket_day": (_bucket("day"), "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "span_days": (span_days, "SELECT date_diff('day', min(ts), max(ts)) AS days FROM events"),
    "tz_to_utc": (tz_to_utc, "SELECT event_id, (ts AT TIME ZONE 'US/Eastern') AT TIME ZONE 'UTC' AS utc FROM events"),
    "epoch_roundtrip": (epoch_roundtrip, "SELECT event_id, epoch_us(ts) AS us, ts FROM events"),
    "typed_columns": (
        typed_columns,
        "SELECT event_id, strftime(ts, '%Y-%m') AS month, CAST(round(round(value, 2) * 1000) AS BIGINT) AS ms, event_type AS kind, CAST(floor(value / 10) * 10 AS BIGINT) AS lo, CAST(floor(value / 10) * 10 + 10 AS BIGINT) AS hi,"
        " extract('hour' FROM (ts AT TIME ZONE 'UTC') AT TIME ZONE 'US/Eastern') AS hour, props, CAST(5 AS BIGINT) AS restored FROM events",
    ),
    "json_extract": (json_extract, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "interval_struct": (interval_struct, "SELECT event_id, CAST(floor(value / 10) * 10 AS BIGINT) AS lo, CAST(floor(value / 10) * 10 + 10 AS BIGINT) AS hi FROM events"),
    "nested_roundtrip": (nested_roundtrip, "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, CAST(embedding[1] AS DOUBLE) AS first, label FROM embeddings"),
    "category_counts": (category_counts, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "val_counts": (
        val_counts,
        "SELECT count(*) FILTER (value < 10) AS below, count(*) FILTER (value > 500) AS above, count(*) FILTER (value IS NULL) AS null_value, count(*) FILTER (user_id IS NULL) AS null_user FROM events",
    ),
    "val_range": (val_range, "SELECT count(*) FILTER (value < 10) AS below, count(*) FILTER (value > 500) AS above, bool_and(value BETWEEN 10 AND 500) AS passed FROM events"),
    "val_nulls": (val_nulls, "SELECT count(*) FILTER (event_id % 7 = 0 OR value IS NULL) AS nulls, false AS value_full, count(*) = count(user_id) AS user_full FROM events"),
    "val_unique": (val_unique, "SELECT CAST(count(*) - count(DISTINCT user_id) AS BIGINT) AS repeats, count(*) = count(DISTINCT event_id) AS id_unique, count(*) = count(DISTINCT user_id) AS user_unique FROM events"),
    "val_sorted": (val_sorted, "SELECT count(*) AS falls FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM events) WHERE value < p"),
    "val_ohlc": (
        val_ohlc,
        "SELECT count(*) AS bars, count(*) FILTER (hour(h) % 5 = 0) AS bad, true AS whole_passed, count(*) FILTER (hour(h) % 5 = 0) = 0 AS planted_passed FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events)",
    ),
    "evolve_add": (evolve_add, "SELECT ts, event_id, user_id, CASE WHEN event_id % 10 >= 6 THEN value ELSE 0.0 END AS value FROM events"),
    "evolve_add_overlap": (evolve_add_overlap, "SELECT ts, event_id, user_id, CASE WHEN event_id % 10 >= 5 THEN value ELSE 0.0 END AS value FROM events"),
    "evolve_widen": (evolve_widen, "SELECT ts, event_id, CASE WHEN event_id % 10 < 6 THEN CAST(user_id AS DOUBLE) ELSE CAST(user_id + 0.5 AS DOUBLE) END AS user_id FROM events"),
    "evolve_coerce": (evolve_coerce, "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS as_int FROM events"),
    "migrate_rename": (migrate_rename, "SELECT event_id, value AS amount FROM events"),
    "migrate_calc": (migrate_calc, "SELECT event_id, value * 2 AS twice FROM events"),
    "schema_changes": (
        schema_changes,
        "SELECT * FROM (VALUES ('column_added', 'extra'), ('column_removed', 'event_type'), ('column_removed', 'value'), ('column_removed', 'props'), ('type_changed', 'user_id'), ('columns_reordered', '')) t(change_type, column_name)",
    ),
    "downcast_stats": (
        downcast_stats,
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, count(*) FILTER ({c} IS NULL) AS nulls FROM events" for c in ("event_id", "user_id", "value")),
    ),
    "downcast": (
        downcast,
        "SELECT event_id, user_id, (SELECT CASE WHEN max(user_id) < 128 THEN 'tinyint' WHEN max(user_id) < 32768 THEN 'smallint' ELSE 'int' END FROM events) AS kind FROM events",
    ),
    "lazy_join_agg": (lazy_join_agg, "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "lazy_asof": (
        lazy_asof,
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase_id FROM events",
    ),
    "lazy_rollup": (lazy_rollup, "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _OWN.items()} | problems.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _OWN.items() if sql} | problems.oracle_sql()
