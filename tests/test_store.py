"""The store: lifecycle, round trips, appends, snapshots, transactions, validation, evolution, layout."""

import asyncio
import datetime as dt
import threading

import numpy as np
import pandas as pd
import pytest
from pandas.testing import assert_frame_equal

from tidemark import store as ts
from tidemark.store import catalog, layout, memory, types


@pytest.fixture
def collection(spark, tmp_path):
    ts.set_path(str(tmp_path))
    ts.set_client(spark)
    return ts.store("test").collection("c")


def daily(n=100, start="2024-01-01", seed=1):
    rng = np.random.default_rng(seed)
    index = pd.date_range(start, periods=n, freq="D")
    return pd.DataFrame({"value1": rng.normal(size=n), "value2": rng.normal(size=n), "category": rng.choice(list("ABC"), n)}, index=index)


def same_frame(a, b, **kw):
    assert_frame_equal(a, b, check_freq=False, **kw)


# -- lifecycle
def test_stores_and_collections(collection, tmp_path):
    s = ts.store("test")
    assert s.datastore == str(tmp_path / "test") and ts.list_stores() == ["test"]
    assert s.list_collections() == ["c"]
    with pytest.raises(ts.CollectionExistsError):
        s.create_collection("c")
    collection.write("x", daily(3))
    assert s.collection("c").list_items() == {"x"} and s.item("c", "x").to_pandas().shape == (3, 3)
    assert s.collection("c", overwrite=True).list_items() == set()
    assert s.delete_collection("c")
    for call in (lambda: s.delete_collection("c"), lambda: s.item("c", "x"), lambda: ts.delete_store("nope")):
        with pytest.raises(ValueError):
            call()
    assert ts.delete_stores() and ts.list_stores() == []


def test_paths(tmp_path):
    with pytest.raises(ValueError, match="only works with local"):
        ts.set_path("s3://bucket")
    assert ts.set_path(f"file://{tmp_path}/with space").exists()
    ts.set_partition_size(5)
    assert ts.get_partition_size() == 5 and ts.set_partition_size() == 99_000_000


def test_items_and_metadata(collection):
    collection.write("a", daily(5), metadata={"source": "s", "tags": ["x", "y"]})
    collection.write("b", daily(5), metadata={"source": "t"})
    assert collection.list_items() == {"a", "b"} and collection.list_items(source="s") == {"a"} == collection.list_items(source="s", tags=["x", "y"])
    meta = collection.get_item_metadata("a")
    dt.datetime.strptime(meta.pop("_updated"), "%Y-%m-%d %H:%M:%S.%f")
    assert meta == {"source": "s", "tags": ["x", "y"]} and collection.get_item_metadata("none") == {}
    collection.write("a", daily(5), metadata={"source": "new"}, overwrite=True)
    assert collection.get_item_metadata("a")["source"] == "new"
    with pytest.raises(ts.ItemExistsError):
        collection.write("a", daily(5))
    collection.delete_item("a")
    assert collection.list_items() == {"b"}
    for call in (lambda: collection.delete_item("a"), lambda: collection.item("a"), lambda: collection.append("a", daily(1))):
        with pytest.raises(ts.ItemNotFoundError):
            call()
    assert collection.vacuum() == 0 and collection.vacuum(older_than_s=0) == 2


@pytest.mark.parametrize("name", ["item_with_underscore", "item-with-dash", "item.with.dots", "UPPER", "123", "with space"])
def test_names(collection, name):
    collection.write(name, daily(3))
    assert name in collection.items


# -- round trips
FRAMES = {
    "daily": daily(),
    "named key": pd.DataFrame({"value": range(10)}, index=pd.date_range("2024-01-01", periods=10, name="custom_index")),
    "keyless": pd.DataFrame({"i": [1, 2, 3], "f": [1.5, np.nan, 2.5], "s": ["a", None, "c"], "b": [True, False, True], "d": pd.date_range("2024-01-01", periods=3)}),
    "empty": pd.DataFrame({"value": pd.Series([], dtype="float64"), "t": pd.Series([], dtype="datetime64[ns]")}),
    "ties": pd.DataFrame({"value": [1, 2, 3, 4]}, index=[1, 1, 2, 2]),
    "text key": pd.DataFrame({"v": [1.0, 2.0]}, index=pd.Index(["a", "b"], name="k")),
    "nanoseconds": pd.DataFrame({"value": range(10)}, index=pd.date_range("2024-01-01", periods=10, freq="s") + pd.to_timedelta(range(10), unit="ns")),
    "zoned": pd.DataFrame({"v": [1, 2], "t": pd.to_datetime(["2024-01-01", "2024-06-01"]).tz_localize("US/Eastern")}),
    "durations": pd.DataFrame({"d": pd.to_timedelta([1, 2, None], unit="D"), "n": pd.to_timedelta([1, 2, 3], unit="ns")}),
    "categories": pd.DataFrame({"c": pd.Categorical(["A", "B", None, "A"], categories=["A", "B", "C", "D"], ordered=True)}),
    "periods": pd.DataFrame({"p": pd.period_range("2024-01", periods=4, freq="M"), "v": range(4)}),
    "intervals": pd.DataFrame({"i": pd.interval_range(0, 4), "v": range(4)}),
    "nested": pd.DataFrame({"l": [[1, 2], [3], None], "d": [{"a": 1}, {"b": [2]}, {}], "s": [{1, 2}, None, {3}]}),
    "small types": pd.DataFrame({"a": np.array([1, 2], "int8"), "b": np.array([1, 2], "uint32"), "c": np.array([1, 2], "float32"), "u": np.array([2**63, 1], "uint64")}),
    "nullable": pd.DataFrame({"a": pd.array([1, None], "Int64"), "b": pd.array([True, None], "boolean")}),
    "two keys": pd.DataFrame({"v": range(6)}, index=pd.MultiIndex.from_product([["A", "B"], pd.date_range("2024-01-01", periods=3)], names=["category", "date"])),
    "three keys": pd.DataFrame({"v": range(8)}, index=pd.MultiIndex.from_product([[1, 2], ["x", "y"], ["p", "q"]], names=["a", "b", "c"])),
    "bytes": pd.DataFrame({"b": [b"x", None], "day": [dt.date(2024, 1, 1), None]}),
}


@pytest.mark.parametrize("name", FRAMES)
def test_round_trip(collection, name):
    collection.write("x", FRAMES[name])
    same_frame(collection.item("x").to_pandas(), FRAMES[name])


def test_zoned_key(collection):
    frame = pd.DataFrame({"v": range(24)}, index=pd.date_range("2024-01-01", periods=24, freq="h", tz="US/Eastern"))
    collection.write("x", frame)
    assert str(collection.item("x").to_pandas().index.tz) == "UTC"
    same_frame(collection.item("x").to_pandas(restore_tz=True), frame)
    collection.append("x", frame.iloc[:3].tz_convert("UTC") * 10)
    assert collection.item("x").to_pandas()["v"].tolist()[:4] == [0, 10, 20, 3]


def test_epochdate(collection):
    frame = pd.DataFrame({"v": range(5)}, index=pd.date_range("2024-01-01", periods=5))
    collection.write("x", frame, epochdate=True)
    assert dict(collection.item("x").data.dtypes)["index"] == "bigint"
    same_frame(collection.item("x").to_pandas(), frame)
    assert collection.item("x").to_pandas(parse_dates=False).index[0] == frame.index[0].value
    collection.append("x", frame.iloc[4:])
    assert len(collection.item("x").to_pandas()) == 5


def test_bad_frames(collection):
    bad = [pd.DataFrame(), pd.DataFrame([[1, 2]], columns=["a", "a"]), pd.DataFrame([[1, 2]], columns=["a", "A"]), [1, 2]]
    for frame in bad:
        with pytest.raises(ts.ValidationError):
            collection.write("x", frame)
    with pytest.warns(UserWarning, match="many"):
        types.encode_frame(pd.DataFrame(np.zeros((2, 1001))))


def test_spark_and_item_inputs(collection, spark):
    df = spark.createDataFrame([(2, float("nan")), (1, 5.0), (None, 1.0)], "k bigint, v double")
    collection.write("x", df, index=["k"])
    assert [tuple(r) for r in collection.item("x").ordered().collect()] == [(None, 1.0), (1, 5.0), (2, None)]
    collection.write("y", collection.item("x"))
    assert collection.item("y").data.count() == 3
    with pytest.raises(ts.ValidationError):
        collection.write("z", df, index=["nope"])


# -- reading
def test_columns_filters_ends(collection, spark):
    frame = daily(400)
    collection.write("x", frame, npartitions=3)
    got = collection.item("x", columns=["value1"], filters=[("category", "==", "A"), ("value2", ">", 0)])
    same_frame(got.to_pandas(), frame[(frame.category == "A") & (frame.value2 > 0)][["value1"]])
    plan = got.data._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(category,A)" in plan and "GreaterThan(value2,0" in plan and "value2" in plan.split("ReadSchema")[1]
    either = collection.item("x").to_pandas(filters=[[("category", "in", ["A"])], [("category", "not in", ["A", "B"])]])
    same_frame(either, frame[frame.category.isin(["A", "C"])])
    same_frame(collection.item("x").head(3), frame.head(3))
    same_frame(collection.item("x").tail(3), frame.tail(3))
    assert collection.index("x", last=True) == frame.index[-1] and collection.index("x").count() == 400
    for kw in ({"columns": ["nope"]}, {"filters": [("nope", "==", 1)]}, {"filters": [("value1", "~", 1)]}):
        with pytest.raises(ts.ValidationError):
            collection.item("x", **kw)


def test_segments_out_of_range_are_not_read(collection):
    collection.write("x", daily(10))
    collection.append("x", daily(10, "2025-01-01"))
    old = collection.item("x", filters=[("index", "<", pd.Timestamp("2024-06-01"))])
    assert old.data.count() == 10 and len(old.data.inputFiles()) < len(collection.item("x").data.inputFiles())


def test_chunks(collection):
    frame = daily(1050)
    collection.write("x", frame)
    parts = list(memory.read_in_chunks(collection, "x", 500))
    assert [len(p) for p in parts] == [500, 500, 50]
    same_frame(pd.concat(parts), frame)
    with memory.memory_efficient_read(7):
        assert ts.get_client().conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"


# -- appending
def overlap():
    old = pd.DataFrame({"value": range(10)}, index=pd.date_range("2024-01-01", periods=10))
    return old, pd.DataFrame({"value": range(100, 110)}, index=pd.date_range("2024-01-06", periods=10))


@pytest.mark.parametrize("how, n, sixth", [("keep_last", 15, 100), ("keep_first", 15, 5), ("keep_all", 20, None)])
def test_append(collection, how, n, sixth):
    old, new = overlap()
    collection.write("x", old, metadata={"source": "s"})
    collection.append("x", pd.concat([new, new]) if how != "keep_all" else new, duplicate_handling=how)
    got = collection.item("x").to_pandas()
    assert len(got) == n and got.index.is_monotonic_increasing
    if sixth is not None:
        assert got.loc["2024-01-06", "value"] == sixth
    assert collection.get_item_metadata("x")["source"] == "s"
    version = collection._load("x")["version"]
    collection.append("x", new, duplicate_handling="keep_first")
    collection.append("x", new.iloc[:0])
    assert collection._load("x")["version"] == version


def test_append_errors(collection):
    old, new = overlap()
    collection.write("x", old)
    with pytest.raises(ts.DataIntegrityError, match="duplicate indices"):
        collection.append("x", new, duplicate_handling="error")
    with pytest.raises(ts.ValidationError, match="Schema mismatch"):
        collection.append("x", new.rename(columns={"value": "v"}))
    with pytest.raises(ts.ValidationError):
        collection.append("x", new.reset_index())
    with pytest.raises(ValueError):
        collection.append("x", new, duplicate_handling="maybe")
    collection.append("x", new.assign(more=1), validate_schema=False)
    got = collection.item("x").to_pandas()
    assert got["more"].isna().sum() == 5 and len(got) == 15


def test_append_keeps_what_it_must(collection):
    nulls = pd.DataFrame({"v": [np.nan] * 3}, index=pd.date_range("2024-01-01", periods=3))
    collection.write("x", nulls)
    collection.append("x", nulls.set_axis(pd.date_range("2024-02-01", periods=3)))
    assert len(collection.item("x").to_pandas()) == 6
    collection.write("keyless", pd.DataFrame({"v": range(10)}))
    for k in range(3):
        collection.append("keyless", pd.DataFrame({"v": [k]}))
    assert collection.item("keyless").to_pandas()["v"].tolist() == [*range(10), 0, 1, 2]
    two = FRAMES["two keys"]
    collection.write("two", two)
    collection.append("two", two.iloc[4:] + 10)
    assert collection.item("two").to_pandas()["v"].tolist() == [0, 1, 2, 3, 14, 15]


def test_null_keys_replace_null_keys(collection, spark):
    collection.write("x", spark.createDataFrame([(None, 1), (1, 2)], "k int, v int"), index=["k"])
    collection.append("x", spark.createDataFrame([(None, 3)], "k int, v int"))
    assert {tuple(r) for r in collection.item("x").data.collect()} == {(None, 3), (1, 2)}


def test_out_of_order_and_streams(collection):
    for k, start in enumerate(["2024-03-01", "2024-01-01", "2024-02-01"]):
        (collection.append if k else collection.write)("x", daily(5, start))
    assert len(collection.item("x").to_pandas()) == 15 and collection.item("x").to_pandas().index.is_monotonic_increasing
    chunks = [daily(7, f"202{k}-05-01") for k in range(5)] + [daily(0)]
    assert collection.append_stream("x", iter(chunks), chunk_size=10) == 35
    assert len(collection.item("x").to_pandas()) == 50
    with pytest.raises(ts.ValidationError):
        collection.append_stream("x", iter([1]))


def test_structured_streaming_is_idempotent(collection, spark, tmp_path):
    from tidemark.streaming.ingest import append_stream

    source = tmp_path / "in"
    spark.range(10).selectExpr("id as k", "id * 2 as v").write.parquet(str(source))
    for n in (10, 15):
        append_stream(spark.readStream.schema("k bigint, v bigint").parquet(str(source)), collection, "x", ["k"], str(tmp_path / "check")).awaitTermination()
        assert collection.item("x").data.count() == n
        spark.range(10, 15).selectExpr("id as k", "id * 2 as v").write.mode("append").parquet(str(source))


# -- snapshots
def test_snapshots(collection):
    collection.write("x", daily(5), metadata={"m": 1})
    collection.create_snapshot("be/fore 1!")
    assert collection.list_snapshots() == {"before1"}
    collection.write("x", daily(2), overwrite=True)
    collection.append("x", daily(3, "2025-01-01"))
    collection.delete_item("x")
    kept = collection.item("x", snapshot="before1")
    same_frame(kept.to_pandas(), daily(5))
    assert kept.metadata["m"] == 1
    collection.vacuum(older_than_s=0)
    same_frame(collection.item("x", snapshot="before1").to_pandas(), daily(5))
    with pytest.raises(ts.SnapshotNotFoundError):
        collection.item("x", snapshot="none")
    with pytest.raises(ts.ItemNotFoundError):
        collection.item("y", snapshot="before1")
    collection.create_snapshot()
    assert len(collection.snapshots) == 2 and collection.delete_snapshot("unknown")
    assert collection.delete_snapshots() and not collection.snapshots


# -- batches, coroutines, threads
def test_batches(collection):
    collection.write_batch({f"i{k}": daily(5) for k in range(4)}, metadata={"batch": True})
    assert collection.list_items(batch=True) == {f"i{k}" for k in range(4)}
    got = collection.read_batch(["i0", "none", "i1"], columns=["value1"])
    assert got["none"] is None and got["i1"].shape == (5, 1)
    with pytest.raises(ts.StorageError, match="1 of 2"):
        collection.write_batch({"i0": daily(5), "new": daily(5)})
    assert "new" in collection.items
    assert collection.read_batch_union(["i0", "i1"]).groupBy("item").count().count() == 2
    collection.write_threaded("thread", daily(3)).result()
    assert "thread" in collection.items


def test_coroutines(collection):
    async def run():
        async with ts.async_store(collection) as a:
            await a.write("x", daily(3))
            await a.parallel_append("x", [daily(3, f"202{k}-05-01") for k in range(3)])
            assert len(await a.read("x")) == 12
            assert (await a.read_batch(["x", "none"]))["none"] is None
            assert await a.list_items() == {"x"}
            await a.delete("x")
        async with ts.async_store("test") as s:
            assert await s.list_collections() == ["c"]
            await s.collection("c").write_batch({"p": daily(2), "q": daily(2)})

    asyncio.run(run())
    assert collection.items == {"p", "q"}


# -- transactions
def test_transactions(collection):
    collection.write("gone", daily(3))
    with ts.transaction(collection) as t:
        t.write("x", daily(5))
        t.append("x", daily(5, "2025-01-01"))
        t.delete("gone")
        assert collection.items == {"gone"}
    assert collection.items == {"x"} and len(collection.item("x").to_pandas()) == 10
    with pytest.raises(ts.TransactionError):
        t.write("y", daily(1))
    with pytest.raises(ts.TransactionError), ts.transaction(collection) as t:
        t.write("y", daily(1))
        t.append("none", daily(1))
    with pytest.raises(RuntimeError), ts.transaction(collection) as t:
        t.delete("x")
        raise RuntimeError
    assert collection.items == {"x"}
    with ts.batch_transaction(collection) as t:
        t.append("x", daily(2, "2026-01-01"))
        t.append("x", daily(2, "2027-01-01"))
        t.write("y", daily(1))
    assert len(collection.item("x").to_pandas()) == 14 and "y" in collection.items


def test_a_commit_survives_a_crash(collection, monkeypatch):
    collection.write("x", daily(3))
    monkeypatch.setattr(catalog.Collection, "_apply", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt), ts.transaction(collection) as t:
        t.write("y", daily(1))
        t.delete("x")
    monkeypatch.undo()
    assert ts.store("test").collection("c").items == {"y"}


def test_locks(collection):
    with ts.with_lock(collection, "l"):
        with pytest.raises(ts.StorageError):
            ts.CollectionLock(collection, "l").acquire(timeout=0.2)
    held = ts.CollectionLock(collection, "l")
    assert held.acquire(1)
    other = ts.CollectionLock(collection, "l")
    other.release()  # not its own
    threading.Timer(0.2, held.release).start()
    assert other.acquire(5)
    other.release()


# -- validation
def test_validation(collection):
    bad = pd.DataFrame({"price": [1.0, 2000.0, np.nan, 1.0]})
    rules = [ts.ColumnExistsRule(["price", "volume"]), ts.RangeRule("price", min_value=0, max_value=1000), ts.NoNullRule(["price"]), ts.UniqueRule(["price"]), ts.DataTypeRule({"price": str}), ts.CustomRule(lambda df: df.count() < 2, "few")]
    v = ts.create_validator(rules)
    with pytest.raises(ts.ValidationError, match="^Data validation failed:") as e:
        v.validate(bad)
    assert all(t in str(e.value) for t in ("volume", "1 values above", "1 nulls", "1 repeats", "not str", "few"))
    v.disable()
    assert v.validate(bad)
    v.enable()
    for name in ("column_exists", "no_null", "unique", "data_type", "few"):
        v.remove_rule(name)
    collection.set_validator(v)
    with pytest.raises(ts.ValidationError):
        collection.write("x", bad)
    collection.write("x", bad, validate=False)
    assert collection.get_validator() is v

    @ts.with_validation(v)
    def take(frame):
        return len(frame)

    assert take(bad.iloc[:1]) == 1
    with pytest.raises(ts.ValidationError):
        take(bad)


def test_ready_made_validators(collection):
    collection.set_validator(ts.create_timeseries_validator(["value1", "value2"]))
    collection.write("x", daily(10))
    with pytest.raises(ts.ValidationError, match="sorted"):
        collection.write("y", daily(10).iloc[::-1])
    bars = pd.DataFrame({"open": [1, 2], "high": [3, 4], "low": [0, 1], "close": [2.0, 3.0], "volume": [5, 6]})
    assert ts.create_financial_validator().validate(bars)
    assert not ts.create_financial_validator().validate(bars.assign(high=[0, 4]), raise_on_error=False)


# -- evolution
def test_evolution(collection):
    frame = pd.DataFrame({"value": [1, 2]}, index=pd.date_range("2024-01-01", periods=2))
    later = frame.set_axis(pd.date_range("2025-01-01", periods=2))
    collection.write("x", frame)
    evolution = collection.enable_schema_evolution("x", ts.EvolutionStrategy.ADD_ONLY)
    collection.append("x", later.assign(extra=1.5, text="t"))
    got = collection.item("x").to_pandas()
    assert got["extra"].tolist() == [0.0, 0.0, 1.5, 1.5] and got["text"].isna().sum() == 2
    with pytest.raises(ts.SchemaError):
        collection.append("x", later.drop(columns="value").assign(extra=1.0, text="t"))
    evolution.register_migration(1, 2, lambda df: df.withColumnRenamed("value", "renamed"))
    collection.migrate_item_to_version("x", 2)
    assert "renamed" in collection.item("x").to_pandas() and ts.store("test").collection("c").get_item_evolution("x") is not None
    with pytest.raises(ts.SchemaError):
        collection.migrate_item_to_version("x", 9)


def test_schema_rules():
    of = lambda **c: ts.Schema(list(c), c)
    kinds = [c.change_type for c in of(a="int", b="int", c="int").detect_changes(of(c="bigint", a="int", d="int"))]
    assert kinds == ["column_added", "column_removed", "type_changed", "columns_reordered"]
    check = lambda how, a, b: ts.SchemaEvolution(how).validate_evolution(a, b)
    s = ts.EvolutionStrategy
    assert check(s.COMPATIBLE, of(a="int"), of(a="bigint", b="int")) and not check(s.COMPATIBLE, of(a="bigint"), of(a="int"))
    assert check(s.FLEXIBLE, of(a="int"), of(b="int")) and not check(s.STRICT, of(a="int"), of(a="int", b="int"))
    assert check(s.ADD_ONLY, of(a="int"), of(a="int", b="int")) and not check(s.ADD_ONLY, of(a="int"), of(a="bigint"))


# -- layout and memory
def test_layout(collection):
    frame = pd.DataFrame({"value": np.arange(50_000.0)}, index=pd.date_range("2024-01-01", periods=50_000, freq="15min"))
    collection.write("x", frame)
    system = collection._load("x")["system"]
    assert system["_partition_strategy"] == {"type": "time", "freq": "quarter"} and system["_partitions"] == 6
    ts.rebalance_partitions(collection, "x", target_size_mb=1)
    same_frame(collection.item("x").to_pandas(), frame)
    assert [layout.frequency(d) for d in (364, 365, 1094, 1095)] == ["month", "quarter", "quarter", "year"]
    assert ts.calculate_optimal_partitions(frame, target_size_mb=0.1) == 7 and ts.calculate_optimal_partitions(frame) == 1


def test_memory(spark):
    frame = pd.DataFrame({"small": range(5000), "f": np.arange(5000) / 2, "c": ["a", "b"] * 2500, "u": [f"u{k}" for k in range(5000)]})
    made = ts.optimize_dataframe_memory(frame)
    assert str(made["small"].dtype) == "int16" and str(made["f"].dtype) == "float32" and str(made["c"].dtype) == "category" and made["u"].dtype == object
    assert memory.estimate_dataframe_memory(made) < memory.estimate_dataframe_memory(frame)
    narrow = ts.optimize_dataframe_memory(spark.createDataFrame([(1, 0.5, 0.1), (300, None, None)], "a bigint, b double, c double"))
    assert dict(narrow.dtypes) == {"a": "smallint", "b": "float", "c": "double"}
    assert 0 < memory.get_memory_info()["percent"] < 100 and memory.check_memory_usage() < 1
    with memory.MemoryMonitor() as m:
        pass
    assert m.growth_gb < 1


def test_read_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("v,date\n1,2024-01-01\n2,2024-01-02\n")
    df = ts.read_csv(str(tmp_path / "x.csv"), index_col=["date"], index_name="day", spark=spark)
    assert df.columns == ["day", "v"] and df.count() == 2


def test_errors_share_a_base():
    kinds = [ts.DataIntegrityError, ts.ItemNotFoundError, ts.ItemExistsError, ts.CollectionNotFoundError, ts.CollectionExistsError, ts.SnapshotNotFoundError, ts.StorageError, ts.SchemaError, ts.ConfigurationError, ts.ValidationError, ts.TransactionError]
    assert all(issubclass(k, ts.TidemarkError) for k in kinds) and issubclass(ts.TransactionError, ts.StorageError)
