"""Nothing is lost: types and categories on append, time zones, several processes, half-published changes."""

import json
import logging
import os
import subprocess
import sys
import time

import pandas as pd
import pytest

from tidemark import store as ts
from tidemark.store.catalog import RECORDS, Collection
from tidemark.store.filters import may_match


@pytest.fixture()
def collection(spark, tmp_path):
    ts.set_path(str(tmp_path))
    ts.set_client(spark)
    return ts.store("test").collection("c")


def frame(values, start=0, column="v"):
    return pd.DataFrame({column: values}, index=pd.Index(range(start, start + len(values)), name="k"))


def test_types_are_widened_or_refused(collection):
    collection.write("x", frame([1, 2]))
    collection.append("x", frame([1.5, 2.7], 2))
    assert collection.item("x").to_pandas()["v"].tolist() == [1.0, 2.0, 1.5, 2.7]
    with pytest.raises(ts.ValidationError, match="Schema mismatch"):
        collection.append("x", frame(["x", "y"], 4))
    collection.append("x", frame([None, None], 4))  # a column without a value has no type of its own
    assert collection.item("x").to_pandas()["v"].isna().sum() == 2
    collection.write("big", frame([2**53 + 1]))
    with pytest.raises(ts.ValidationError, match="double"):
        collection.append("big", frame([0.5], 1))
    assert collection.item("big").to_pandas()["v"].tolist() == [2**53 + 1]


def test_flexible_counts_what_becomes_null(collection):
    day = pd.Timestamp("2024-01-01")
    collection.write("x", frame([day, day]))
    collection.enable_schema_evolution("x", ts.EvolutionStrategy.FLEXIBLE)
    with pytest.warns(UserWarning, match="1 values of column 'v'"):
        collection.append("x", frame(["2024-01-01", "new year"], 8))
    assert collection.item("x").to_pandas()["v"].tolist()[:3] == [day] * 3 and collection.item("x").to_pandas()["v"].isna().sum() == 1
    collection.write("n", frame([1]))
    collection.enable_schema_evolution("n", ts.EvolutionStrategy.FLEXIBLE)
    with pytest.raises(ts.SchemaError):
        collection.append("n", frame([b"?"], 20))
    assert collection._manifest_of("x")["system"]["_failed_casts"] == {"v": 1}


def test_categories_are_united(collection):
    cat = lambda values, **kw: frame(pd.Categorical(values, **kw))
    collection.write("x", cat(["a", "b"]))
    more = cat(["c"])
    more.index = pd.Index([7], name="k")
    collection.append("x", more)
    got = collection.item("x").to_pandas()["v"]
    assert got.tolist() == ["a", "b", "c"] and got.cat.categories.tolist() == ["a", "b", "c"]
    collection.write("o", cat(["lo", "hi"], categories=["lo", "hi"], ordered=True))
    with pytest.raises(ts.ValidationError, match="ordered"):
        collection.append("o", cat(["top"], categories=["top"], ordered=True))


def test_replaced_rows_keep_the_defaults(collection):
    collection.write("x", frame([1, 2, 3], column="a"))
    collection.enable_schema_evolution("x", ts.EvolutionStrategy.ADD_ONLY)
    collection.append("x", pd.DataFrame({"a": [30], "b": [0.5]}, index=pd.Index([2], name="k")))
    assert collection.item("x").to_pandas()["b"].tolist() == [0.0, 0.0, 0.5]


def test_a_segment_of_which_nothing_is_left(collection, spark):
    collection.write("x", spark.createDataFrame([(k, 1) for k in range(5)], "k int, v int"), index=["k"])
    for v in (2, 3):
        collection.append("x", spark.createDataFrame([(k, v) for k in range(3, 9)], "k int, v int"))
    assert collection.item("x").to_pandas()["v"].tolist() == [1, 1, 1, 3, 3, 3, 3, 3, 3]


def test_only_files_that_hold_replaced_keys_are_rewritten(collection):
    collection.write("x", frame(list(range(1000))), npartitions=10)
    before = collection._manifest_of("x")["segments"]
    collection.append("x", frame([-1, -2, -3], 998))
    base, rewritten, new = collection._manifest_of("x")["segments"]
    assert base["path"] == before[0]["path"] and len(base["without"]) == 1 and rewritten["rows"] < 200 and new["rows"] == 3
    assert collection.item("x").to_pandas()["v"].tolist() == [*range(998), -1, -2, -3]
    collection.create_snapshot("s")
    collection.append("x", frame([7] * 2000))  # all files of the first segment, one by one or at once
    assert collection.item("x").to_pandas()["v"].tolist() == [7] * 2000
    assert collection.item("x", snapshot="s").to_pandas()["v"].sum() == sum(range(998)) - 6


def test_many_segments_are_joined(collection, monkeypatch):
    monkeypatch.setattr("tidemark.store.catalog.MOST_SEGMENTS", 3)
    collection.write("x", frame([0]))
    for k in range(1, 6):
        collection.append("x", frame([k], k))
    assert collection.item("x").to_pandas()["v"].tolist() == list(range(6))
    assert len(collection._manifest_of("x")["segments"]) <= 4


def test_metadata_can_be_changed(collection):
    collection.write("x", frame([1]), metadata={"a": 1})
    collection.write_metadata("x", {"b": 2})
    assert collection.read_metadata("x")["b"] == 2 and "a" not in collection.read_metadata("x")
    assert collection.item("x").to_pandas()["v"].tolist() == [1]


def test_bounds_of_instants():
    utc, us = pd.Timestamp("2024-01-01 02:00", tz="UTC"), 1_704_074_400_000_000
    low, high = {"us": us - 7_200_000_000, "zoned": True}, {"us": us + 3_600_000_000, "zoned": True}
    assert may_match([("k", ">=", utc)], "k", low, high) and not may_match([("k", ">", pd.Timestamp(us + 3_600_000_000, unit="us", tz="Asia/Tokyo"))], "k", low, high)
    assert may_match([("k", ">", utc.tz_localize(None))], "k", low, high)  # another kind: nothing is left out


ZONED = """
import sys, pandas as pd
from tidemark import store as ts
from tidemark.session import session
s = session("local[1]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"})
ts.set_path(sys.argv[1]); ts.set_client(s)
c = ts.store("zones").collection("c")
c.write("x", pd.DataFrame({"v": range(4)}, index=pd.date_range("2024-01-01", periods=4, freq="h", tz="UTC", name="t")))
print([len(c.item("x", filters=[("t", op, pd.Timestamp("2024-01-01 02:00", tz="UTC"))]).to_pandas()) for op in (">=", "<", "==", ">")])
"""
APPEND = """
import sys, pandas as pd
from tidemark import store as ts
from tidemark.session import session
s = session("local[1]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1"})
ts.set_path(sys.argv[1]); ts.set_client(s)
c = ts.store("test").collection("c")
for k in range(3):
    c.append("x", pd.DataFrame({"v": [1]}, index=pd.Index([int(sys.argv[2]) * 100 + k], name="k")))
"""


def start(code, *args, **env):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return subprocess.Popen([sys.executable, "-c", code, *map(str, args)], env=os.environ | {"PYTHONPATH": root} | env, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)


def test_zones_of_the_driver_dont_matter(tmp_path):
    jobs = [start(ZONED, tmp_path / str(k), TZ=zone) for k, zone in enumerate(("America/New_York", "Asia/Tokyo"))]
    for job in jobs:
        out, err = job.communicate(timeout=240)
        assert out.strip().endswith("[2, 2, 1, 1]"), err[-800:]


def test_two_processes_lose_nothing(collection):
    collection.write("x", frame([1]))
    jobs = [start(APPEND, ts.get_path(), k) for k in (1, 2)]
    for job in jobs:
        assert job.wait(240) == 0, job.stderr.read()[-800:]
    assert sorted(collection.item("x").to_pandas().index) == [0, 100, 101, 102, 200, 201, 202]


def test_a_change_built_on_an_old_version_is_refused(collection):
    collection.write("x", frame([1]))
    old = collection._manifest_of("x")
    collection.append("x", frame([2], 1))
    with pytest.raises(ts.StorageError, match="changed by another process"):
        collection._publish({"x": dict(old, version=9)})


def test_only_what_is_still_based_on_the_present_is_rolled_forward(collection, spark):
    collection.write("x", frame([1]))
    collection.write("y", frame([1]))
    x, y = collection._manifest_of("x"), collection._manifest_of("y")
    collection.append("y", frame([2], 1))
    record = collection.root / RECORDS / "half.json"
    record.parent.mkdir(exist_ok=True)
    record.write_text(json.dumps({"bases": {"x": x["token"], "y": y["token"]}, "changes": {"x": dict(x, meta={"new": 1}), "y": dict(y, meta={"new": 1})}}))
    again = Collection("c", ts.store("test"))
    assert again.read_metadata("x").get("new") == 1 and "new" not in again.read_metadata("y") and not record.exists()


def test_vacuum_leaves_young_segments(collection):
    collection.write("x", frame([1]))
    collection.write("x", frame([2]), overwrite=True)
    assert collection.vacuum() == 0
    old = time.time() - 2 * 86_400
    for p in collection.root.glob("*/seg/*"):
        os.utime(p, (old, old))
    assert collection.vacuum() == 1 and collection.item("x").to_pandas()["v"].tolist() == [2]


def test_align_and_deduplicate(spark):
    naive = pd.DataFrame({"v": [1]}, index=pd.DatetimeIndex(["2024-01-01 00:00"]))
    zoned = pd.DataFrame({"v": [1]}, index=pd.DatetimeIndex(["2024-01-01 00:00"]).tz_localize("US/Eastern"))
    a, b = ts.align_timezones(naive, zoned)
    assert str(a.index.tz) == str(b.index.tz) == "UTC" and b.index[0].hour == 5
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c"), (None, 4, "d")], "k int, o int, v string")
    pick = lambda keep: {(r.k, r.v) for r in ts.deduplicate(df, ["k"], ["o"], keep).collect()}
    assert pick("first") == {(1, "a"), (None, "c")} and pick("last") == {(1, "b"), (None, "d")} and len(pick("all")) == 4


def test_logging_and_paths(tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_LOG_LEVEL", "info")
    top = ts.setup_logging()
    assert top.level == logging.INFO and len(ts.setup_logging("ERROR").handlers) == 1 and ts.get_logger("store").parent is top
    with pytest.raises(ValueError):
        ts.setup_logging("loud")
    (tmp_path / "a").mkdir()
    (tmp_path / "_snapshots").mkdir()
    assert ts.subdirs(tmp_path) == ["a"] and ts.path_exists(ts.make_path(tmp_path, "a"))
    top.handlers, top.propagate = [], True


def test_time_ranges_of_pandas(spark):
    pdf = pd.DataFrame({"v": range(400)}, index=pd.date_range("2024-01-01", periods=400, name="t"))
    assert ts.optimize_time_series_partitions(pdf).count() == 400
    with pytest.raises(ts.ValidationError):
        ts.optimize_time_series_partitions(pd.DataFrame({"v": [1]}))
    floats = pd.DataFrame({"v": [0.1 * k for k in range(4000)]})
    assert ts.optimize_dataframe_memory(floats, deep=False)["v"].equals(floats["v"])
