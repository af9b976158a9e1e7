"""Typed rows are encoded and decoded in tasks: the driver gets no rows, and batches agree on their types."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pandas.testing import assert_frame_equal
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from tidemark import store as ts
from tidemark.store import frames, memory

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def collection(spark, tmp_path):
    ts.set_path(str(tmp_path))
    ts.set_client(spark)
    return ts.store("test").collection("c")


@pytest.fixture
def driver_rows(monkeypatch):
    """The numbers of rows that came to the driver, call by call."""
    got = []
    for name in ("collect", "toPandas", "toArrow"):

        def counted(self, *args, own=getattr(DataFrame, name), **kw):
            rows = own(self, *args, **kw)
            got.append(len(rows))
            return rows

        monkeypatch.setattr(DataFrame, name, counted)
    return got


def check(spark, name, driver_rows):
    """The query gives what its SQL gives, and meanwhile only few rows came to the driver."""
    df = entry.queries()[name](spark, DATA)
    assert sum(driver_rows) < 100
    found = duckdb.sql(entry.oracle_sql()[name].replace(" events", f" '{DATA}/events.parquet'"))
    columns = list(found.columns)
    assert Counter(str(tuple(r)) for r in df.select(*columns).collect()) == Counter(str(tuple(r)) for r in found.fetchall())


def test_category_counts(spark, driver_rows):
    check(spark, "category_counts", driver_rows)


def test_interval_struct(spark, driver_rows):
    check(spark, "interval_struct", driver_rows)


def test_typed_columns(spark, driver_rows):
    check(spark, "typed_columns", driver_rows)


def test_append_category(spark, driver_rows):
    check(spark, "append_category", driver_rows)


def test_epoch_roundtrip(spark, driver_rows):
    check(spark, "epoch_roundtrip", driver_rows)


def make(t):
    """The frames' columns differ between batches in what they hold: only one has nanoseconds, some have no object."""
    return pd.DataFrame({
        "at": pd.to_datetime(t["id"] // 100, unit="ns") + pd.to_timedelta(t["id"], unit="s"),
        "took": pd.to_timedelta(t["id"].where(t["id"] > 150, 0), unit="ns") * 1000 + pd.to_timedelta((t["id"] == 170).astype("int64"), unit="ns"),
        "kind": pd.Categorical((t["id"] // 50).astype(str).where(t["id"] >= 50)),
        "when": pd.to_datetime(t["id"], unit="D").dt.to_period("M").where(t["id"] % 2 == 0),
        "nested": [{"a": int(x)} if x >= 100 else None for x in t["id"]],
        "n": t["id"].astype("float64").where(t["id"] != 3) if (t["id"] < 10).any() else t["id"],
    }).set_index(pd.Index(t["id"], name="id"))


@pytest.mark.parametrize("rows", [0, 1, 200])
def test_batches_agree(collection, spark, monkeypatch, rows):
    monkeypatch.setattr(frames, "BATCH_ROWS", 1)
    with memory.memory_efficient_read(25):
        collection.write("x", ts.Frames(spark.range(rows).repartition(3), make))
    assert len(list(collection.root.glob("x/seg/*"))) == 1  # what was written aside is gone
    got, whole = collection.item("x").to_pandas(), make(pd.DataFrame({"id": np.arange(rows)}))
    if not rows:
        assert list(got.columns) == list(whole.columns) and not len(got)
        return
    got["n"], whole["n"] = got["n"].astype("float64"), whole["n"].astype("float64")
    assert_frame_equal(got, whole)


def test_batches_that_differ_are_refused(collection, spark):
    def odd(t):
        return pd.DataFrame({"v": t["id"].astype(str) if (t["id"] < 50).all() else t["id"]})

    with pytest.raises(Exception, match="in one batch"):
        collection.write("x", ts.Frames(spark.range(0, 100, 1, 2), odd))
    assert not collection.list_items()
