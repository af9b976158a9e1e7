"""The driver contract: names match, and each query gives what its SQL gives on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUICK = ["flagship", "scan_filter_dnf", "append_keep_last", "chunk_rows", "evolve_widen", "p1_found", "p2_found", "p5_found"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    df = entry.queries()[name](spark, DATA)
    found = con.sql(entry.oracle_sql()[name])
    columns = list(found.columns)
    assert sorted(columns) == sorted(df.columns)
    assert Counter(str(tuple(r)) for r in df.select(*columns).collect()) == Counter(str(tuple(r)) for r in found.fetchall())
