"""The data-preparation operators against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

import datetime as dt
import json
import math
import random
from collections import defaultdict

import pytest

from tidemark.functions.normal import instant_us, json_objects, number
from tidemark.operators import compaction, drift, grid, snapdiff

UTC = dt.UTC


def us(text: str) -> int:
    at = dt.datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)


# -- notations
ISO = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "20240102T030405Z", "2024-01-02T03:04:05.123456+05:30", "2024-01-02", "20240102", "2024-01-02T03:04-05:00", "20240102T0304+0100", "1969-12-31 23:59:59.5", "2024-01-02T03:04:05+02"]
BAD = ["", "NaT", "--", "n/a", "0000-00-00", "2024-13-01", "12:00", "12:00Z", "2024", "2024-01", "2024-01-02T25:00:00Z", "x2024-01-02", "2024-01-02T03:04:05Zjunk", None]


def test_instants(spark):
    df = spark.createDataFrame([(t,) for t in ISO + BAD], "t string")
    got = {r.t: r.us for r in df.select("t", instant_us(df.t).alias("us")).collect()}
    assert {t: got[t] for t in ISO} == {t: us(t) for t in ISO}
    assert [t for t in BAD if got[t] is not None] == []


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ["1", " -2.50 ", "1e3", ".5", "5.", "NaN", "1d", "1f", "0x1", "", "1,5", None]], "t string")
    assert [r.v for r in df.select(number(df.t).alias("v")).collect()] == [1, -2.5, 1000, 0.5, 5, None, None, None, None, None, None, None]


def test_json_lines(spark):
    good = ['{"a": 1}', ' {"a": "1", "b": null} ', "{}", '{"a": {"x": [1, "],["]}}', '{"z": 5}', '\t{"a": 1}\r']
    bad = ['{"a": 1', '{"a": 1} x', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1}],[{"a":2}', '{"a":1}}', "[1]", "5", "null", "", "   ", "{'a': 1}", '{"a": NaN}', '{"a": 01}', '[{"a":1}]', None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [bool(r.n) for r in df.selectExpr("t").select(json_objects(df.t, ["a", "b"]).alias("n")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


# -- compaction
def _lines(rng, n):
    made = []
    for _ in range(n):
        k = rng.randrange(15)
        index = rng.choice([f"2024-01-01T00:00:{k:02d}", f"2024-01-01 00:00:{k:02d}.000Z", (1704067200 + k) * 1000])
        record = {"index": index, "value1": rng.choice([k, f"{k}.0", float(k)]), "category": rng.choice(["A", None])}
        if rng.random() < 0.5:
            record["value2"] = rng.choice([None, 0.0, -0.0, 1.5])
        line = json.dumps(record)
        made.append(line[: rng.randrange(len(line))] if rng.random() < 0.1 else line)
    return made


def _brute_repeats(rows):
    seen, repeats = set(), set()
    for file_id, collection, item, payload in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((payload or "").split("\n"), 1):
            try:
                r = json.loads(line)
            except ValueError:
                continue
            if not isinstance(r, dict):
                continue
            index = r.get("index")
            instant = index * 1000 if isinstance(index, int) else index if index is None else us(index)
            values = tuple(None if r.get(c) is None else float(r[c]) + 0.0 for c in ("value1", "value2"))
            key = (collection, item[2:] if item and item.startswith("__") else item, instant, values, r.get("category"))
            (repeats.add((file_id, no)) if key in seen else seen.add(key))
    return repeats, seen


def _files(seed, n):
    rng = random.Random(seed)
    items = [("c", "hot")] * 6 + [("c", "__hot"), ("c", "x"), ("d", "x"), (None, "x"), ("c", None)]
    return [(k, *rng.choice(items), rng.choice([None, "", "\n".join(_lines(rng, rng.choice([1, 1, 2, 3, 40])))])) for k in range(1, n + 1)]


FILES = "file_id bigint, collection_name string, item_name string, payload string"


@pytest.mark.parametrize("fan_in", [4, 64])
def test_compaction_keeps_each_record_once(spark, tmp_path, fan_in):
    rows = _files(7, 60)
    df = spark.createDataFrame(rows, FILES).selectExpr("*", "1 as made_at", "2 as _group", "3 as repeat")
    done = compaction.compact(df, str(tmp_path / "state"), fan_in)
    repeats, seen = _brute_repeats(rows)
    assert sorted(map(tuple, done.repeats.collect())) == sorted(repeats)
    assert done.records.count() == len(seen)
    tiers = done.runs.withColumn("tier", compaction._tier()).groupBy("collection_name", "item_name", "tier").count()
    assert max(r["count"] for r in tiers.collect()) < compaction.FEW
    journal = done.journal.collect()
    assert {r.run_no for r in journal if r.role == "input" and r.made_at == 0} == {r[0] for r in rows}
    inputs = [(r.collection_name, r.item_name, r.made_at, r.run_no) for r in journal if r.role == "input"]
    assert len(inputs) == len(set(inputs))  # nothing is merged twice
    published = compaction.publish(done, str(tmp_path / "out"))
    files = {(r.collection_name, r.item_name): r.n_files for r in compaction.layout(published).collect()}
    assert published.count() == len(seen) and set(files.values()) == {1} and len(files) == len({k[:2] for k in seen})
    # a smaller target: a large item has several files of like size; what was published before goes only after that
    hot = done.runs.where("item_name = 'hot'").selectExpr("sum(n_bytes) as n").first().n
    smaller = compaction.publish(done, str(tmp_path / "out"), target_bytes=max(1, hot // 3))
    assert smaller.count() == len(seen) and len(list((tmp_path / "out").glob("v*"))) == 1
    assert 3 <= compaction.layout(smaller).where("item_name = 'hot' and collection_name = 'c'").first().n_files <= 5


def test_a_small_file_rewrites_no_large_run(spark, tmp_path):
    line = lambda k: json.dumps({"index": k * 1000, "value1": k})
    first = [(k, "c", "x", "\n".join(line(100 * k + j) for j in range(100))) for k in range(1, 201)]
    compaction.compact(spark.createDataFrame(first, FILES), str(tmp_path / "state"))
    more = spark.createDataFrame([*first, (999, "c", "x", "\n".join([line(5), line(150), line(10**6)]))], FILES)
    done = compaction.compact(more, str(tmp_path / "state"))
    late = [r for r in done.journal.collect() if r.level == done.levels]
    # the last level took in the one new file, and read and wrote nothing else; its repeats were found all the same
    assert [(r.role, r.run_no if r.made_at == 0 else r.n_records) for r in sorted(late, key=lambda r: r.role)] == [("input", 999), ("output", 2)]
    assert {(r.file_id, r.line_no) for r in done.repeats.collect()} == {(999, 2)} and done.records.count() == 20_002
    # of the superseded levels nothing is left
    assert {p.parent.name for p in (tmp_path / "state" / "records").glob("*/_again=false")} == {str(r.made_at) for r in done.runs.collect()}


def test_one_record_in_a_third_of_all_lines(spark, tmp_path):
    same = json.dumps({"index": 0, "value1": 1})
    rows = [(k, "c", "x", "\n".join([same] * 50 + [json.dumps({"index": k, "value1": j}) for j in range(100)])) for k in range(1, 21)]
    done = compaction.compact(spark.createDataFrame(rows, FILES))
    assert done.records.count() == 20 * 100 + 1 and done.repeats.count() == 20 * 50 - 1


def test_compaction_goes_on_where_it_stopped(spark, tmp_path):
    rows, path = _files(8, 50), str(tmp_path / "state")
    compaction.compact(spark.createDataFrame(rows[:20], FILES), path, 4)
    # a level that was written but not committed is done again
    store = compaction._Store(spark, path, 4)
    spark.range(5).write.parquet(store.at.at(f"records/{store.level + 1}/_again=false"))
    all_files = spark.createDataFrame(rows, FILES)
    done = compaction.compact(all_files, path, 4)
    again = compaction.compact(all_files, path, 4)
    repeats, seen = _brute_repeats(rows)
    # across calls the first file written is the one that was taken in first
    assert done.records.count() == again.records.count() == len(seen)
    assert done.repeats.count() == again.repeats.count() == len(repeats)
    assert again.levels == done.levels


def test_compaction_of_nothing(spark):
    for rows in ([], [(1, "c", "i", None), (2, "c", "i", ""), (3, "c", "i", "torn {")]):
        done = compaction.compact(spark.createDataFrame(rows, FILES))
        assert done.repeats.count() == 0 and done.records.count() == 0
    with pytest.raises(ValueError):
        compaction.compact(spark.createDataFrame([], FILES), fan_in=1)


# -- grid
READINGS = "reading_id bigint, collection_name string, item_name string, idx_ts timestamp_ntz, idx_int bigint, idx_text string, value1 double, value string"
INFO = "collection_name string, index_dtype string, index_unit string, step_s int"


def test_grid(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows, want = [], defaultdict(dict)
    for k in range(900):
        s = rng.randrange(-5000, 200_000)
        v = rng.choice([None, math.nan, 2.0, 3.0, 5.0])
        kind = rng.choice("dit")
        bad = rng.random() < 0.05
        at = base + dt.timedelta(seconds=s)
        index = {"d": (None if bad else at, 1, "x"), "i": (at, None if bad else s * 1_000_000_000 - 7, "x"), "t": (at, 1, "n/a" if bad else at.isoformat() + "Z")}[kind]
        rows.append((k, kind, "item", *index, v, "clash"))
        if not bad and v is not None and not math.isnan(v):
            period = {"d": lambda: us(at.isoformat()) // 60_000_000, "i": lambda: (s * 1_000_000_000 - 7) // 300_000_000_000, "t": lambda: us(at.isoformat()) // 3600_000_000}[kind]()
            want[kind].setdefault(period, []).append(v)
    rows += [(1000, "unknown", "item", base, 1, "x", 1.0, ""), (1001, "d", "one", base, 1, "x", 1.0, ""), (1002, "d", "none", None, 1, "x", 1.0, ""), (1003, "nostep", "item", base, 1, "x", 1.0, ""), (1004, "d", "inf", base, 1, "x", math.inf, ""), (1005, "d", "inf", base + dt.timedelta(minutes=3), 1, "x", math.inf, "")]
    info = [("d", "datetime64[ns]", None, 60), ("i", " INT64", "ns", 300), ("t", "object", None, 3600), ("nostep", "datetime64[ns]", None, None), ("d", "datetime64[ns]", None, 60)]
    got = grid.regular_grid(spark.createDataFrame(rows, READINGS), spark.createDataFrame(info, INFO)).collect()
    by = defaultdict(dict)
    for r in got:
        assert r.period_no not in by[r.collection_name, r.item_name]
        by[r.collection_name, r.item_name][r.period_no] = r
    assert set(by) == {("d", "item"), ("i", "item"), ("t", "item"), ("d", "one"), ("d", "inf")}
    for kind, periods in want.items():
        found = by[kind, "item"]
        assert sorted(found) == list(range(min(periods), max(periods) + 1))
        for p, r in found.items():
            assert (r.origin == "observed") == (p in periods)
            if p in periods:
                assert r.value == pytest.approx(sum(periods[p]) / len(periods[p])) and r.n_readings == len(periods[p])
            else:
                assert math.isfinite(r.value)
    assert len(by["d", "one"]) == 1 and len(by["d", "inf"]) == 4


def test_grid_recovers_a_seasonal_series(spark):
    """Two harmonics and a trend with a third of the periods left out come back."""
    f = lambda p: 10 + p * 0.001 + 4 * math.sin(2 * math.pi * p * 3600 / 86_400) + math.cos(4 * math.pi * p * 3600 / 86_400)
    rng, base = random.Random(2), 470_000
    kept = [p for p in range(base, base + 800) if p in (base, base + 799) or rng.random() < 0.66]
    rows = [(p, "d", "x", dt.datetime.fromtimestamp(p * 3600, UTC).replace(tzinfo=None), None, None, f(p), "") for p in kept]
    got = grid.regular_grid(spark.createDataFrame(rows, READINGS), spark.createDataFrame([("d", "datetime64[ns]", None, 3600)], INFO)).where("origin = 'filled'").collect()
    assert len(got) == 800 - len(kept)
    assert max(abs(r.value - f(r.period_no)) for r in got) < 0.05


def test_long_gap_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 7)
    rows = [(k, "d", "x", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), None, None, 1.0, "") for k, s in enumerate([0, 1, 50, 51, 300, 302])]
    got = grid.regular_grid(spark.createDataFrame(rows, READINGS), spark.createDataFrame([("d", "datetime64[ns]", None, 1)], INFO)).collect()
    assert len(got) == len({r.period_no for r in got}) == 303


def test_grid_of_nothing(spark):
    assert grid.regular_grid(spark.createDataFrame([], READINGS), spark.createDataFrame([], INFO)).count() == 0


# -- drift
SCHEMAS = "schema_file_id bigint, collection_name string, item_name string, schema_version int, written_at timestamp_ntz, col_names array<string>, col_dtypes array<string>, index_dtype string, payload string, gone string"


def _value(text):
    try:
        return float(text) if text.strip().lower() not in ("nan", "inf", "infinity") else text
    except ValueError:
        return text


def _brute_changes(rows):
    chosen = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[3] is not None and r[5] is not None and r[1] is not None and r[2] is not None:
            chosen.setdefault((r[1], r[2], r[3]), r)
    items, found = defaultdict(list), set()
    for c, i, v in chosen:
        items[c, i].append(v)
    plain = lambda t: None if t is None else t.strip().lower()

    def cells(r):
        made = []
        for line in (r[8] or "").split("\n"):
            f = line.rstrip("\r").split(",")
            if line.strip():
                index = int(f[0]) // 1000 if plain(r[7]) == "int64" else us(f[0])
                made.append((index, dict(zip(r[5], [x or None for x in f[1:]]))))
        return made

    for (c, i), vs in items.items():
        vs.sort()
        for a, b in zip(vs, vs[1:]):
            old, new = chosen[c, i, a], chosen[c, i, b]
            had, has = dict(zip(old[5], map(plain, old[6]))), dict(zip(new[5], map(plain, new[6])))
            gone, fresh, pairs = [n for n in old[5] if n not in has], [n for n in new[5] if n not in had], set()
            for g in gone:
                for n in fresh:
                    both = [(x.get(g), y.get(n)) for ix, x in cells(old) for iy, y in cells(new) if ix == iy]
                    both = [(x, y) for x, y in both if x is not None and y is not None]
                    if len(both) >= 2 and all(_value(x) == _value(y) for x, y in both):
                        pairs.add((g, n))
            add = lambda kind, name: found.add((c, i, b, kind, name))  # noqa: B023, E731
            for _, n in pairs:
                add("column_renamed", n)
            for n in set(fresh) - {n for _, n in pairs}:
                add("column_added", n)
            for g in set(gone) - {g for g, _ in pairs}:
                add("column_removed", g)
            for g, n in pairs | {(n, n) for n in had if n in has}:
                if had[g] != has[n]:
                    add("type_changed", n)
            if [n for n in old[5] if n in has] != [n for n in new[5] if n in had]:
                add("columns_reordered", "")
            if plain(old[7]) != plain(new[7]):
                add("index_type_changed", "")
    return found


def _schema_rows():
    t = dt.datetime(2024, 1, 1)
    day = lambda k: f"2024-01-{k:02d}"
    ns = lambda k: str(us(day(k)) * 1000)
    row = lambda k, v, names, types, index, lines, item="a": (k, "c", item, v, t, names, types, index, None if lines is None else "\n".join(lines), "clash")
    return [
        row(1, 1, ["x", "y"], ["int64", "object"], "object", [f"{day(k)},{k},t{k}" for k in range(1, 6)]),
        row(2, 2, ["z", "y"], ["Float64 ", "OBJECT"], "int64", [f"{ns(k)},{k}.0,t{k}" for k in range(3, 8)]),  # x renamed z
        row(3, 4, ["y", "z", "n"], ["object", "float64", "bool"], " INT64", [f"{ns(k)},t{k},{k},True" for k in range(7, 9)]),  # one common row
        row(4, 4, ["other"], ["object"], "object", ["2024-01-01,q"]),  # the same version again
        row(5, 5, ["y"], ["category"], "int64", [f"{ns(8)},t8"]),
        row(6, 1, ["a", "b"], ["int64", "int64"], "object", [f"{day(k)},{k},{k}" for k in range(1, 4)], "b"),
        row(7, 2, ["c", "A"], ["int64", "int64"], "object", [f"{day(k)},{k},{k if k < 3 else 9}" for k in range(2, 4)], "b"),  # a and b agree with c
        row(8, None, ["c"], ["int64"], "object", None, "b"),
        row(9, 3, ["c"], ["int64"], "object", None, "b"),
        row(10, 1, ["m"], ["object"], None, [""], None),
        row(11, 7, [], [], "object", [], "b"),
    ]


def test_drift(spark):
    rows = _schema_rows()
    got = {tuple(r)[:5] for r in drift.changes(spark.createDataFrame(rows, SCHEMAS)).select("collection_name", "item_name", "schema_version", "change_type", "column_name").collect()}
    assert got == _brute_changes(rows)
    assert drift.changes(spark.createDataFrame([], SCHEMAS)).count() == 0


def test_drift_on_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/schema_files.parquet")
    names = [f.split()[0] for f in SCHEMAS.split(", ")][:-1]
    rows = [tuple(r) for r in df.select(*names).collect()]
    found = drift.changes(df).select("collection_name", "item_name", "schema_version", "change_type", "column_name").collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == _brute_changes(rows)


def test_consistent_table(spark):
    rows = _schema_rows() + [(20, "c", "t", 1, None, ["v"], ["int64"], "object", "2024-01-01,1\n2024-01-02,oops\n2024-01-03,3\n2024-01-04,", "")]
    table, failures, statistics = drift.consistent_table(spark.createDataFrame(rows, SCHEMAS))
    assert [(r.item_name, r.line_no, r.column_name, r.raw_value) for r in failures.where("item_name = 't'").collect()] == [("t", 2, "v", "oops")]
    assert [r.ints["v"] for r in table.where("item_name = 't'").orderBy("line_no").collect()] == [1, None, 3, None]
    s = statistics.where("schema_file_id = 20").first()
    assert (s.n_rows, s.n_null, s.n_int, s.n_text) == (4, 1, 2, 1)
    assert table.where("item_name = 'a' and schema_version = 1").count() == 5


def test_renamed_columns_are_one(spark):
    """a becomes b, then c, which is there still; an unrelated new name isn't taken for it."""
    day = lambda k, *v: f"2024-01-0{k}," + ",".join(map(str, v))
    rows = [
        (1, "c", "r", 1, None, ["a", "k"], ["int64", "int64"], "object", "\n".join([day(1, 1, 0), day(2, 2, 0), day(3, 3, 0)]), ""),
        (2, "c", "r", 2, None, ["b", "k"], ["int64", "int64"], "object", "\n".join([day(2, 2, 0), day(3, 3, 0), day(4, 4, 0)]), ""),
        (3, "c", "r", 3, None, ["k", "b"], ["int64", "int64"], "object", "\n".join([day(4, 0, 4), day(5, 0, 5)]), ""),
        (4, "c", "r", 5, None, ["k", "c", "z"], ["int64", "float64", "object"], "object", "\n".join([day(4, 0, "4.0", "x"), day(5, 0, "5.0", "y"), day(6, 0, "6.5", "z")]), ""),
    ]
    df = spark.createDataFrame(rows, SCHEMAS)
    table = drift.consistent_table(df)[0]
    assert {(r.schema_version, r.line_no, r.floats["c"]) for r in table.collect()} >= {(1, 1, 1.0), (1, 3, 3.0), (2, 3, 4.0), (3, 2, 5.0), (5, 3, 6.5)}
    assert all(set(r.ints) == {"k"} and set(r.floats) == {"c"} for r in table.collect())
    one = drift.item_table(df, "c", "r")
    assert dict(one.dtypes) == {"schema_version": "int", "line_no": "int", "idx_us": "bigint", "c": "double", "k": "bigint", "z": "string"}
    assert one.where("z is null").count() == 8 and one.agg({"c": "sum"}).first()[0] == 1 + 2 + 3 + 2 + 3 + 4 + 4 + 5 + 4 + 5 + 6.5


# -- snapshots
ROWS = "row_id bigint, collection_name string, snapshot_name string, item_name string, category string, idx timestamp_ntz, value1 double, value2 double, remark string, old_value1 string"


def test_snapshot_changes(spark):
    t, rng = dt.datetime(2024, 1, 1), random.Random(9)
    listed = [("c", n, t + dt.timedelta(hours=h)) for n, h in [("zz", 1), ("b", 2), ("m", 3), ("empty", 4)]] + [("d", "zz", t), ("d", "nul", None)]
    rows, content = [], defaultdict(dict)
    for c, n, _ in listed[:3] + listed[4:5] + [("c", "unlisted", None)]:
        for k in range(60):
            if rng.random() < 0.8:
                key = (rng.choice(["i", None]) if k % 9 == 0 else f"i{k % 4}", rng.choice(["A", None]) if k % 11 == 0 else "A", t + dt.timedelta(minutes=k))
                v1 = rng.choice([1.0, 1.0 + 3e-10, 0.0, -0.0, None, math.nan, 1e12, 1e12 + 1, -5e-11])
                v2, remark = rng.choice([None, 7.0]), rng.choice([None, "", "x", "x "])
                if key not in content[c, n]:
                    content[c, n][key] = (v1, v2, remark)
                    rows.append((len(rows), c, n, *key, v1, v2, remark, "clash"))
                    if k % 5 == 0:
                        rows.append((len(rows) + 1000, c, n, *key, v1, v2, remark, "clash"))
    no = lambda v: v is None or math.isnan(v)
    differ = lambda a, b: no(a) != no(b) or not no(a) and abs(a - b) > 1e-9
    want = set()
    for old, new in [("zz", "b"), ("b", "m"), ("m", "empty")]:
        a, b = content["c", old], content["c", new]
        for key in {*a, *b}:
            kind = "added" if key not in a else "removed" if key not in b else "changed" if differ(a[key][0], b[key][0]) or differ(a[key][1], b[key][1]) or a[key][2] != b[key][2] else None
            if kind:
                want.add(("c", new, *key[:2], us(key[2].isoformat()), kind))
    rng.shuffle(rows)
    got = snapdiff.changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(listed, "collection_name string, snapshot_name string, taken_at timestamp_ntz"))
    found = [tuple(r)[:6] for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_snapshot_changes_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS), spark.createDataFrame([], "collection_name string, snapshot_name string, taken_at timestamp_ntz")
    assert snapdiff.changes(*empty).count() == 0
