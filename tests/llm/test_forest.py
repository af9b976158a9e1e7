"""The forest against brute force: notations, copies, near-duplicates, chains, hot groups, batches."""

import random

import pytest

from tidemark.llm import forest


def brute(sets: dict[int, tuple[int, frozenset]]) -> set[tuple[int, int]]:
    accepted, pairs = [], set()
    for b in sorted(sets):
        batch, s = sets[b]
        found = [a for a in accepted if sets[a][0] <= batch and s and 5 * len(sets[a][1] & s) >= 4 * len(sets[a][1] | s)]
        pairs |= {(a, b) for a in found}
        if s and not found:
            accepted.append(b)
    return pairs


def test_notations():
    a = "index;open;high;low;close;volume\n2024-01-01T10:00:00+02:00;1.50;2;0;1e1;\n2024-01-01 09:00:00;1;2;3;4;5\n"
    b = '"Volume"\t"CLOSE"\t"Low"\t"High"\t"Open"\t"Index"\r\n"5.0"\t"4"\t"3"\t"2"\t"1"\t"2024-01-01T09:00:00Z"\r\n\r\n""\t"10"\t"-0"\t"2.0"\t"15e-1"\t"1704096000"\r\n'
    assert forest.records_of(a) == forest.records_of(b) and len(forest.records_of(a)) == 2


@pytest.mark.parametrize("payload", [None, "", "\n", "index,open\n", "   \r\n  "])
def test_no_records(payload):
    assert forest.records_of(payload) == []


def test_odd_payloads():
    assert len(forest.records_of('index,open\n"a,b",1\n"torn,2\n,,,\nx')) == 4
    assert len(forest.records_of("index\n" + "\n".join(map(str, range(5000))))) == 5000


def payload(records) -> str:
    return "index,open,high,low,close,volume\n" + "\n".join(f"{r},1,2,3,4,5" for r in records)


def test_depth():
    """The longest prefix that reaches the recall; the keys' own length under the usual parameters."""
    d = forest.depth_for()
    assert d == forest.DEPTH and 1 - (1 - 0.8**d) ** forest.TREES >= forest.RECALL
    assert forest.depth_for(share=(7, 10)) == 2 and forest.depth_for(share=(6, 10)) == 1
    with pytest.raises(ValueError):
        forest.depth_for(share=(1, 10))


@pytest.mark.parametrize("small, edges", [(64, 1 << 20), (2, 1 << 20), (64, 0)])
def test_against_brute_force(spark, monkeypatch, small, edges):
    """With small = 2 every range of three is a hot one, so that the rounds of leaders do the work; with no edges
    allowed in one task, the rounds of decisions do."""
    monkeypatch.setattr(forest, "SMALL", small)
    monkeypatch.setattr(forest, "EDGES", edges)
    rng = random.Random(11)
    bases = [rng.sample(range(100_000), 20) for _ in range(12)]
    sets, rows = {}, []
    for k in range(1, 121):
        base = list(bases[0] if k % 3 == 0 else rng.choice(bases))  # one group has a third of all
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            base[rng.randrange(20)] = rng.randrange(100_000)
        if k % 17 == 0:
            base = []
        sets[k] = (0 if k <= 60 else 1 + k // 100, frozenset(base))
        rows.append((k, sets[k][0], payload(base) if base else rng.choice([None, "", "index,open"]), 1))
    df = spark.createDataFrame(rows, "append_id bigint, batch_no int, payload string, n int")
    got = {(r.append_a, r.append_b) for r in forest.found(df).collect()}
    assert got == brute(sets)


def test_empty_and_again(spark):
    df = spark.createDataFrame([], "append_id bigint, batch_no int, payload string")
    assert forest.found(df).count() == 0
    one = spark.createDataFrame([(1, 0, payload([1, 2, 3])), (2, 0, payload([3, 2, 1])), (3, None, payload([1])), (None, 0, payload([1]))], df.schema)
    made = forest.Forest(spark)
    sets = forest.record_sets(one.where("append_id < 3"))
    first = made.add(sets, "b0").collect()
    assert [tuple(r) for r in first] == [(1, 2)]
    assert made.add(sets, "b0").collect() == first and len(made.runs) == 1
    again = forest.Forest(spark, made.at.path)
    more = forest.record_sets(spark.createDataFrame([(9, 1, payload([1, 2, 3]))], df.schema))
    assert [tuple(r) for r in again.add(more, "b1").collect()] == [(1, 9)]


def test_a_range_that_is_hot_in_the_history(spark):
    """A third of the history shares most of its records, not enough to be duplicates: its ranges are hot ones.  A
    batch that comes later is searched there, and only row groups that hold its prefixes are read."""
    rng = random.Random(3)
    base = list(range(14))
    sets, rows = {}, []
    for k in range(1, 201):
        s = base + rng.sample(range(1000, 10**6), 6) if k % 3 == 0 else rng.sample(range(10**6, 10**8), 20)
        sets[k] = (0, frozenset(s))
        rows.append((k, 0, payload(s)))
    for k, copied in ((201, 3), (202, 4), (203, None)):
        s = list(sets[copied][1])[:-1] + [7] if copied else base + [-1, -2, -3, -4, -5, -6]
        sets[k] = (1, frozenset(s))
        rows.append((k, 1, payload(s)))
    got = {(r.append_a, r.append_b) for r in forest.found(spark.createDataFrame(rows, "append_id bigint, batch_no int, payload string")).collect()}
    assert got == brute(sets) and len(got) >= 2


def test_search_reads_what_it_needs(tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemark.llm.sorted_files import SortedFiles

    keys = np.sort(np.random.default_rng(1).integers(0, 5000, 20_000))
    keys[7000:12_000] = keys[7000]  # one value over two files and many row groups
    for k in range(4):
        part = keys[k * 5000 : k * 5000 + 5000]
        pq.write_table(pa.table({"key": part, "place": np.arange(k * 5000, k * 5000 + 5000)}), tmp_path / f"part-{k}.parquet", row_group_size=100)
    files = SortedFiles([f"file:{tmp_path}/part-{k}.parquet" for k in range(4)], "key")
    for low, high in (([0], [9999]), ([5, 40], [5, 41]), ([int(keys[7000])], [int(keys[7000])]), ([-5, 4999], [-1, 6000]), ([6000], [7000])):
        low, high, got, groups = np.array(low), np.array(high), set(), 0
        for part, table in files.pieces(low, high, ["key", "place"]):
            groups += 1
            key, place = table.column("key").to_numpy(), table.column("place").to_numpy()
            for a, b in zip(low[part], high[part]):
                got |= set(place[(key >= a) & (key <= b)].tolist())
        wanted = {p for a, b in zip(low, high) for p in np.flatnonzero((keys >= a) & (keys <= b)).tolist()}
        assert got == wanted and groups <= len(wanted) // 50 + 4
