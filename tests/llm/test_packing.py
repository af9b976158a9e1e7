"""Packing: whole items, no bin too full, and bins as full as exhaustive search makes them."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(0, 30))
def test_fullest(lengths, room):
    best = max(sum(c) for r in range(len(lengths) + 1) for c in itertools.combinations(lengths, r) if sum(c) <= room)
    chosen = packing.fullest(dict(Counter(lengths)), room)
    assert sum(k * n for k, n in chosen.items()) == best
    assert all(n <= Counter(lengths)[k] for k, n in chosen.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_places_every_rank_once(counts):
    rows, bins = packing.plan(counts, 50)
    load, placed = Counter(), Counter()
    for k, (length, first, many, start) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
        for rank in range(first, end):
            load[start + (rank - first) // many] += length
            placed[length] += 1
    assert placed == Counter(counts)
    assert set(load) == set(range(bins))
    assert all(x <= 50 for x in load.values())


def test_too_long_an_item_is_an_error():
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


def test_pack(spark):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 5, 5, 20, 90, 250])) for _ in range(300)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(7, None, "x"), (None, "same", "x"), (None, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string").repartition(5)
    got = packing.pack(df, capacity=100).collect()
    load, sizes = Counter(), defaultdict(int)
    for r in got:
        load[r.container_id] += r.n_tokens
        sizes[r.doc_id, r.piece_no, r.token_start] += 1
        assert r.token_start == r.piece_no * 100 and r.n_tokens <= 100
    assert max(load.values()) <= 100
    whole = Counter(r.doc_id for r in got if r.piece_no == 0)
    assert sum(whole.values()) == len(rows) and whole[None] == 2 and whole[7] == 2
    total = sum(r.n_tokens for r in got)
    assert len([c for c, n in load.items() if n]) <= total / 100 * 1.05 + 1
    # pieces of one text are full but the last
    for r in got:
        if (r.doc_id, r.piece_no + 1, r.token_start + 100) in sizes:
            assert r.n_tokens == 100


def test_nothing_to_pack(spark):
    schema = "doc_id bigint, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None), (2, "")], schema)).select("container_id").distinct().collect()[0][0] == 0
