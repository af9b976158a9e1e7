"""Encoding: the same ids as the plain encoder's, whatever the text and wherever a window ends."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def raw():
    try:
        return open(bpe.default_vocabulary(), "rb").read()
    except OSError:
        pytest.skip("the public vocabulary isn't installed")


@pytest.fixture(scope="module")
def plain(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(raw):
    return bpe.Encoder(raw)


@pytest.mark.parametrize("text", ["", " ", "a", "it's", "!'s", "x\n\n y", "\x00a\x00", "é中\U0001f600", "a b　 c", "<|endoftext|>", "\r\n\r\n  x", "'" * 9, "0x1f_ABC"])
def test_cases(encoder, plain, text):
    assert encoder.encode(text).tolist() == plain.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ '\n\t.  　_9-é中")), max_size=60))
def test_any_text(encoder, plain, text):
    assert encoder.encode(text).tolist() == plain.encode_ordinary(text)


def test_windows_and_slots(encoder, plain, monkeypatch):
    """Windows of 50 bytes and a tiny table give the same ids."""
    monkeypatch.setattr(bpe, "WINDOW", 50)
    monkeypatch.setattr(bpe, "POOL", 100)
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab c'é中\n_9 ", k=rng.randint(0, 400))) for _ in range(100)]
    ids, counts = encoder.encode_all([t.encode() for t in texts])
    want = [plain.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


def test_very_long_text(encoder, plain):
    text = ("word, " * 1000 + "x" * 5000 + "\n") * 60
    assert np.array_equal(encoder.encode(text), plain.encode_ordinary(text))


def test_column(spark, plain, raw):
    rows = [(1, "some text", 5), (1, "some text", 5), (2, None, 5), (3, "", 5), (None, "tab\there", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode(df).collect())
    assert got == sorted((i or 0, plain.encode_ordinary(t or "")) for i, t, _ in rows)
    assert bpe.encode(df.limit(0)).count() == 0
