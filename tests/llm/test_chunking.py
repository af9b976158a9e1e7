"""Splitting: pieces put together are the text, none is too large, and an edit alters its neighbours only."""

import random

import numpy as np
import pytest

from tidemark.llm import bpe, chunking


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(bpe.default_vocabulary(), "rb").read())


def _words(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma_delta", "x1", "中文", "émile", "\U0001f600", "return", "()"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n", "\n@@ -1 +1 @@\n", "\ndiff --git a b\n"]) for _ in range(n))


def _pieces(encoder, text, **kw):
    raw, ids = text.encode(), encoder.encode(text)
    ends = np.cumsum(encoder.token_bytes[ids])
    found = chunking.cut_tokens(raw, ids, ends, **kw)
    return ids, [(a, b, raw[ends[a - 1] if a else 0 : ends[b - 1]].decode()) for a, b, _ in found]


@pytest.mark.parametrize("text", [_words(1, 4000), "x" * 20_000, "中" * 4000, "\U0001f600" * 2000, "a b " * 3000, "\n" * 9000, "é́" * 3000])
def test_whole_bounded_overlapping(encoder, text):
    ids, pieces = _pieces(encoder, text)
    done, rebuilt = 0, ""
    for a, b, piece in pieces:
        assert b - a <= 1024
        if a:
            assert 64 <= done - a <= 67
        rebuilt += encoder_text(encoder, ids, done, b, text)
        done = b
        assert len(encoder.encode(piece)) <= 1024
    assert done == len(ids) and rebuilt == text


def encoder_text(encoder, ids, a, b, text):
    ends = np.concatenate(([0], np.cumsum(encoder.token_bytes[ids])))
    return text.encode()[ends[a] : ends[b]].decode()


def test_an_edit_stays_local(encoder):
    text = _words(5, 12_000)
    at = len(text) // 2
    before, after = ({p for _, _, p in _pieces(encoder, t)[1]} for t in (text, text[:at] + " an edit " + text[at:]))
    assert len(after - before) <= 4 < len(after) // 3


def test_strong_boundaries_win(encoder):
    text = ("word " * 300 + "\n") * 2 + "diff --git a b\n" + "word " * 900
    raw, ids = text.encode(), encoder.encode(text)
    ends = np.cumsum(encoder.token_bytes[ids])
    found = chunking.cut_tokens(raw, ids, ends)
    assert chunking.KINDS[found[0][2]] == "file" and raw[ends[found[0][1] - 1] :].startswith(b"diff --git")


@pytest.mark.parametrize("text", [_words(5, 4000), "x" * 20_000, "x" * 3000 + " " + "y" * 9000, "a b " * 3000])
def test_no_stronger_boundary_was_in_reach(encoder, text):
    """A cut has the strength of the strongest boundary within the sizes; so a forced one had none at all."""
    raw, ids = text.encode(), encoder.encode(text)
    ends = np.cumsum(encoder.token_bytes[ids])
    strength = np.concatenate([[0], chunking._strengths(raw, ends[:-1])])
    cut, most = 0, chunking.LIMIT - chunking.OVERLAP - 3
    for _, end, kind in chunking.cut_tokens(raw, ids, ends)[:-1]:
        assert kind == strength[end] == strength[cut + chunking.LEAST : cut + most + 1].max()
        cut = end


def test_split_oversized(spark):
    rows = [(1, "short", 0), (2, _words(2, 3000), 0), (2, _words(2, 3000), 0), (3, None, 0), (4, "", 0), (None, _words(4, 2000), 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    got = chunking.split_oversized(df).collect()
    assert {r.doc_id for r in got} == {2, None}
    assert all(r.n_tokens <= 1024 and (r.n_overlap == 0) == (r.piece_no == 0) for r in got)
    assert sum(r.piece_no == 0 for r in got) == 3
    every = chunking.split_oversized(df, keep_small=True).where("n_pieces = 1").collect()
    assert {(r.doc_id, r.piece) for r in every} == {(1, "short"), (3, None), (4, "")}
    assert chunking.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.split_oversized(df, overlap=800)
