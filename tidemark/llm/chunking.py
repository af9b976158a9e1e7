"""Splitting oversized texts into overlapping pieces at natural boundaries.

Method: content-defined chunking.  A rolling hash over the last tokens gives
each position a value; of the positions between the least and the greatest
size of a piece, the one with the largest value is the landmark, and the cut
snaps to the natural boundary nearest to it: of the strongest kind that there
is between the two sizes (file, hunk, paragraph, line, word), else to the
landmark itself.  Where a cut falls depends on the text around it only, so an
edit alters the pieces next to it and the cuts further on fall back into place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary

LIMIT, OVERLAP, LEAST = 1024, 64, 256
#: Kinds of cut by strength.  "forced" is a cut inside a word, where nothing better was in reach.
KINDS = ["forced", "word", "line", "paragraph", "hunk", "file"]
#: Tokens that the rolling hash covers.
SPAN = 8
#: What a line must begin with to begin a file or a hunk of an exported commit.
FILE_STARTS, HUNK_STARTS = (b"diff --", b"Index: "), (b"@@",)


_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\r\n\x0b\x0c")] = True


def _strengths(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The strength of a cut before each of the byte positions ``at`` (0 < at < len(raw)); -1 inside a character."""
    codes = np.frombuffer(raw, np.uint8)
    left, right = codes[at - 1], codes[at]
    strength = (_WHITE[left] != _WHITE[right]).astype(np.int8)
    strength[(right & 0xC0) == 0x80] = -1
    # a line begins after LF, or after CR without LF
    for k in np.flatnonzero((left == 10) | ((left == 13) & (right != 10))):
        place = int(at[k])
        if raw.startswith(FILE_STARTS, place):
            strength[k] = 5
        elif raw.startswith(HUNK_STARTS, place):
            strength[k] = 4
        elif right[k] not in (10, 13) and raw[max(0, place - 3) : place].endswith((b"\n\n", b"\n\r\n", b"\r\r")):
            strength[k] = 3
        else:
            strength[k] = 2
    return strength


#: A multiplier of the rolling hash for each of the SPAN places: odd powers of one odd number.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SPAN)], np.uint64)


def _values(ids: np.ndarray) -> np.ndarray:
    """The rolling hash before each token: of the SPAN tokens before it (fewer at the start)."""
    total = np.zeros(len(ids) + 1, np.uint64)
    for back, factor in enumerate(_FACTORS, 1):
        total[back:] += (ids[: len(ids) + 1 - back].astype(np.uint64) + np.uint64(1)) * factor
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x94D049BB133111EB)
    return total ^ total >> np.uint64(29)


def cut_tokens(raw: bytes, ids: np.ndarray, ends: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(first token, end token, strength of the cut at its end) of each piece; ``ends`` has the tokens' ends in bytes.

    The part of a piece that is new, without the overlap, has ``least`` to
    ``limit - overlap - 3`` tokens (the last one may have fewer): the overlap
    grows by up to 3 tokens where it would begin inside a character.  In runs
    of characters that take several tokens each the same holds for the cuts.
    """
    n, most = len(ids), limit - overlap - 3
    strength = np.empty(n + 1, np.int8)
    strength[0] = strength[n] = 5
    strength[1:n] = _strengths(raw, ends[: n - 1])
    values = _values(ids)
    pieces, start, cut = [], 0, 0
    while n - cut > most:
        a, b = cut + min(least, most), cut + most + 1
        window, kinds = values[a:b], strength[a:b]
        best = kinds.max()
        landmark = int(np.argmax(np.where(kinds >= 0, window, 0)))
        if best > 0:
            places = np.flatnonzero(kinds == best)
            landmark = int(places[np.argmin(np.abs(places - landmark))])
        end = a + landmark
        pieces.append((start, end, int(max(best, 0))))
        cut, start = end, end - overlap
        while strength[start] < 0:
            start -= 1
    pieces.append((start, n, 5))
    return pieces


def split_oversized(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, keep_small: bool = False, vocabulary: str | None = None
) -> DataFrame:
    """The pieces of each text of more than ``limit`` tokens:
    ``id_col, piece_no, n_pieces, token_start, n_tokens, n_overlap, cut_at, piece``.

    ``piece`` is the text of tokens ``token_start`` to ``token_start +
    n_tokens``, of which the first ``n_overlap`` also end the piece before;
    ``cut_at`` is the kind of boundary at its end ("end" for the last one).
    With ``keep_small`` the other texts come out too, as one piece each (null
    as a null piece of 0 tokens); else they give no rows.  Repeated rows and
    null ids are split like others; further columns are left unread.  No
    shuffle: a projection of the scan, one text at a time.
    """
    if not 0 <= overlap < limit // 2 or not 0 < least <= limit - overlap - 3:
        raise ValueError("the overlap must be less than half the limit, and the least size must fit in beside it")
    known = Vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece_no", "n_pieces", "token_start", "n_tokens", "n_overlap", "cut_at", "piece"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def pieces_of(encoder: Encoder, raw: bytes, ids: np.ndarray) -> Iterator[tuple]:
        ends = np.cumsum(encoder.token_bytes[ids])
        found, done = cut_tokens(raw, ids, ends, limit, overlap, least), 0
        for k, (a, b, strength) in enumerate(found):
            text = raw[ends[a - 1] if a else 0 : ends[b - 1]].decode()
            yield k, len(found), a, b - a, done - a, KINDS[strength] if b < len(ids) else "end", text
            done = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = known.encoder()
        for batch in batches:
            for first, ids, counts, held in encoder.encode_column(batch.column(1)):
                starts, row, out = np.cumsum(counts) - counts, [], []
                for k in range(len(held)) if keep_small else np.flatnonzero(counts > limit):
                    if counts[k] > limit:
                        found = list(pieces_of(encoder, held[k], ids[starts[k] : starts[k] + counts[k]]))
                    else:
                        text = batch.column(1)[first + k].as_py()
                        found = [(0, 1, 0, int(counts[k]), 0, "end", text)]
                    out += found
                    row += [first + int(k)] * len(found)
                columns = [pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * len(types), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names)

    schema = f"`{id_col}` {kind}, piece_no int, n_pieces int, token_start bigint, n_tokens int, n_overlap int, cut_at string, piece string"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
