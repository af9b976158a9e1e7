"""Encoding of whole columns of text with a public byte-level BPE vocabulary.

Method: forced-boundary splitting.  A pair of bytes that stands side by side
inside no vocabulary entry can never be merged, so the place between the two
is a *certain cut*: what lies left and right of it is encoded independently
and the results are concatenated.  Certain cuts are found for a whole buffer
of texts by table look-ups in numpy; the fragments between them are short and
repeat a lot, so each distinct one is encoded once per worker and looked up
from then on.

The vocabulary is applied after a pre-tokenizer, so a cut must not change what
that sees.  A pair is therefore never a cut

* after white space (a run of it is divided by what follows the run),
* before an apostrophe (which may begin a contraction), or
* inside a character.

Everywhere else the pre-tokenizer either has a boundary there anyway or is in
the middle of a run of one class, whose two parts it divides in the same way.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that are cut and looked up at once, whatever the size of a batch or of one text.
WINDOW = 2 << 20
#: Slots of a worker's table of fragments, and ids and long fragments that it remembers before it starts anew.
SLOTS, POOL, LONG = 1 << 18, 4_000_000, 100_000


def default_vocabulary() -> str:
    """The path of byte_bpe_50k where the public tokenizers are installed; any other path may be passed instead."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Fragments:
    """Fragment -> ids, for whole arrays of fragments.

    Fragments of up to 16 bytes are two integers; they are looked up in a
    table with one slot for each hash value, in numpy.  What isn't found there
    is encoded once for each distinct fragment and put into its slot.  The
    ids lie in one pool.  Longer fragments, and those with a byte 0 (which
    also fills up short ones), go through a dictionary.  Both are bounded.
    """

    def __init__(self, encode):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used, self.long = np.empty(1 << 16, np.int32), 0, {}

    def _add(self, fragment: bytes) -> tuple[int, int]:
        ids = self.encode(fragment.decode("utf-8"))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids), len(ids)

    def ids(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments of ``raw`` between consecutive ``ends``, one after another, and their numbers."""
        if self.used > POOL or len(self.long) > LONG:
            self._clear()
        starts, lengths = ends[:-1], np.diff(ends)
        padded = raw + bytes(16)
        words = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
        low, high = words[starts] & _MASKS[np.minimum(lengths, 8)], words[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 8)]
        slot = ((low * _MIX[0] ^ high * _MIX[1]) * _MIX[2] >> np.uint64(46)).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        other = lengths > 16
        if 0 in raw:
            zeros = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) == 0)))
            other |= zeros[ends[1:]] > zeros[starts]
        new = np.flatnonzero(~other & ((self.low[slot] != low) | (self.high[slot] != high)))
        if len(new):
            both = np.empty(len(new), [("low", "u8"), ("high", "u8")])
            both["low"], both["high"] = low[new], high[new]
            _, first, which = np.unique(both, return_index=True, return_inverse=True)
            fresh = np.array([self._add(raw[starts[k] : ends[k + 1]]) for k in new[first]], np.int64)
            at[new], n[new] = fresh[which, 0], fresh[which, 1]
            k = new[first]
            self.low[slot[k]], self.high[slot[k]] = low[k], high[k]
            # of several fragments with one slot the last one stays, whole
            self.at[slot[k]], self.n[slot[k]] = at[k], n[k]
        for k in np.flatnonzero(other):
            fragment = raw[starts[k] : ends[k + 1]]
            if (known := self.long.get(fragment)) is None:
                known = self._add(fragment)
                if len(fragment) <= 1024:
                    self.long[fragment] = known
            at[k], n[k] = known
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        return self.pool[np.repeat(at - (upto - n), n) + np.arange(total)], n


#: By length in bytes: the mask of a little-endian word's first bytes.  And odd multipliers of a hash.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def certain_cuts(tokens) -> np.ndarray:
    """65,536 flags by (left byte << 8 | right byte): true where the place between them is a certain cut."""
    table = np.ones((256, 256), bool)
    for token in tokens:
        if len(token) > 1:
            codes = np.frombuffer(token, np.uint8)
            table[codes[:-1], codes[1:]] = False
    table[:0x21] = False
    table[:, 0x27] = False
    table[:, 0x80:0xC0] = False
    return table.ravel()


def _white_tails() -> np.ndarray:
    """Flags by the last two bytes of a character beyond ASCII: true where it may be white space."""
    table = np.zeros((256, 256), bool)
    # The characters of Unicode's property White_Space beyond ASCII, and U+200B.
    for code in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        tail = chr(code).encode()[-2:]
        table[tail[0], tail[1]] = True
    return table.ravel()


class Encoder:
    """A byte-level BPE vocabulary with its pre-tokenizer."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        plain = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.known = Fragments(plain.encode_ordinary)
        self.cut_after = certain_cuts(self.ranks)
        self.white_tail = _white_tails()
        self.token_bytes = np.zeros(max(self.ranks.values()) + 1, np.int32)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = len(token)

    def cuts(self, raw: bytes, edges=()) -> np.ndarray:
        """0, the certain cuts inside ``raw`` and the given edges, and its length, ascending."""
        flags = np.zeros(len(raw) + 1, bool)
        for start in range(0, len(raw), WINDOW):
            # from two bytes before, which tell what the first places follow
            at = max(0, start - 2)
            codes = np.frombuffer(raw, np.uint8, min(start + WINDOW + 1, len(raw)) - at, at).astype(np.uint16)
            pair = codes[:-1] << 8 | codes[1:]
            cut = self.cut_after[pair]
            if codes.max(initial=0) >= 0x80:
                cut[1:] &= ~self.white_tail[pair[:-1]]
            flags[start + 1 : at + 1 + len(cut)] = cut[start - at :]
        flags[np.asarray(edges, np.int64)] = True
        flags[[0, len(raw)]] = True
        return np.flatnonzero(flags)

    def encode_all(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these texts in UTF-8, one after another, and the number of ids of each."""
        raw = b"".join(held)
        if not raw:
            return np.empty(0, np.int32), np.zeros(len(held), np.int64)
        edges = np.cumsum([len(x) for x in held])
        ends = self.cuts(raw, edges)
        parts, counts = [], [np.zeros(1, np.int64)]
        # in steps, so that one long text needs no more memory than many short ones
        steps = np.searchsorted(ends, np.arange(0, len(raw), WINDOW), "right") - 1
        for a, b in zip(steps, [*steps[1:], len(ends) - 1]):
            if b > a:
                ids, n = self.known.ids(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                parts.append(ids)
                counts.append(n)
        upto = np.cumsum(np.concatenate(counts))[np.searchsorted(ends, np.concatenate(([0], edges)))]
        return np.concatenate(parts), np.diff(upto)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([(text or "").encode()])[0]

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        """For runs of texts of about WINDOW bytes: the number of the first, the ids of all, the number of ids of
        each, and each text's bytes.  Null and empty texts have no ids."""
        first, held, size = 0, [], 0
        for k, raw in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            held.append(raw or b"")
            size += len(raw or b"")
            if size >= WINDOW or len(held) >= 100_000:
                yield first, *self.encode_all(held), held
                first, held, size = k + 1, [], 0
        if held:
            yield first, *self.encode_all(held), held


@lru_cache(2)
def _encoder(vocabulary: bytes, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


class Vocabulary:
    """A vocabulary file, read by the driver and sent to the executors (0.9 MB; its size is that of the file and
    does not depend on the data).  Workers build one encoder for all their tasks."""

    LIMIT = 64 << 20

    def __init__(self, spark, path: str | None = None, pattern: str = PATTERN):
        with open(path or default_vocabulary(), "rb") as file:
            raw = file.read(self.LIMIT + 1)
        if len(raw) > self.LIMIT:
            raise ValueError("a vocabulary of more than 64 MB")
        self.name = hashlib.sha1(raw).hexdigest()
        self.sent = spark.sparkContext.broadcast(raw)
        self.pattern = pattern

    def encoder(self) -> Encoder:
        return _encoder(self.sent.value, self.pattern)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (a list of integers), one row for each row of ``df``.

    Null and empty texts give an empty list; strings of special tokens are
    ordinary text; repeated rows and null ids come out as often as they go in;
    other columns are left unread.  No shuffle: a projection of the scan.
    """
    known = Vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = known.encoder()
        for batch in batches:
            for first, ids, counts, _ in encoder.encode_column(batch.column(1)):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), lists], [id_col, "ids"])

    # the id goes by another name than "ids", should it be called so
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def task_number() -> int:
    return TaskContext.get().partitionId()
