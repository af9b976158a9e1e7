"""Filling containers of fixed capacity with items of varying length.

Method: minimum bin slack.  The lengths of all items are counted; since a
length is an integer of at most the capacity, this histogram has at most
``capacity`` rows whatever the number of items, and the driver plans on it
alone.  Each step opens a bin with the longest length that is left, and a
subset-sum dynamic program over the other lengths, with sets of reachable
sums as bits of one integer, finds the fullest feasible combination.  It's
used as often as the counts allow at once: the same combination stays the
fullest one while all its items last, because what is feasible only shrinks.
So the number of steps depends on the number of distinct lengths, not items.

The plan says of each length which ranks go to which bins.  Items get their
rank within their length without gathering a length in one place: a task
numbers its own items of each length, and the tasks' counts are summed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Scratch
from .bpe import Vocabulary, task_number
from .sorted_files import SortedFiles

CAPACITY = 4096


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (no more of each than ``counts`` says) with the largest sum of at most ``room``.

    Ties go to longer items.  The sums reachable after each length are kept,
    to walk back from the best one.
    """
    if room <= 0:
        return {}
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... and the rest of this length: all multiplicities
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rows (length, first rank, items of this length in a bin, first bin), by length and first rank, and the number
    of bins.  From its first rank on, up to that of the length's next row, each bin takes so many items."""
    counts = {k: v for k, v in counts.items() if k > 0 and v > 0}
    if any(k > capacity for k in counts):
        raise ValueError("an item exceeds the capacity")
    rows, used, bins = [], dict.fromkeys(counts, 0), 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = fullest(counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            rows.append((length, used[length], n, bins))
            used[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        bins += times
    return sorted(rows), bins


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The items of each text: ``id_col, piece_no, token_start, n_tokens, task, nth``.

    A text of more than ``capacity`` tokens gives pieces of ``capacity`` tokens
    and one of the rest; any other text, also a null or empty one (of 0
    tokens), is one item.  ``nth`` numbers a task's items of each length from
    0 on, for the ranks; a task that runs again reads the same rows in the
    same order.
    """
    known = Vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece_no", "token_start", "n_tokens", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = known.encoder(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, _, counts, _ in encoder.encode_column(batch.column(1)):
                pieces = np.maximum(1, -(-counts // capacity))
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(counts[row] - piece * capacity, capacity)
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - run_start
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [piece.astype(np.int32), piece * capacity, length.astype(np.int32), np.full(len(row), task_number(), np.int32), nth]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), *map(pa.array, columns)], names)

    schema = f"`{id_col}` {kind}, piece_no int, token_start bigint, n_tokens int, task int, nth bigint"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Each text, or each piece of one that alone exceeds the capacity, with the container it goes to:
    ``id_col, piece_no, token_start, n_tokens, container_id``.

    Containers are numbered from 0 and hold at most ``capacity`` tokens.  Null
    and empty texts need no room and are spread over all containers (all to 0
    if there are no others).  Repeated rows and null ids are items of their
    own; further columns are left unread.  The texts are read and encoded
    once; what the plan and the ranks need is written to the shared folder.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    items = scratch.write(measure(df, id_col, text_col, capacity, vocabulary), "items")
    per_task = items.groupBy("n_tokens", "task").agg(F.count("*").alias("n"))
    # at most capacity + 1 rows come to the driver
    counts = {r.n_tokens: r.n for r in per_task.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    rows, bins = plan({k: v for k, v in counts.items() if k}, capacity)

    before = Window.partitionBy("n_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("n_tokens", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # tasks x lengths rows, which grow with the data: neither joined nor sent, each task looks up those that it meets
    scratch.write_sorted(offsets, "offsets", ["task", "n_tokens"])
    paths = scratch.files("offsets")

    # the plan has one row for each length of each combination: bounded by the capacity, not by the items
    table = np.array(rows or [(0, 0, 1, 0)], np.int64)
    sent = spark.sparkContext.broadcast(table)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece_no", "token_start", "n_tokens", "container_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, many, starts = sent.value.T
        files, held = SortedFiles(paths, "task"), {}
        for batch in batches:
            length, task, nth = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            rank = nth.copy()
            for t in np.unique(task):
                if t not in held:
                    held = {t: _offsets_of(files, t, capacity)}  # rows come task by task, mostly
                own = task == t
                rank[own] += held[t][length[own]]
            k = _last_not_after(lengths, firsts, length.astype(np.int64), rank)
            bin_ = np.where(length > 0, starts[k] + (rank - firsts[k]) // many[k], rank % max(bins, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bin_.astype(np.int64))], names)

    return items.mapInArrow(place, f"`{id_col}` {kind}, piece_no int, token_start bigint, n_tokens int, container_id bigint")


def _offsets_of(files: SortedFiles, task: int, capacity: int) -> np.ndarray:
    """How many items of each length the tasks before this one have."""
    found, wanted = np.zeros(capacity + 1, np.int64), np.array([task], np.int64)
    for _, table in files.pieces(wanted, wanted, ["task", "n_tokens", "offset"]):
        tasks, lengths, offsets = (table.column(k).to_numpy() for k in range(3))
        found[lengths[tasks == task]] = offsets[tasks == task]
    return found


def _last_not_after(lengths: np.ndarray, firsts: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By length: the last of the plan's rows (sorted by length and first rank) that begins at or before the rank."""
    k = np.zeros(len(length), np.int64)
    for value in np.unique(length[length > 0]):
        own = length == value
        a, b = np.searchsorted(lengths, [value, value + 1])
        k[own] = a + np.searchsorted(firsts[a:b], rank[own], "right") - 1
    return k
