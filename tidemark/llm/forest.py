"""Duplicates of new batches among everything accepted before.

Method: a prefix-tree hash forest.  Of each set of records, ``TREES`` keys are
made; a key strings together ``DEPTH`` minimum hashes of its tree, so sets
that share the first ones share a prefix of the key.  What has been accepted
is kept as runs; a run is sorted by key, tree after tree, in files whose row
groups can be found by their bounds.  A batch's keys are located there by
range search: only the row groups that hold one of its prefixes are read, and
of the record sets only those of the candidates.  The prefix starts at a key's
full length and is widened until the trees together reach the recall target.
Candidates are verified exactly, by the shared records.  The entries that the
batch adds are a new run, and runs of like size are merged.  The history's
payloads are never read again.

Within a batch the order of the calls decides: exact copies are one class,
represented by the first of them, and the classes are searched in the batch
itself in the same way.  A range of over ``SMALL`` classes gives no pairs at
once; there, of the classes that are undecided yet, only those that come first
in all of their ranges are accepted and compared with the others, again and
again, until no range holds more than ``SMALL``.  What is similar to what is
known then, and it's decided in the order of the calls who is accepted.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import Scratch
from .sorted_files import SortedFiles

#: Trees, minimum hashes of a key, and bits of each: a key is one integer, the tree's number before the hashes.
TREES, DEPTH, BITS = 32, 4, 14
#: A pair of the least similarity is missed at most so often: 1 in ten million.
RECALL = 1 - 1e-7
#: Shared records of all records of a pair, as a fraction, so that it's compared exactly.
SHARE = (4, 5)
#: Classes in one range of which all pairs may be verified.
SMALL = 64
#: Similar pairs of a batch that one task may put in order (24 bytes each); more are reduced in rounds first.
EDGES = 1 << 20
#: Runs of like size that are merged into one.
MERGE = 4
#: Bytes of a row group of entries, and what a task holds at once of found pairs and of looked-up records.
GROUP_BYTES, HELD = 256 << 10, 1 << 19
FIELDS = ["open", "high", "low", "close", "volume"]

_LINE_END, _MARK = re.compile(r"\r\n|\n|\r"), re.compile(r"[,;|\t]")
_EPOCH, _NUMBER = re.compile(r"-?\d{1,13}(?:\.\d+)?", re.ASCII), re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.ASCII)
_START = datetime(1970, 1, 1, tzinfo=UTC)


def depth_for(share: tuple[int, int] = SHARE, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of the least similarity shares one in some tree as often as asked."""
    s = share[0] / share[1]
    for d in range(depth, 0, -1):
        if 1 - (1 - s**d) ** trees >= recall:
            return d
    raise ValueError("so many trees can't reach this recall")


def _instant(text: str) -> int | str:
    """Microseconds of an ISO text (UTC where it has no offset) or of epoch seconds; else the text."""
    if _EPOCH.fullmatch(text):
        return int(Decimal(text) * 1_000_000)
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return text
    passed = (at if at.tzinfo else at.replace(tzinfo=UTC)) - _START
    return (passed.days * 86_400 + passed.seconds) * 1_000_000 + passed.microseconds


def _cells(line: str, mark: str) -> list[str]:
    if '"' not in line:
        return line.split(mark)
    if line.count('"') % 2:
        return [x.strip().strip('"') for x in line.split(mark)]
    return next(csv.reader([line], delimiter=mark, skipinitialspace=True), [""])


def records_of(payload: str | None) -> list[int]:
    """The distinct records of a payload, as sorted 64-bit hashes.

    The header names the columns, in any case and order; it and the lines are
    divided by the first comma, semicolon, bar or tab in it.  Blank fields
    and absent columns are equal to each other; a field that can't be read as
    instant or number counts by its text.  Blank lines are none; null and
    empty payloads and a header alone have no records.
    """
    lines = [x for x in _LINE_END.split(payload or "") if x and not x.isspace()]
    if len(lines) < 2:
        return []
    found = _MARK.search(lines[0])
    mark = found[0] if found else ","
    names = [x.strip().lower() for x in _cells(lines[0], mark)]
    places = [names.index(x) if x in names else -1 for x in ("index", *FIELDS)]
    made = set()
    for line in lines[1:]:
        cells = _cells(line, mark)
        texts = [cells[k].strip() if 0 <= k < len(cells) else "" for k in places]
        values = [float(x) + 0.0 if _NUMBER.fullmatch(x) else x for x in texts[1:]]
        made.add(xxhash.xxh64_intdigest(repr((_instant(texts[0]), *values)).encode("utf-8", "surrogatepass")))
    return sorted(x - (1 << 64) if x >> 63 else x for x in made)


#: One odd multiplier and one offset for each minimum hash.
_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, (2, TREES * DEPTH), np.uint64)


def _keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of each set, given all sets' records in one row and their numbers, none of them 0."""
    starts = np.cumsum(counts) - counts
    keys = np.repeat(np.arange(TREES, dtype=np.int64)[None, :], len(counts), 0)
    for tree in range(TREES):
        for k in range(tree * DEPTH, tree * DEPTH + DEPTH):
            x = (flat + _SEEDS[1, k]) * (_SEEDS[0, k] | np.uint64(1))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            least = np.minimum.reduceat(x & np.uint64(0xFFFFFFFF), starts)
            keys[:, tree] = keys[:, tree] << BITS | (least & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return keys


def record_sets(calls: DataFrame) -> DataFrame:
    """``append_id, batch_no, records, keys`` of each call that has records, by :func:`records_of`; no shuffle, one
    payload at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            lists = [records_of(x.as_py()) for x in batch.column(2)]
            own = [k for k, x in enumerate(lists) if x]
            if not own:
                continue
            counts = np.array([len(lists[k]) for k in own])
            flat = np.fromiter((x for k in own for x in lists[k]), np.int64, int(counts.sum()))
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            keys = _keys(flat.view(np.uint64), counts)
            made = [pa.ListArray.from_arrays(offsets(counts), pa.array(flat)), pa.ListArray.from_arrays(offsets(np.full(len(own), TREES)), pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[:2]), *made], ["append_id", "batch_no", "records", "keys"])

    return calls.select("append_id", F.col("batch_no").cast("int"), "payload").mapInArrow(run, "append_id bigint, batch_no int, records array<bigint>, keys array<bigint>")


def _blocks(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose counts add up to no more than ``most``, or that are a single one."""
    ends, begin = np.cumsum(counts), 0
    while begin < len(counts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(begin, end)
        begin = end


def _searched(history: list[list[str]], own: list[str], widened: int, share: tuple[int, int], small: int) -> Callable:
    """The search of sorted entries (``key, id, n, last_id``): ``a, b, hist`` for each entry ``a`` of the history's
    runs or of the batch itself that shares a prefix with entry ``b`` and is of a size that allows the similarity,
    where some member of ``b`` comes later.  A range of the batch with over ``small`` entries gives ``b`` without
    ``a`` instead."""
    mask = (1 << widened) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [(SortedFiles(paths, "key"), True) for paths in history] + [(SortedFiles(own, "key"), False)]
        for batch in batches:
            order = pa.compute.sort_indices(batch.column(0))
            key, ids, n, last = (c.take(order).to_numpy() for c in batch.columns)
            low, high, hot = key & ~mask, key | mask, np.zeros(len(key), bool)
            held = []
            for files, hist in runs:
                inside = np.zeros(len(key), np.int64)
                for part, table in files.pieces(low, high, ["key", "id", "n"]):
                    near, a, na = (table.column(c).to_numpy() for c in ("key", "id", "n"))
                    begin, end = np.searchsorted(near, low[part], "left"), np.searchsorted(near, high[part], "right")
                    count = end - begin
                    inside[part] += count
                    if not hist:
                        # pairs of a hot range aren't made; what was made before its size was known is not wrong
                        hot[part] |= inside[part] > small
                        count = np.where(hot[part], 0, count)
                    for some in _blocks(count, HELD):
                        size = count[some]
                        right = np.repeat(np.arange(part.start + some.start, part.start + some.stop), size)
                        left = np.repeat(begin[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                        x, y = na[left].astype(np.int64), n[right].astype(np.int64)
                        fine = (a[left] != ids[right]) & (last[right] > a[left]) & (np.minimum(x, y) * share[1] >= np.maximum(x, y) * share[0])
                        held.append((a[left[fine]], ids[right[fine]], np.full(int(fine.sum()), hist)))
                    if sum(len(h[0]) for h in held) > HELD:
                        yield _pairs_batch(held)
                        held = []
            if hot.any():
                marked = np.unique(ids[hot])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(marked), pa.int64()), pa.array(marked), pa.array(np.zeros(len(marked), bool))], ["a", "b", "hist"])
            if held:
                yield _pairs_batch(held)

    return run


def _pairs_batch(held: list[tuple]) -> pa.RecordBatch:
    """The distinct ones of found pairs; sorted files find most repeats of a pair far apart, so these are few."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["a", "b", "hist"])


def _looked_up(runs: list[list[str]]) -> Callable:
    """Pairs sorted by ``a``, with the records of ``a`` from the sets that are sorted by ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [SortedFiles(paths, "id") for paths in runs]
        for batch in batches:
            order = pa.compute.sort_indices(batch.column(0))
            batch = batch.take(order)
            a = batch.column(0).to_numpy()
            ids, where = np.unique(a, return_index=True)
            ends = np.append(where[1:], len(a))
            for files in sets:
                for part, table in files.pieces(ids, ids, ["id", "records"]):
                    have = table.column("id").to_numpy()
                    at = np.searchsorted(have, ids[part])
                    found = (at < len(have)) & (have[np.minimum(at, len(have) - 1)] == ids[part])
                    rows, begin, end = at[found], where[part][found], ends[part][found]
                    # one row for each pair, in blocks of bounded size, however long the sets are
                    rows, pairs = np.repeat(rows, end - begin), np.concatenate([np.arange(x, y) for x, y in zip(begin, end)] or [np.zeros(0, int)])
                    lists = table.column("records").combine_chunks()
                    sizes = lists.value_lengths().to_numpy()[rows]
                    for some in _blocks(sizes, HELD):
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(pairs[some])).columns, lists.take(pa.array(rows[some]))], ["a", "b", "hist", "_ra"])

    return run


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all similar pairs (``a, b, hist``) of a batch, the classes that are refused: each is judged after those
    before it, so what it's similar to is accepted or refused by then."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("b")
    refused: set[int] = set()
    for a, b, hist in zip(*(table.column(k).to_numpy().tolist() for k in range(3))):
        if a < b and (hist or a not in refused):
            refused.add(b)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(refused), pa.int64())], ["id"])


@dataclass
class Forest:
    """An index of accepted sets under ``path`` (a folder of the session's shared folder by default)."""

    spark: SparkSession
    path: str | None = None
    share: tuple[int, int] = SHARE
    recall: float = RECALL

    def __post_init__(self):
        self.at = Scratch(self.spark, "forest", self.path)
        self.widened = BITS * (DEPTH - depth_for(self.share, self.recall))
        state = self.at.load_json("state") or {"runs": [], "batches": {}}
        self.runs, self.done = state["runs"], state["batches"]

    # -- a batch's classes and entries
    def prepare(self, sets: DataFrame) -> str:
        """Write the classes of equal sets, their members and their entries, for all batches of ``sets``
        (:func:`record_sets`) at once; the name of the folder that has them, by batch."""
        at, name = self.at, f"batches/{uuid.uuid4().hex}"
        print_ = [F.xxhash64("records").alias("x"), F.xxhash64(F.lit(17), F.reverse("records")).alias("y")]
        held = at.write(sets.where("append_id is not null and batch_no is not null and size(records) > 0").withColumns({"x": print_[0], "y": print_[1]}), f"{name}/input")
        # copies of a set shrink to one row before they are shuffled
        classes = held.groupBy("batch_no", "x", "y").agg(F.min("append_id").alias("id"), F.max("append_id").alias("last_id"), F.first("records").alias("records"), F.first("keys").alias("keys"))
        at.write_sorted(classes, f"{name}/classes", ["id"], "batch_no")
        at.write(held.select("append_id", "batch_no", "x", "y"), f"{name}/members")
        if at.folders(f"{name}/classes"):
            kept = at.read(f"{name}/classes", classes.schema)
            rows = kept.select("batch_no", F.explode("keys").alias("key"), "id", F.size("records").alias("n"), "last_id")
            at.write_sorted(rows, f"{name}/entries", ["key", "id"], "batch_no", block_bytes=GROUP_BYTES)
        at.drop(f"{name}/input")
        return name

    def _classes(self, folder: str) -> DataFrame:
        return self.at.read(f"{folder.replace('*', 'classes')}", "x bigint, y bigint, id bigint, last_id bigint, records array<bigint>")

    def _verified(self, pairs: DataFrame, left: list[str], folder: str) -> DataFrame:
        """``a, b, b_last, hist`` of the candidate pairs that are similar: their sets are compared whole.  Those of
        ``a`` are looked up in the tables ``left``, those of ``b`` joined."""
        look = _looked_up([self.at.files(x) for x in left])
        known = pairs.repartitionByRange("a", "b").sortWithinPartitions("a").mapInArrow(look, "a bigint, b bigint, hist boolean, _ra array<bigint>")
        own = self._classes(folder).select(F.col("id").alias("b"), F.col("records").alias("_rb"), F.col("last_id").alias("b_last"))
        shared = F.size(F.array_intersect("_ra", "_rb"))
        similar = shared * self.share[1] >= (F.size("_ra") + F.size("_rb") - shared) * self.share[0]
        return known.join(own, "b").where(similar).select("a", "b", "b_last", "hist")

    def _hot(self, rows: DataFrame, similar: DataFrame, folder: str, work: str) -> list[DataFrame]:
        """Tables of the similar pairs of ranges with many classes, as far as they're needed: see the module's text."""
        rows = rows.withColumn("_range", F.shiftright("key", self.widened))
        rejected = similar.where("hist and a < b").select(F.col("b").alias("id")).distinct()
        accepted, found, turn, tables = rejected.limit(0), [], 0, [folder.replace("*", "classes")]

        def pairs(left: DataFrame) -> DataFrame:
            a = left.select("_range", F.col("id").alias("a"), F.col("n").alias("_na"))
            b = rows.select("_range", F.col("id").alias("b"), F.col("n").alias("_nb"), "last_id")
            near = F.least("_na", "_nb") * self.share[1] >= F.greatest("_na", "_nb") * self.share[0]
            both = a.join(b, "_range").where((F.col("a") != F.col("b")) & (F.col("last_id") > F.col("a")) & near)
            # written before they're ordered for the look-up: that needs them twice
            return self.at.write(both.select("a", "b", F.lit(False).alias("hist")).distinct(), f"{work}/pairs-{turn}")

        while True:
            open_ = rows.join(rejected.unionByName(accepted), "id", "left_anti")
            sizes = open_.groupBy("_range").agg(F.min("id").alias("_first"), F.count("*").alias("_m"))
            if (sizes.agg(F.max("_m").alias("m")).first().m or 0) <= SMALL:
                return [*found, self.at.write(self._verified(pairs(open_), tables, folder), f"{work}/near")]
            turn += 1
            firsts = self.at.write(sizes.select("_range", "_first"), f"{work}/firsts-{turn}")
            leads = open_.join(firsts, "_range").groupBy("id").agg(F.every(F.col("id") == F.col("_first")).alias("_leads")).where("_leads").select("id")
            leads = self.at.write(leads, f"{work}/leads-{turn}")
            more = self.at.write(self._verified(pairs(rows.join(leads, "id", "left_semi")), tables, folder), f"{work}/near-{turn}")
            found.append(more)
            rejected = self.at.write(rejected.unionByName(more.where("a < b").select(F.col("b").alias("id"))).distinct(), f"{work}/rejected-{turn}")
            accepted = self.at.write(accepted.unionByName(leads), f"{work}/accepted-{turn}")

    def _counted(self, df: DataFrame, name: str, count=None) -> tuple[DataFrame, int]:
        """A table written, and how many rows it has, or of them those that fulfil a condition."""
        seen = Observation()
        made = self.at.write(df.observe(seen, (F.count("*") if count is None else F.count_if(count)).alias("n")), name)
        return made, seen.get["n"]

    def _refused(self, similar: DataFrame, n: int, work: str) -> DataFrame:
        """The classes that repeat an accepted one."""
        refused, turn = [], 0
        if n > EDGES:
            # in rounds: what repeats history is refused; what has no earlier neighbour is accepted, its later ones are
            # refused; the rest goes on without them
            id_of = lambda c: F.col(c).alias("id")
            lost = self.at.write(similar.where("hist and a < b").select(id_of("b")).distinct(), f"{work}/lost-0")
            edges, gone = similar.where("not hist and a < b").select("a", "b"), lost
            while True:
                refused.append(lost)
                left = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
                edges, n = self._counted(left, f"{work}/edges-{turn}")
                if n <= EDGES:
                    similar = edges.select("a", "b", F.lit(False).alias("hist"))
                    break
                turn += 1
                roots = edges.select(id_of("a")).distinct().join(edges.select(id_of("b")).distinct(), "id", "left_anti")
                lost = self.at.write(edges.join(roots.withColumnRenamed("id", "a"), "a", "left_semi").select(id_of("b")).distinct(), f"{work}/lost-{turn}")
                gone = roots.unionByName(lost)
        last = similar.select("a", "b", "hist").coalesce(1).mapInArrow(_ordered, "id bigint")
        for more in refused:
            last = last.unionByName(more)
        return last

    # -- judging
    def add(self, sets: DataFrame, label: str) -> DataFrame:
        """Judge a batch (rows of :func:`record_sets` of one ``batch_no``, ids unique), take what's accepted into the
        index, and return ``append_a, append_b``: each call that isn't accepted with each accepted earlier one that
        it repeats.

        Sets without records are left out.  A label that was added before is
        not added again; its pairs are returned as they were.
        """
        if label not in self.done:
            name = self.prepare(sets.withColumn("batch_no", F.lit(0)))
            self.judge(name, 0 if self.at.folders(f"{name}/classes") else None, label)
        return self.pairs([label])

    def judge(self, name: str, batch: int | None, label: str) -> None:
        """Judge one batch of a folder that :meth:`prepare` made (None: it has no sets), under a label."""
        if label in self.done:
            return
        if batch is None:
            self._commit(self.runs, label, None)
            return
        folder, work = f"{name}/*/batch_no={batch}", f"work/{label}"
        entries, classes = folder.replace("*", "entries"), folder.replace("*", "classes")
        rows = self.at.read(entries, "key bigint, id bigint, n int, last_id bigint")
        search = _searched([self.at.files(r["entries"]) for r in self.runs], self.at.files(entries), self.widened, self.share, SMALL)
        candidates = rows.mapInArrow(search, "a bigint, b bigint, hist boolean").distinct()
        candidates, hot = self._counted(candidates, f"{work}/candidates", F.col("a").isNull())
        tables = [t for r in self.runs for t in r["sets"]] + [classes]
        similar = self._verified(candidates.where("a is not null"), tables, folder)
        similar, n = self._counted(similar, f"similar/{label}")
        if hot:
            both = similar
            for more in self._hot(rows, similar, folder, work):
                both = both.unionByName(more)
            both = self.at.write(both.distinct(), f"{work}/similar")
            similar, n = self._counted(both, f"similar/{label}")
        refused = self.at.write(self._refused(similar, n, work), f"refused/{label}")
        self._write_entries(rows.join(refused, "id", "left_anti"), f"runs/{label}/entries")
        run = {"name": f"runs/{label}", "entries": f"runs/{label}/entries", "sets": [classes], "rows": rows.count()}
        self._keep(run, label, name, batch)
        self.at.drop(work)

    def _write_entries(self, rows: DataFrame, name: str) -> None:
        self.at.write_sorted(rows.select("key", "id", "n"), name, ["key", "id"], block_bytes=GROUP_BYTES)

    def _keep(self, run: dict, label: str, name: str, batch: int) -> None:
        """The accepted as a new run.  Of the newest runs, ``MERGE`` of like size are merged into one.  The new list
        of runs is published in one step; what it no longer names is deleted after that."""
        runs, old = [*self.runs, run], []
        while len(runs) >= MERGE and runs[-MERGE]["rows"] <= MERGE * runs[-1]["rows"]:
            like, made = runs[-MERGE:], f"{runs[-1]['name']}+"
            rows = self.at.read_all([r["entries"] for r in like], "key bigint, id bigint, n int")
            self._write_entries(rows, f"{made}/entries")
            sets = self.at.read_all([t for r in like for t in r["sets"]], "id bigint, records array<bigint>")
            # what was refused is left out now
            live = self.at.read(f"{made}/entries").where(F.col("key") < 1 << BITS * DEPTH).select("id")
            self.at.write_sorted(sets.join(live, "id", "left_semi"), f"{made}/sets", ["id"])
            runs[-MERGE:] = [{"name": made, "entries": f"{made}/entries", "sets": [f"{made}/sets"], "rows": sum(r["rows"] for r in like)}]
            old += like
        self._commit(runs, label, [name, batch])
        for r in old:
            self.at.drop(r["name"])

    def _commit(self, runs: list[dict], label: str, place: list | None) -> None:
        self.runs, self.done = runs, self.done | {label: place}
        self.at.commit_json("state", {"runs": self.runs, "batches": self.done})

    def pairs(self, labels: list[str]) -> DataFrame:
        """``append_a, append_b`` of the batches that were judged under these labels."""
        places = {x: self.done[x] for x in labels if self.done[x]}
        if not places:
            return self.spark.createDataFrame([], "append_a bigint, append_b bigint")
        similar = self.at.read_all([f"similar/{x}" for x in places], "a bigint, b bigint, b_last bigint, hist boolean")
        refused = self.at.read_all([f"refused/{x}" for x in places], "id bigint")
        classes = self.at.read_all([f"{name}/classes/batch_no={batch}" for name, batch in places.values()], "x bigint, y bigint, id bigint, last_id bigint")
        # a class of copies repeats its own first member, if that was accepted
        own = classes.where("last_id > id").select(F.col("id").alias("a"), F.col("id").alias("b"))
        accepted = similar.select("a", "b").unionByName(own).join(refused.withColumnRenamed("id", "a"), "a", "left_anti")
        return accepted.distinct().join(self._members(places), "b").where("append_id > a").select(F.col("a").alias("append_a"), F.col("append_id").alias("append_b"))

    def _members(self, places: dict) -> DataFrame:
        """``append_id, b``: each call with the class that it belongs to."""
        parts = []
        for name in sorted({n for n, _ in places.values()}):
            batches = [b for n, b in places.values() if n == name]
            classes = self.at.read(f"{name}/classes", "x bigint, y bigint, id bigint, batch_no int").where(F.col("batch_no").isin(batches))
            members = self.at.read(f"{name}/members", "append_id bigint, batch_no int, x bigint, y bigint")
            parts.append(members.join(classes, ["batch_no", "x", "y"]).select("append_id", F.col("id").alias("b")))
        made = parts[0]
        for part in parts[1:]:
            made = made.unionByName(part)
        return made


def found(calls: DataFrame, path: str | None = None) -> DataFrame:
    """``append_a, append_b`` of all calls, taken batch by batch in the order of ``batch_no``.

    Calls without a batch number or id are left out.  Payloads are read once.
    """
    forest = Forest(calls.sparkSession, path)
    name = forest.prepare(record_sets(calls.where("append_id is not null and batch_no is not null")))
    batches = sorted(int(x.partition("=")[2]) for x in forest.at.folders(f"{name}/classes"))
    for batch in batches:
        forest.judge(name, batch, str(batch))
    return forest.pairs([str(b) for b in batches])
