"""Millions of tiny record files into few well-sized ones, each record exactly once.

Method: size-tiered incremental compaction with a transaction journal.  The
unit is a *run*: at first a raw file, later what a transaction wrote.  On each
level the runs of an item are divided by size into tiers and, within a tier,
into groups of about ``fan_in``; the runs of a group are merged by one
transaction into one run.  Raw files are all merged with files of like size.
Of later runs, a tier is merged when it has ``FEW`` or more; so this goes on,
level by level, until no tier of an item has so many.  A run is never merged
with one of another size, and a small file that comes later leaves the large
runs as they are: a record is written again only as often as there are tiers.

No record is in two runs.  When raw files are merged, of equal records the
first occurrence (by file and line) is kept: first in the group, then among
the groups; what an older run has already is found by a join with the older
runs' hashes, without reading or writing their records.  The others are
recorded as repeats.  Equal records are divided by group and line before they
meet, and a merge of runs needs no comparing, so neither a hot item nor a hot
record is a hot task.

The journal is a table: for each level, the inputs and the output of every
transaction, under an id made from what it reads.  Data and journal of a level
are written first; its commit is one small file that appears in one step.
What is written and not committed doesn't exist: the level is done again, over
what was left there, with the same result.  A later call takes up the journal,
adds the files that it doesn't know yet, and merges on.  Tables that no live
run needs are deleted after the commit that replaced them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import same
from ..functions.normal import instant_us, json_objects, number
from ..shared import Scratch

ITEM = ["collection_name", "item_name"]
RUN = ["made_at", "run_no"]
#: What makes two records of an item equal.  ``other`` has the texts of what could not be read as instant or number.
RECORD = ["idx_us", "value1", "value2", "category", "other"]
#: The record and its item as 128 bits: equal ones are found by these.
HASH = ["h1", "h2"]
#: The parts of a level's folder.
KEPT, AGAIN = "_again=false", "_again=true"
WORKING_COPY = "__"
FAN_IN, TARGET_BYTES = 64, 128 << 20
#: A tier holds runs of up to so many times the size of its smallest, and is merged when it has so many of them.
TIER, FEW = 4, 4
#: Equal records of a group are compared in so many parts first, by line.
PARTS = 16


def _item(name: Column) -> Column:
    """A working copy belongs to the item that it's named after."""
    return F.when(name.startswith(WORKING_COPY), F.substring(name, len(WORKING_COPY) + 1, 1 << 30)).otherwise(name)


def records(files: DataFrame, *kept: str) -> DataFrame:
    """``file_id, line_no``, the columns of RECORD and those ``kept``, for each line that is a valid JSON object.

    Lines are numbered from 1.  An index is an ISO text in UTC or a number of
    epoch milliseconds; numbers may be quoted; an absent field is null.
    """
    lines = files.select("file_id", *kept, F.posexplode(F.split("payload", "\n")).alias("_line", "_text"))
    read = lines.select("file_id", (F.col("_line") + 1).alias("line_no"), *kept, F.explode(json_objects(F.col("_text"), ["index", "value1", "value2", "category"])).alias("_r"))
    index = F.col("_r.index")
    millis = F.rlike(F.trim(index), F.lit(r"^-?\d+(\.\d+)?$"))
    instant = F.when(millis, (F.trim(index).try_cast("decimal(32,6)") * 1000).cast("bigint")).otherwise(instant_us(index))
    values = {"idx_us": (index, instant), "value1": (F.col("_r.value1"), number(F.col("_r.value1"))), "value2": (F.col("_r.value2"), number(F.col("_r.value2")))}
    unread = [F.when(text.isNotNull() & value.isNull(), F.concat(F.lit(f"{name}="), text)) for name, (text, value) in values.items()]
    other = F.concat_ws("\n", *unread)
    # 0.0 is added so that the two zeros are one
    columns = [v.alias(c) if c == "idx_us" else (v + F.lit(0.0)).alias(c) for c, (_, v) in values.items()]
    return read.select("file_id", "line_no", *kept, *columns, F.col("_r.category").alias("category"), F.when(other != "", other).alias("other"))


def _hashes() -> list[Column]:
    # a null leaves a hash as it was, so each value is told apart from its absence by a flag
    values = [x for c in [*ITEM, *RECORD] for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *reversed(values)).alias("h2")]


@dataclass
class Compaction:
    """What a call of :func:`compact` leaves: ``records`` (each once, with the place it was first found),
    ``repeats`` (``file_id, line_no`` of the others), ``runs`` (of each item fewer than ``FEW`` of like size) and
    ``journal``.  The tables can be read until the next call on the same folder."""

    records: DataFrame
    repeats: DataFrame
    runs: DataFrame
    journal: DataFrame
    levels: int


def _tier() -> Column:
    return F.floor(F.log(float(TIER), F.greatest(F.col("n_bytes"), F.lit(1)))).cast("int")


_RUNS = "collection_name string, item_name string, made_at int, run_no bigint, n_records bigint, n_bytes bigint"
_HELD = "collection_name string, item_name string, made_at int, run_no bigint, file_id bigint, line_no int, idx_us bigint, value1 double, value2 double, category string, other string, h1 bigint, h2 bigint"


class _Store:
    def __init__(self, spark: SparkSession, path: str | None, fan_in: int):
        self.spark, self.fan_in = spark, fan_in
        self.at = Scratch(spark, "compaction", path)
        state = self.at.load_json("committed") or {"level": 0, "live": [], "ingested": []}
        self.level, self.live, self.ingested = state["level"], state["live"], state["ingested"]

    def _tables(self, names: list[str], schema: str) -> DataFrame:
        return self.at.read_all(names, schema) if names else self.spark.createDataFrame([], schema)

    def journal(self) -> DataFrame:
        return self._tables([f"journal/{k}" for k in range(1, self.level + 1)], "level int, txn_id string, role string, " + _RUNS)

    def survivors(self) -> DataFrame:
        return self._tables([f"records/{k}/{KEPT}" for k in self.live], _HELD)

    def repeats(self) -> DataFrame:
        names = [f"records/{k}/{AGAIN}" for k in self.ingested]
        return self._tables([x for x in names if self.at.exists(x)], "file_id bigint, line_no int")

    def runs(self) -> DataFrame:
        return self._tables([f"runs/{self.level}"] if self.level else [], _RUNS)

    def groups(self, runs: DataFrame, counts: DataFrame) -> DataFrame:
        """``runs`` with the number of the group (``_group``) that each is merged in, null for none.

        Group sizes come from counts; which group a run goes to is a hash of
        the run, so that runs need no order and no item is gathered.
        """
        number = _tier().cast("bigint") * (1 << 40) + F.pmod(F.xxhash64(*RUN), F.col("_parts"))
        return same(runs.withColumn("_tier", _tier()), counts, [*ITEM, "_tier"], "left").withColumn("_group", number).drop("_parts", "_tier")

    def counts(self, runs: DataFrame, level: int, few: int) -> DataFrame:
        """Into how many groups each tier with ``few`` runs or more is divided.

        Written, so that its size is known where it's joined: the files are
        shuffled for that only if it's too large to be sent to all tasks.
        """
        many = runs.groupBy(*ITEM, _tier().alias("_tier")).agg(F.count("*").alias("_n")).where(F.col("_n") >= few)
        return self.at.write(many.select(*ITEM, "_tier", F.ceil(F.col("_n") / self.fan_in).alias("_parts")), f"counts/{level}")

    def commit(self, level: int, plan: DataFrame, carried: DataFrame, ingest: bool) -> None:
        """After a level's records were written: its runs and journal, then the commit, then what's no longer needed
        is deleted."""
        kept = f"records/{level}/{KEPT}"
        held = self._tables([kept] if self.at.exists(kept) else [], _HELD)
        n, size = held.count(), self.at.bytes(kept)
        each = size / n if n else 0.0  # a record's bytes as they were written
        made = held.groupBy(*ITEM, *RUN).agg(F.count("*").alias("n_records")).withColumn("n_bytes", F.ceil(F.col("n_records") * each).cast("bigint"))
        live = self.at.write(made.unionByName(carried), f"runs/{level}")
        inputs = plan.select(*ITEM, "_group", F.lit("input").alias("role"), *RUN, "n_records", "n_bytes")
        outputs = live.where(F.col("made_at") == level).select(*ITEM, F.col("run_no").alias("_group"), F.lit("output").alias("role"), *RUN, "n_records", "n_bytes")
        ids = plan.groupBy(*ITEM, "_group").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(*RUN)).alias("_x"))
        name = F.sha2(F.concat_ws("|", F.lit(level), *(F.coalesce(F.col(c), F.lit("\u0000")) for c in ITEM), F.col("_group"), F.col("_n"), F.col("_x")), 256)
        ids = ids.select(*ITEM, "_group", name.alias("txn_id"))
        journal = same(inputs.unionByName(outputs), ids, [*ITEM, "_group"]).select(F.lit(level).alias("level"), "txn_id", "role", *ITEM, *RUN, "n_records", "n_bytes")
        self.at.write(journal, f"journal/{level}")
        # no more of them than levels
        needed = sorted(r[0] for r in live.select("made_at").distinct().collect())
        gone = set(self.live) - set(needed)
        self.level, self.live, self.ingested = level, needed, [*self.ingested, level] if ingest else self.ingested
        self.at.commit_json("committed", {"level": level, "live": self.live, "ingested": self.ingested})
        for name in [*(f"records/{k}/{KEPT}" for k in gone), f"counts/{level}", f"plan/{level}", *([f"runs/{level - 1}"] if level > 1 else [])]:
            self.at.drop(name)

    def ingest(self, files: DataFrame) -> bool:
        """The first level of a call: raw files that the journal doesn't know are read, each in its group."""
        named, level = files.withColumn("item_name", _item(F.col("item_name"))), self.level + 1
        if self.level:
            # of the journal, only the range of the new files' numbers is read
            ends = named.agg(F.min("file_id").alias("a"), F.max("file_id").alias("b")).first()
            known = self.journal().where("role = 'input' and made_at = 0").select(F.col("run_no").alias("file_id"))
            named = named.join(known.where(F.col("file_id").between(ends.a, ends.b)), "file_id", "left_anti")
        size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("n_bytes")
        raw = named.select(*ITEM, F.lit(0).alias("made_at"), F.col("file_id").alias("run_no"), F.lit(None).cast("bigint").alias("n_records"), size)
        counts = self.counts(raw, level, 1)
        plan = self.at.write(self.groups(raw, counts), f"plan/{level}")
        if plan.isEmpty():
            return False
        # the group is found for the payloads as for the plan, by the same small table of counts
        sized = named.select(*ITEM, F.lit(0).alias("made_at"), F.col("file_id").alias("run_no"), size, "file_id", "payload")
        read = records(self.groups(sized, counts), *ITEM, "_group").select("*", *_hashes())
        place = ["file_id", "line_no"]
        first = Window.partitionBy(*HASH, "_group", F.pmod("line_no", F.lit(PARTS))).orderBy(*place)
        merged = read.withColumn("_again", F.row_number().over(first) > 1)
        # of what is first in its part, the first one of all; the rest is spread, since it's decided
        apart = F.when(F.col("_again"), F.pmod(F.xxhash64(*place), F.lit(1 << 20)) + 1).otherwise(0)
        merged = merged.withColumn("_again", F.col("_again") | (F.row_number().over(Window.partitionBy(*HASH, apart).orderBy(*place)) > 1))
        if self.live:
            older = self.survivors().select(*HASH, F.lit(True).alias("_old"))
            merged = merged.join(older, HASH, "left").withColumn("_again", F.col("_again") | F.col("_old").isNotNull())
        columns = [*ITEM, F.lit(level).alias("made_at"), F.col("_group").alias("run_no"), *place, *RECORD, *HASH]
        # both parts in one pass; what's kept is put in order when it's merged or published
        self.at.drop(f"records/{level}")
        self.at.write_parts(merged.select(*columns, "_again"), f"records/{level}", "_again")
        self.commit(level, plan, self.runs(), True)
        return True

    def merge(self) -> bool:
        """A further level, unless no tier of an item has ``FEW`` runs."""
        level, runs = self.level + 1, self.runs()
        marked = self.at.write(self.groups(runs, self.counts(runs, level, FEW)), f"plan/{level}")
        plan = marked.where("_group is not null")
        if plan.isEmpty():
            return False
        read = same(self.survivors(), plan.select(*ITEM, *RUN, "_group"), [*ITEM, *RUN])
        out = read.withColumns({"made_at": F.lit(level), "run_no": F.col("_group")}).select(*ITEM, *RUN, "file_id", "line_no", *RECORD, *HASH)
        self.at.write_sorted(out, f"records/{level}/{KEPT}", [*ITEM, "run_no", "idx_us", "file_id", "line_no"])
        self.commit(level, plan, marked.where("_group is null").select(*ITEM, *RUN, "n_records", "n_bytes"), False)
        return True


def compact(files: DataFrame, path: str | None = None, fan_in: int = FAN_IN) -> Compaction:
    """Take in the files of ``files`` that are new, and merge until no tier of an item has ``FEW`` runs.

    ``path`` is the folder of the journal and the runs, kept from call to
    call; without it, one of the session's shared folder is used.  Files
    without records, null payloads and lines that aren't records give
    nothing; null items and collections are values like others; other columns
    (a written ``n_rows``, say) are not trusted, and left unread.  A file
    whose id the journal knows is not read again.  Of equal records in files
    of several calls, that of the first call is kept.
    """
    if fan_in < FEW:
        raise ValueError(f"a merge takes {FEW} runs at least")
    store = _Store(files.sparkSession, path, fan_in)
    store.ingest(files.select("file_id", *ITEM, "payload"))
    while store.merge():
        pass
    live = same(store.survivors(), store.runs().select(*ITEM, *RUN), [*ITEM, *RUN], "left_semi")
    return Compaction(live, store.repeats(), store.runs(), store.journal(), store.level)


def publish(done: Compaction, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write the compacted records under ``path``, in a folder for each item, as few files of at most about
    ``target_bytes``, sorted by index; returns a scan of them.

    An item below the target is one file.  The others are divided by ranges of
    their index into files of like size, where a hot item takes as many tasks
    as it has files.  Everything is written aside, to a folder of its own;
    then a small file that names it appears in one step, and the files that
    were published before are deleted.  Readers find it by :func:`published`.
    """
    spark = done.records.sparkSession
    at = Scratch(spark, "", path)
    before = at.load_json("current")
    version = (before or {"version": 0})["version"] + 1
    aside = at.at(f"v{version}")
    at.drop(f"v{version}")
    sizes = done.runs.groupBy(*ITEM).agg(F.sum("n_bytes").alias("_bytes"))
    light = F.col("_bytes") <= target_bytes
    large = sizes.where(~light).agg(F.sum(F.ceil(F.col("_bytes") / target_bytes)).alias("n")).first().n
    marked = same(done.records, sizes, ITEM)
    columns = [*ITEM, *RECORD]
    small = marked.where(light).select(*columns)
    # each item goes to one task, and a task writes a file for each of its items
    small.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *ITEM).sortWithinPartitions(*columns).write.partitionBy(*ITEM).parquet(aside)
    if large:
        wide = marked.where(~light).select(*columns)
        wide.repartitionByRange(int(large), *columns).sortWithinPartitions(*columns).write.mode("append").partitionBy(*ITEM).parquet(aside)
    at.commit_json("current", {"version": version})
    if before:
        at.drop(f"v{before['version']}")
    return published(spark, path)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """What was published last under ``path``; None if nothing was."""
    at = Scratch(spark, "", path)
    current = at.load_json("current")
    return at.read(f"v{current['version']}", "collection_name string, item_name string, idx_us bigint, value1 double, value2 double, category string, other string") if current else None


def layout(table: DataFrame) -> DataFrame:
    """``collection_name, item_name, n_files, n_records`` of a published table: a count by file, so nothing is
    shuffled but the files' names."""
    by_file = table.groupBy(*ITEM, F.col("_metadata.file_path").alias("_file")).agg(F.count("*").alias("n"))
    return by_file.groupBy(*ITEM).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_records"))
