"""Where work that must outlive an executor is kept.

Intermediate tables go to a folder that every executor and the driver can
reach.  The cluster names it in ``spark.checkpoint.dir``; only where that is
unset *and* the master is a single-machine one is a temporary folder used.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set to a temporary one in local mode if the cluster names none."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """A folder of written tables under the shared folder, for one run of an operator.

    The tables must stay readable as long as a DataFrame built on them may
    still be executed, hence they are removed with the session's shared
    folder or by :meth:`drop`, never behind the caller's back.
    """

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/") if path else f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write the table (replacing what an aborted attempt left) and return a scan of it: the lineage ends here."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.at(name))
        return self.read(name, df.schema)

    def write_sorted(self, df: DataFrame, name: str, order: list[str], *partition_by: str, block_bytes: int = 1 << 20) -> None:
        """Write the table in ranges of ``order``, sorted, in row groups of about so many bytes: a part of it can be
        found by the files' and row groups' bounds.  The files' names sort as the ranges do."""
        keys = [*partition_by, *order]
        writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(block_bytes))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.at(name))

    def write_parts(self, df: DataFrame, name: str, *partition_by: str) -> None:
        """Write the table in a folder for each value; of an empty table nothing is left that could be read."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(self.at(name))

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.at(name))

    def read_all(self, names: list[str], schema) -> DataFrame:
        """One scan of tables of one schema."""
        return self.spark.read.schema(schema).parquet(*(self.at(n) for n in names))

    # -- small files of the driver, through Hadoop's file system so that any scheme works
    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def files(self, name: str) -> list[str]:
        """The Parquet files of a table in the order of their names; none if there's no such table."""
        fs, folder = self._fs(name)
        found = [str(s.getPath()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(x for x in found if x.endswith(".parquet"))

    def bytes(self, name: str) -> int:
        """The bytes of a table's files."""
        fs, folder = self._fs(name)
        return int(fs.getContentSummary(folder).getLength()) if fs.exists(folder) else 0

    def folders(self, name: str) -> list[str]:
        """The names of the folders of a table that was written in parts."""
        fs, folder = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()) if fs.exists(folder) else []

    def drop(self, name: str = "") -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def _states(self, name: str) -> list[str]:
        fs, folder = self._fs(name)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(x for x in names if x.endswith(".json"))

    def commit_json(self, name: str, value: dict) -> None:
        """Publish a small state in one step: a numbered file, written aside, appears under a name that's new.

        The one with the greatest number holds, so there's no moment without
        a state.
        """
        before = self._states(name)
        number = int(before[-1][:-5]) + 1 if before else 1
        fs, aside = self._fs(f"{name}/{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not fs.rename(aside, self._fs(f"{name}/{number:012d}.json")[1]):
            raise OSError(f"{name} was published by another process")
        for old in before:
            fs.delete(self._fs(f"{name}/{old}")[1], False)

    def load_json(self, name: str) -> dict | None:
        states = self._states(name)
        if not states:
            return None
        fs, path = self._fs(f"{name}/{states[-1]}")
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)
