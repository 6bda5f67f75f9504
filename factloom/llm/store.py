"""Written tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it again, so a lost executor costs a re-read and never a recomputation of
the whole chain.  The folder is ``spark.checkpoint.dir`` of the session; only where that is unset and the master is local
(as in tests) a folder of our own is made.  What a job has written goes when it is no longer needed: ``drop`` deletes a
table at once, ``clear`` all tables of a session, and what is left the JVM deletes when it ends.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders of the jobs of each application.
_roots: dict[str, list[str]] = {}
#: Frees the files of a shuffle when the statement that made them ends; they count until then, however late they are collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; raises where there is none and executors may sit on other machines."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        with contextlib.suppress(Exception):
            found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="factloom-"))
    return found.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Statements run inside give the disk of their shuffles back when they end."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


class Scratch:
    """Tables of one job under the shared folder.

    ``keep`` writes a DataFrame and returns it as read back; ``drop`` deletes what no later step reads.  Tables behind a
    returned lazy result have to stay until the result is used: ``clear`` deletes them, or the end of the session.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/factloom/{job}-{uuid.uuid4().hex}"
        self._n = 0
        path, fs = _at(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with freed_shuffles(self.spark):
            writer.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._factloom_path = path  # type: ignore[attr-defined]
        return kept

    def part(self, table: DataFrame, column: str, value: int) -> DataFrame:
        """The rows of one part of a kept table that was written by ``column``, without it."""
        rest = table.drop(column)
        path, fs = _at(self.spark, f"{table._factloom_path}/{column}={value}")
        return self.spark.read.schema(rest.schema).parquet(path.toString()) if fs.exists(path) else rest.limit(0)

    def drop_part(self, table: DataFrame, column: str, value: int) -> None:
        path, fs = _at(self.spark, f"{table._factloom_path}/{column}={value}")
        fs.delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = _at(self.spark, t._factloom_path)
            fs.delete(path, True)


def written(spark: SparkSession) -> list[str]:
    """Folders of this application's jobs, oldest first."""
    return list(_roots.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, roots: list[str] | None = None) -> None:
    """Delete the tables of this application's jobs (or of some of them); results not yet used are lost."""
    mine = _roots.get(spark.sparkContext.applicationId, [])
    for root in list(mine if roots is None else roots):
        path, fs = _at(spark, root)
        fs.delete(path, True)
        if root in mine:
            mine.remove(root)
