"""A paged row service as a data source: one partition per page in batch, a resumable offset in a stream.

Pages are JSON-lines files ``page-<n>.jsonl`` below a folder (the service itself is not reachable from here); the reader
of a live host only differs in how a page is fetched, so ``lines`` is the one method to override.  ``scan`` reads them in
steps: it stops at enough matches, notes where it was, and makes do with what it has if the host gives up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, IsNotNull

from factloom.sources.retry import HostError, with_retry
from factloom.sources.shared import written

SCHEMA = "row_index long, id string, title string, label string, text string, failure string"
NAMES = ("row_index", "id", "title", "label", "text")


REFUSED = re.compile(r'\{"status": ?(\d+)\}')


class Pages:
    """What batch and stream readers share.  The folder may be in any store that Arrow's file systems reach."""

    def __init__(self, options: dict):
        where = options["path"]
        self.fs, self.folder = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
        self.size = int(options.get("pageSize", "100"))

    def count(self) -> int:
        names = (f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.folder)) if f.is_file)
        return max((int(n[5:-6]) for n in names if n.startswith("page-") and n.endswith(".jsonl")), default=-1) + 1

    def lines(self, number: int) -> list[str]:
        """Lines of a page as they come; a missing page is empty.  The one thing a live host does otherwise."""
        path = f"{self.folder}/page-{number}.jsonl"
        if self.fs.get_file_info(path).type == fs.FileType.NotFound:
            return []
        with self.fs.open_input_stream(path) as f:
            return f.read().decode("utf-8").splitlines()

    def answer(self, number: int) -> list[str]:
        """Lines of a page; a page that is nothing but a status is a refusal."""
        lines = self.lines(number)
        if len(lines) == 1 and (refused := REFUSED.fullmatch(lines[0])):
            raise HostError(int(refused[1]))
        return lines

    def fetch(self, number: int) -> Iterator[tuple]:
        """Rows of a page, tried again if the host fails for a moment; lines that are no objects, or have no id, are skipped."""
        for k, line in enumerate(with_retry(lambda: self.answer(number))):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict) and row.get("id"):
                yield (number * self.size + k, str(row["id"]), row.get("title"), row.get("label"), row.get("text"))


class Range(InputPartition):
    """Pages that one task reads in order."""

    def __init__(self, first: int, stop: int):
        super().__init__(first)
        self.first, self.stop = first, stop


class PagedReader(DataSourceReader):
    """Pages in ranges of ``pagesPerRange``, from ``fromPage`` on, as many as ``maxRows`` rows fill.

    Equality on a column is decided while a page is read.  A range ends early when it has ``limit`` rows that pass: the first
    ``limit`` of all are among the first ``limit`` of each range.  With ``onFailure`` = ``tell`` a page that cannot be had ends
    its range with a row that says so; else the failure is raised.
    """

    def __init__(self, options: dict):
        self.pages = Pages(options)
        self.first = int(options.get("fromPage", "0"))
        self.most = -(-int(options["maxRows"]) // self.pages.size) if "maxRows" in options else None
        self.limit = int(options["limit"]) if "limit" in options else None
        self.per_range = int(options.get("pagesPerRange", "1"))
        self.tell = options.get("onFailure", "raise") == "tell"
        self.wanted: list[tuple[int, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in NAMES:
                self.wanted.append((NAMES.index(f.attribute[0]), f.value))
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in NAMES[1:] and any(isinstance(g, EqualTo) and g.attribute == f.attribute for g in filters)):
                yield f

    def partitions(self) -> list[Range]:
        stop = self.pages.count() if self.most is None else min(self.pages.count(), self.first + self.most)
        return [Range(n, min(n + self.per_range, stop)) for n in range(self.first, stop, self.per_range)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # there is none to read
            return
        passed = 0
        for number in range(partition.first, partition.stop):
            if self.limit is not None and passed >= self.limit:
                return
            try:
                for row in self.pages.fetch(number):
                    if all(row[k] == v for k, v in self.wanted):
                        passed += 1
                        yield (*row, None)
            except HostError as e:
                if not self.tell:
                    raise
                yield (number * self.pages.size, None, None, None, None, str(e))
                return


@dataclass
class Scan:
    """What a scan came back with: its matches in order, the page to go on from, and whether the host ended it."""

    matches: DataFrame
    page: int
    cut_short: bool


def scan(spark: SparkSession, path: str, state: str, matches: Column, limit: int, max_rows: int, size: int, pages_per_range: int = 8, **equal: object) -> Scan:
    """Read on from the page that the table ``state`` names until ``limit`` rows match, ``max_rows`` rows were looked at or the
    pages end.

    Ranges of pages are read side by side.  ``equal`` are columns with the values they must have, which the source itself
    decides; ``matches`` is decided behind it, so a range reads on to its end unless ``equal`` is all that is asked.  A page
    that cannot be had ends the scan there, with what stands before it; where nothing does, it is raised.  The next page
    is noted whatever happens, so no page is read again.
    """
    at = state_of(spark, state)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(PagedSource.name()).option("path", path).option("pageSize", size).option("fromPage", at)
    rows = reader.option("maxRows", max_rows).option("pagesPerRange", pages_per_range).option("onFailure", "tell").load()
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    found = written(rows.where(F.col("failure").isNotNull() | F.coalesce(matches, F.lit(False))), "scan")
    failed = found.where("failure is not null").agg(F.min("row_index").alias("at")).first()["at"]
    good = found.where("failure is null")
    if failed is not None:
        good = good.where(F.col("row_index") < failed)
    best = good.drop("failure").orderBy("row_index").limit(limit)
    seen = best.agg(F.count("*").alias("n"), F.max("row_index").alias("last")).first()
    stop = min(max(Pages({"path": path, "pageSize": str(size)}).count(), at), at - (-max_rows // size))
    full = seen["n"] >= limit
    page = seen["last"] // size + 1 if full else stop if failed is None else failed // size
    spark.createDataFrame([(int(page),)], "page int").coalesce(1).write.mode("overwrite").json(state)
    if failed is not None and not seen["n"]:
        raise HostError(int(found.where("failure is not null").agg(F.min_by("failure", "row_index")).first()[0].split()[-1]))
    return Scan(best, int(page), failed is not None and not full)


def state_of(spark: SparkSession, state: str) -> int:
    """The page that a table of ``scan`` names; 0 where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return 0
    return spark.read.schema("page int").json(state).first()["page"]


def write_pages(rows: DataFrame, path: str, size: int) -> int:
    """``rows(row_index, id, title, label, text)`` as pages in a folder that all executors share; number of rows written.

    A page is ``size`` numbers, so a task never holds more of them.
    """

    def put(page: pd.DataFrame) -> pd.DataFrame:
        where, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        where.create_dir(folder, recursive=True)
        told = page.sort_values("row_index").drop(columns=["page", "row_index"]).to_json(orient="records", lines=True, force_ascii=False)
        with where.open_output_stream(f"{folder}/page-{int(page['page'].iloc[0])}.jsonl") as f:
            f.write(told.encode())
        return pd.DataFrame({"n": [len(page)]})

    paged = rows.withColumn("page", F.floor(F.col("row_index") / size))
    return paged.groupBy("page").applyInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def refuse(path: str, number: int, status: int = 404) -> None:
    """From now on the service refuses a page."""
    where, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_output_stream(f"{folder}/page-{number}.jsonl") as f:
        f.write(f'{{"status": {status}}}\n'.encode())


class PagedStream(DataSourceStreamReader):
    """The offset is the next page: a restart goes on where the checkpoint says."""

    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.pages.count()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(n, n + 1) for n in range(start["page"], end["page"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for row in self.pages.fetch(partition.first):
            yield (*row, None)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
