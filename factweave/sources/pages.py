"""A store of numbered pages as a Spark data source: read whole, read as a stream behind a cursor, and written.

A store is a folder of documents ``page-000000017.json``, numbered without gaps from 0. The number is the
cursor: a stream's offset is the first page it has not read, so a batch is a range of pages and a batch
that failed is read again page for page. Pages are dealt over tasks by ranges; a document passes through
as text and is taken apart in the JVM (feed_entries, snapshot_responses).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

FORMAT = "numbered_pages"
SCHEMA = "page long, document string"
#: Characters of documents sent at once, tasks up to which a range of pages stays as short as asked, and pages of a longer one.
_BATCH, _TASKS, _MOST = 1 << 20, 1024, 1024
_NAME = re.compile(r"page-(\d{9})\.json")


class Store:
    """The folder, on any file system that pyarrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def _open(self) -> tuple[fs.FileSystem, str]:
        local = re.sub(r"^file:/*", "/", self.path)
        return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(self.path)

    def end(self, first: int = 0) -> int:
        """The first number from ``first`` on that has no page."""
        system, folder = self._open()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        there = {int(m[1]) for f in found if (m := _NAME.fullmatch(f.base_name))}
        while first in there:
            first += 1
        return first

    def read(self, first: int, end: int) -> Iterator[pa.RecordBatch]:
        system, folder = self._open()
        pages, documents, size = [], [], 0
        for page in range(first, end):
            with system.open_input_stream(f"{folder}/page-{page:09d}.json") as f:
                pages.append(page)
                documents.append(f.read().decode())
            size += len(documents[-1])
            if size >= _BATCH or page == end - 1:
                yield pa.RecordBatch.from_pydict({"page": pa.array(pages, pa.int64()), "document": pa.array(documents, pa.string())})
                pages, documents, size = [], [], 0

    def write(self, batches: Iterator[pa.RecordBatch]) -> None:
        """Each page under a name of its own first, then renamed: a reader sees whole pages, and a task that runs again replaces its own."""
        system, folder = self._open()
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for page, document in zip(batch["page"].to_pylist(), batch["document"].to_pylist()):
                fresh = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(fresh) as f:
                    f.write(document.encode())
                system.move(fresh, f"{folder}/page-{page:09d}.json")


@dataclass
class Range(InputPartition):
    first: int
    end: int


def _ranges(first: int, end: int, each: int) -> list[Range]:
    """Ranges of ``each`` pages; of more, up to a bound, where these would be more than some thousand tasks."""
    each = max(each, min(_MOST, -(-(end - first) // _TASKS)))
    return [Range(i, min(i + each, end)) for i in range(first, end, each)]


class _Reader(DataSourceReader):
    def __init__(self, store: Store, each: int) -> None:
        self.store, self.each = store, each

    def partitions(self) -> list[Range]:
        return _ranges(0, self.store.end(), self.each) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.store.read(partition.first, partition.end)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, store: Store, each: int) -> None:
        self.store, self.each, self.seen = store, each, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = self.store.end(self.seen)
        return {"page": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start["page"], end["page"], self.each)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.store.read(partition.first, partition.end)

    def commit(self, end: dict) -> None:
        pass  # the checkpoint keeps the cursor; pages stay


class _Writer(DataSourceArrowWriter):
    def __init__(self, store: Store) -> None:
        self.store = store

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        self.store.write(iterator)
        return WriterCommitMessage()


class NumberedPages(DataSource):
    """Options: path; pagesPerTask, the pages that one task reads (16; more where a store has many thousands)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _store(self) -> tuple[Store, int]:
        return Store(self.options["path"]), int(self.options.get("pagesPerTask", 16))

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(*self._store())

    def streamReader(self, schema: T.StructType) -> _StreamReader:  # noqa: N802
        return _StreamReader(*self._store())

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("pages are only added: use mode append")
        return _Writer(self._store()[0])


def read_pages(spark: SparkSession, path: str, stream: bool = False, per_task: int = 16) -> DataFrame:
    """page and document of every page of a store, or of those behind a stream's cursor."""
    spark.dataSource.register(NumberedPages)
    return (spark.readStream if stream else spark.read).format(FORMAT).option("pagesPerTask", per_task).load(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Add pages (page, document) to a store. Their numbers go on from what is there; a page of a known number is replaced."""
    pages.sparkSession.dataSource.register(NumberedPages)
    pages.select(F.col("page").cast("long").alias("page"), "document").write.format(FORMAT).mode("append").save(path)


def feed_pages(entries: DataFrame, size: int, first: int = 0, order: str = "seq") -> DataFrame:
    """Pages of ``size`` feed entries (JSON texts) in their order, numbered from ``first``."""
    from ..operators.blocks import number_rows

    placed = number_rows(entries, [], F.floor(F.col(order) / size), [order], "place")
    page = F.floor(F.col("place") / size).cast("long")
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"])
    return placed.groupBy((page + first).alias("page")).agg(F.concat(F.lit('{"items": ['), F.array_join(items, ", "), F.lit("]}")).alias("document"))


def feed_entries(pages: DataFrame) -> DataFrame:
    """page, position and entry (JSON text) of each item of feed pages. A page that is no JSON object fails the read."""
    items = F.from_json("document", "items ARRAY<STRING>", {"mode": "FAILFAST"})["items"]
    # the outer form, as a plain one takes the document apart twice
    return pages.select("page", F.posexplode_outer(items).alias("position", "entry")).where("position IS NOT NULL")


def snapshot_responses(pages: DataFrame) -> DataFrame:
    """Stored responses by URL: url, status, body, raw_json, retrieved_at and effective_at; a time that a response lacks is its snapshot's."""
    whole = F.from_json("document", "retrieved_at STRING, effective_at STRING, responses MAP<STRING, STRING>", {"mode": "FAILFAST"})
    one = F.from_json("item", "status INT, body STRING, raw_json STRING, retrieved_at STRING, effective_at STRING")
    rows = pages.select(whole.alias("w")).select("w.retrieved_at", "w.effective_at", F.explode("w.responses").alias("url", "item")).withColumn("o", one)
    time = lambda c: F.coalesce(F.col("o")[c], F.col(c)).alias(c)
    return rows.select("url", "o.status", "o.body", "o.raw_json", time("retrieved_at"), time("effective_at"))
