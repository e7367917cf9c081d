"""Structured Streaming jobs over landed files.

Each job reads what has arrived, stops (AvailableNow) and picks up behind its checkpoint on the
next call. Keyed state lives in Spark's state store; the sinks write one folder per micro-batch and overwrite it
on a replay, so a lost executor or a restart changes nothing in the result. Tables kept up to date by key are
merged as they grow (tables.py). Change events have state of their own (changes.py).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.feed import EVENT_KEY, fold_feed, index_from_fold
from ..operators.normalise import parse_feed
from ..sources.pages import feed_entries, read_pages
from .tables import UpsertTable

#: A page holds fewer entries than this.
PAGE_ROOM = 1 << 20


def _source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _batch_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def _upserts(path: str, keys: Sequence[str]):
    return lambda batch, batch_id: UpsertTable(batch.sparkSession, path, keys).write(batch, batch_id)


def _run(stream: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )


def _feed(spark: SparkSession, src: str) -> DataFrame:
    """Entries of a store of feed pages behind the cursor, numbered by page and position."""
    return feed_entries(read_pages(spark, src, stream=True)).withColumn("seq", F.col("page") * PAGE_ROOM + F.col("position"))


def land_feed(spark: SparkSession, src: str, checkpoint: str, sink: str) -> DataFrame:
    """Append newly arrived feed pages (a store of numbered pages) to a table; the number of the next page is the cursor."""
    _run(parse_feed(_feed(spark, src)), "append", checkpoint, _batch_writer(sink))
    return spark.read.parquet(sink).drop("batch_id")


def job_feed_stream(spark: SparkSession, src: str, checkpoint: str, sink: str) -> DataFrame:
    """Live jobs kept up to date from a store of feed pages.

    The fold of the batch operator runs as a streaming aggregate: the state holds one row per
    (job, organisation), and each batch writes only the keys it touched.
    """
    folded = fold_feed(parse_feed(_feed(spark, src)))
    keys = ["job_id", "organisation_number"]
    _run(folded, "update", checkpoint, _upserts(sink, keys))
    return index_from_fold(UpsertTable(spark, sink, keys).read())


def footprint_stream(
    spark: SparkSession, src: str, schema: T.StructType, checkpoint: str, sink: str,
    window: str = "1 day", delay: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Observations, engagement and last time per entity and time window.

    Without a delay every row counts, however late, as in the batch twin; the state then keeps all windows.
    A delay bounds the state and lets later rows go.
    """
    obs = _source(spark, src, schema, files_per_trigger)
    obs = obs.withWatermark("ts", delay) if delay else obs
    counted = obs.groupBy("organisation_number", F.window("ts", window).alias("w")).agg(
        F.count("*").alias("observations"), F.sum("engagement").alias("engagement"), F.max("ts").alias("last_ts")
    ).select("organisation_number", F.col("w.start").alias("window_start"), "observations", "engagement", "last_ts")
    keys = ["organisation_number", "window_start"]
    _run(counted, "update", checkpoint, _upserts(sink, keys))
    return UpsertTable(spark, sink, keys).read()


def dedupe_stream(
    spark: SparkSession, src: str, schema: T.StructType, checkpoint: str, sink: str,
    keys: Sequence[str] = EVENT_KEY, delay: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Page-event log without repeats. A key is remembered for good, or for ``delay`` of event time."""
    events = _source(spark, src, schema, files_per_trigger)
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys)) if delay else events.dropDuplicates(list(keys))
    _run(once, "append", checkpoint, _batch_writer(sink))
    return spark.read.parquet(sink).drop("batch_id")
