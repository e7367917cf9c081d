"""Change events from rows that arrive in any order: the rows of a group as streaming aggregates.

A row is a value of a field of an entity at a place (ts, seq). Rows of an entity and field are dealt over
time buckets, so that a busy entity is many groups of state. The state keeps the set of a group's rows;
a batch sends the whole set of each group it touched to a table keyed by group, where the last word counts.
Changes inside a group are read off its rows in order (a late row gives its successor another predecessor),
those from one bucket to the next come from the buckets' first and last rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import let
from .tables import UpsertTable

KEY = ["organisation_number", "field"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_stream(
    spark: SparkSession, src: str, schema: T.StructType, checkpoint: str, sink: str,
    bucket: str = "30 days", delay: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Change events (organisation_number, field, seq, old_value, new_value) from what has arrived at src:
    JSON lines of organisation_number, field, value, seq and ts. Equal to the batch result whatever the order
    of arrival.

    Rows of an entity and field are ordered by ts, then seq; of rows of one place the greatest value counts, a null
    the least. Rows without ts or seq are ignored. Without a delay all rows stay in the state. With one, a
    bucket's state goes when the watermark has passed it, and rows later than that are dropped.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(src).where("seq IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", delay) if delay else rows
    row = F.struct(F.unix_micros("ts").alias("at"), "seq", "value")
    sent = rows.groupBy(*KEY, F.window("ts", bucket).alias("bucket")).agg(F.collect_set(row).alias("rows"))
    sent = sent.withColumn("bucket", F.col("bucket.start"))
    table = UpsertTable(spark, sink, [*KEY, "bucket"])
    with _provider(spark):
        writer = sent.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.foreachBatch(lambda batch, n: UpsertTable(batch.sparkSession, sink, table.keys).write(batch, n)).start()
    query.awaitTermination()
    return changes(table.read())


def changes(sent: DataFrame) -> DataFrame:
    """The change events that the table of groups and their rows stands for."""
    def last_of_place(rows):  # noqa: ANN001, ANN202
        return F.filter(rows, lambda r, i: let(F.get(rows, i + 1), lambda n: n.isNull() | (n["at"] != r["at"]) | (n["seq"] != r["seq"])))

    def in_order(rows):  # noqa: ANN001, ANN202
        step = F.transform(rows, lambda r, i: F.struct(r["seq"].alias("seq"), F.get(rows, i - 1)["value"].alias("old_value"), r["value"].alias("new_value")))
        moved = F.filter(step, lambda c, i: (i > 0) & ~c["new_value"].eqNullSafe(c["old_value"]))
        return F.struct(moved.alias("moved"), F.get(rows, F.lit(0)).alias("first"), F.element_at(rows, -1).alias("last"))

    # ascending order has nulls first: of the rows of one place the greatest value is the last
    groups = sent.select(*KEY, "bucket", let(let(F.array_sort("rows"), last_of_place), in_order).alias("g"))
    inside = groups.select(*KEY, F.explode_outer("g.moved").alias("c")).where("c IS NOT NULL").select(*KEY, "c.*")
    by_bucket = Window.partitionBy(*KEY).orderBy("bucket")  # one row a bucket
    edges = groups.select(*KEY, "bucket", F.col("g.first.seq").alias("seq"), F.col("g.first.value").alias("new_value"), F.col("g.last.value").alias("last"))
    edges = edges.withColumns({"old_value": F.lag("last").over(by_bucket), "n": F.row_number().over(by_bucket)})
    between = edges.where((F.col("n") > 1) & ~F.col("new_value").eqNullSafe(F.col("old_value")))
    return inside.unionByName(between.select(*KEY, "seq", "old_value", "new_value"))


class _provider:
    """State of many groups needs the RocksDB store, which a session may not name; another setting comes back afterwards."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.before = spark, spark.conf.get(PROVIDER, None)

    def __enter__(self) -> None:
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:  # noqa: ANN002
        if self.before:
            self.spark.conf.set(PROVIDER, self.before)
        else:
            self.spark.conf.unset(PROVIDER)
