"""Registry of runnable queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Setting of a session whose tables come as fewer files than it has cores (as the test data on one machine do):
#: tables of long texts and payloads are then dealt over so many partitions first. Unset, nothing is moved.
SPREAD = "factweave.input.partitions"
_HEAVY = ("documents", "pages", "events")


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the given folder."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts and table in _HEAVY else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least two tasks a core, for work that costs much more than reading: a file of narrow rows may
    hold a million of them in one row group, which one task reads whatever the number of splits."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
