"""Writers. Spark's output committer makes each write atomic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_jsonl(df: DataFrame, path: str, position: str | None = None) -> None:
    """Compact JSON lines, in the order of ``position`` (a range-partitioned sort, files in order)."""
    out = df if position is None else df.orderBy(position).drop(position)
    out.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def entity_documents(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per entity as a row of text."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("document"))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """df as a table in ``buckets`` files by the hash of key, sorted by it within each.

    Joins and groupings of such tables by key, with the same number of buckets, need no shuffle, and a filter
    on one key reads one file. A key with a large share of all rows makes its file as large: leave such
    tables to shuffles, which split them.
    """
    spread = df.repartition(buckets, key)  # the hash of the buckets, so that each task writes one file
    spread.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_documents(df: DataFrame, key: str, table: str, buckets: int, path: str) -> DataFrame:
    """Documents in a bucketed table; a reader of one entity reads one of its files."""
    return write_bucketed(entity_documents(df, key), table, key, buckets, path)


def resume(spark: SparkSession, batch: DataFrame, keys: Sequence[str], path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` over the entities of ``batch`` not yet in the table at ``path`` and append them.

    Finished entities stay as they are; a second call with the same batch adds nothing.
    """
    try:
        done = spark.read.parquet(path)
    except Exception as missing:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        done = None
    todo = batch if done is None else batch.join(done.select(*keys), list(keys), "left_anti")
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
