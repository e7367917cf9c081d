"""Keyed picks and checks shared by the operators.

Every pick is a ranked window cut at a small ``k``; Spark turns the cut into a group limit that
runs before the shuffle too, so a key that holds a third of all rows sends at most ``k`` rows
per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | None, rank: str | None = None) -> DataFrame:
    """The first k rows of each key (all of them if k is None), numbered from 1 if rank names a column."""
    if k is None and rank is None:
        return df
    name = rank or "__pick"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    if k is not None:
        out = out.where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def first_items(array: Column, k: int | None) -> Column:
    """The first k elements, or all."""
    return array if k is None else F.slice(array, 1, k)


def unfold(df: DataFrame, keep: Sequence[Column | str], array: Column, name: str) -> DataFrame:
    """Rows of an array's elements, NULL elements left out.

    The outer explode matters: for a plain one the optimiser adds a filter that computes the whole
    array a second time before it is exploded.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column some frames lack is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def beside(*reports: DataFrame) -> DataFrame:
    """One-row reports side by side, joined on a constant."""
    keyed = [r.withColumn("__one", F.lit(1)) for r in reports]
    return reduce(lambda a, b: a.join(b, "__one"), keyed).drop("__one")


def require_empty(bad: DataFrame, message: str, column: str) -> None:
    """Raise with a few sample values if ``bad`` has rows."""
    sample = [row[0] for row in bad.select(column).limit(5).collect()]
    if sample:
        raise ValueError(f"{message}: {', '.join(map(str, sample))}")


def require_unique(df: DataFrame, keys: Sequence[str], message: str) -> None:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    require_empty(twice.select(F.concat_ws("/", *keys).alias("key")), message, "key")


def insist(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """df, whose job fails with the message at the first row that is not ok.

    The condition is a filter, so it is looked at whatever columns are read. After an outer join it has to
    name a column of each side: the optimiser tries conditions on one side alone with nulls.
    """
    said = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def unique_rows(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """df by key; a key of two rows fails the job."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest) if rest else F.lit(0)).alias("__r"))
    known = insist(grouped, F.col("__n") == 1, F.concat(F.lit(f"{message}: "), F.concat_ws("/", *keys)))
    return known.select(*[F.col(c) if c in keys else F.col("__r")[c].alias(c) for c in df.columns])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
