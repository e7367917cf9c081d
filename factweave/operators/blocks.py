"""Ordered work over long sequences without one task per sequence.

A sequence (the rows of one key in order) is cut into blocks by a prefix of its order, such as the
day of a timestamp. Work inside a block is an ordinary window; what a block needs from earlier ones
is a small summary per block, carried by a window over the blocks. A key that holds a third of all
rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_rows(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Zero-based position of each row in its key's order by (block, order)."""
    keys = list(keys)
    cut = df.withColumn("__block", block)
    sizes = cut.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy(*keys, "__block").orderBy(*order)
    numbered = cut.withColumn("__at", F.row_number().over(inner) - 1)
    return numbered.join(offsets, [*keys, "__block"]).withColumn(name, F.col("__at") + F.col("__offset")).drop("__block", "__at", "__offset")


def running_max(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Running maximum of ``value`` along each key's order by (block, order)."""
    keys = list(keys)
    cut = df.withColumn("__block", block)
    tops = cut.groupBy(*keys, "__block").agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "__block", F.max("__top").over(earlier).alias("__before"))
    inner = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("__inside", F.max(value).over(inner))
    return inside.join(carried, [*keys, "__block"]).withColumn(name, F.greatest("__inside", "__before")).drop("__block", "__inside", "__before")


def with_lookback(df: DataFrame, keys: Sequence[str], seconds: Column, span: int) -> DataFrame:
    """Rows under ``span``-second blocks, each also copied into the next block as context.

    Anything that looks back at most ``span`` seconds can then work inside (keys, ``__block``). Rows
    with ``__home`` false are context and are dropped afterwards.
    """
    home = F.floor(seconds / span)
    copies = F.array(F.struct(home.alias("block"), F.lit(True).alias("home")), F.struct((home + 1).alias("block"), F.lit(False).alias("home")))
    return df.withColumn("__c", F.explode(copies)).select(*df.columns, F.col("__c.block").alias("__block"), F.col("__c.home").alias("__home"))
