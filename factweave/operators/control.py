"""History and ranking of acquisition strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.numeric import half_up
from .rows import beside


def _gain() -> Column:
    return F.coalesce(F.nullif(F.col("learning_gain"), F.lit(0.0)), F.col("score_delta"), F.lit(0.0))


def strategy_history(history: DataFrame) -> DataFrame:
    """Runs, successes and mean gain of each strategy."""
    gain = _gain().cast("decimal(18,6)")
    return history.groupBy("strategy").agg(
        F.count("*").alias("prior_runs"), F.count_if(_gain() > 0).alias("prior_successes"),
        half_up(F.avg(gain).cast("double"), 3).alias("prior_mean_learning_gain"),
    )


def strategy_order(history: DataFrame) -> DataFrame:
    """Strategies by mean gain plus an exploration bonus, ties in catalogue order.

    The history is reduced to at most one row per strategy before anything is ranked.
    """
    spark = history.sparkSession
    catalogue = spark.createDataFrame([(s, i) for i, s in enumerate(K.STRATEGIES)], "strategy STRING, place INT")
    # the exact decimal mean keeps the order the same on any partitioning
    per = history.groupBy("strategy").agg(F.count("*").alias("runs"), F.avg(_gain().cast("decimal(18,6)")).cast("double").alias("mean"))
    total = per.agg(F.greatest(F.coalesce(F.sum("runs"), F.lit(0)), F.lit(1)).alias("total"))
    joined = beside(catalogue.join(per, "strategy", "left"), total)
    bonus = F.sqrt(F.ln(F.col("total") + 1) / (F.coalesce("runs", F.lit(0)) + 1))
    ranked = joined.withColumn("priority", F.coalesce("mean", F.lit(0.0)) + 0.35 * bonus)
    place = F.row_number().over(Window.orderBy(F.col("priority").desc(), "place"))
    return ranked.select("strategy", F.coalesce("runs", F.lit(0)).alias("runs"), "priority", place.alias("position"))
