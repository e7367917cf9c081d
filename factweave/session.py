"""Session defaults and the shared folder used for checkpoints and landed tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench. A cluster brings its own session and settings."""
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factweave")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("factweave.input.partitions", str(parts))
        .config("spark.driver.memory", os.environ.get("FACTWEAVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for landed tables and stream checkpoints.

    It lies in ``spark.checkpoint.dir``, which a cluster points at shared storage so that
    the files outlive any executor. Only where that is unset (tests on one machine) is a
    temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        base = tempfile.mkdtemp(prefix="factweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there.

    For results that several later steps read: they are not computed again, and a lost executor costs
    no more than a read.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
