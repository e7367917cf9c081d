"""Readers for registry extracts, manifests, captures and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import digits
from ..operators.blocks import number_rows
from ..operators.rows import first_per_key, require_empty, require_unique, union_all

ORG_COLUMNS = ("organisasjonsnummer", "Organisasjonsnummer", "organisation_number")

FRAME_SCHEMA = (
    "timestamp DOUBLE, market STRUCT<id: STRING, secondsToClose: DOUBLE>,"
    " account STRUCT<cashUsd: DOUBLE, eligibleVolumeUsd: DOUBLE, completedCycles: INT, position: STRING>,"
    " rules STRUCT<maximumBuyCashUsd: DOUBLE, targetVolumeUsd: DOUBLE, evaluationWindowHours: DOUBLE>,"
    " reference STRUCT<btcMidUsd: DOUBLE, openingTargetUsd: DOUBLE, observedAt: DOUBLE,"
    " targetObservedAt: DOUBLE, targetProvisional: BOOLEAN>,"
    " books STRUCT<YES: STRUCT<asks: ARRAY<ARRAY<DOUBLE>>, bids: ARRAY<ARRAY<DOUBLE>>, minOrderSize: DOUBLE>,"
    " NO: STRUCT<asks: ARRAY<ARRAY<DOUBLE>>, bids: ARRAY<ARRAY<DOUBLE>>, minOrderSize: DOUBLE>>"
)


def sniff_separator(spark: SparkSession, path: str, choices: str = ";,\t") -> str:
    """Separator of a delimited file, read off its first line."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(choices, key=line.count)


def read_registry_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Registry extract (plain or gzip) with string columns; rows whose number has not nine digits drop out."""
    sep = separator or sniff_separator(spark, path)
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    org = next(c for c in ORG_COLUMNS if c in df.columns)
    return df.where(F.length(F.col(f"`{org}`")) == 9)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of the lines that are not blank, in the order of file names and of lines within a file.

    Splits are read in any order, so a line is placed by its file, its split's start and its place in that; each
    split then counts on from the sizes of those before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    placed = number_rows(lines.where(F.trim("value") != ""), [], F.struct("file", "start"), ["at"], "place")
    return placed.select(F.col("place").alias("position"), "value")


def read_manifest(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Requested organisations in file order: JSON list or object, JSON lines, or plain text."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        items = whole.select(
            F.coalesce(
                F.try_variant_get("v", "$.organisation_numbers", "array<variant>"),
                F.try_variant_get("v", "$", "array<variant>"),
            ).alias("items")
        ).select(F.posexplode("items").alias("position", "item"))
        raw = items.select(
            F.col("position").cast("long").alias("position"),
            F.coalesce(F.try_variant_get("item", "$.organisation_number", "string"), F.try_variant_get("item", "$", "string")).alias("org"),
            F.try_variant_get("item", "$.evaluation_split", "string").alias("evaluation_split"),
            F.try_variant_get("item", "$.sample_slice", "string").alias("sample_slice"),
        )
    else:
        lines = file_lines(spark, path)
        if path.endswith(".jsonl"):
            item = F.from_json("value", "organisation_number STRING, evaluation_split STRING, sample_slice STRING")
            raw = lines.select("position", item.alias("i")).select("position", F.col("i.organisation_number").alias("org"), "i.evaluation_split", "i.sample_slice")
        else:
            none = F.lit(None).cast("string")
            raw = lines.select("position", F.col("value").alias("org"), none.alias("evaluation_split"), none.alias("sample_slice"))
    return clean_manifest(raw, check)


def clean_manifest(raw: DataFrame, check: bool = True) -> DataFrame:
    """Digits-only organisation numbers; wrong lengths and duplicates are errors."""
    out = raw.select(
        "position", digits("org").alias("organisation_number"),
        *[c for c in ("evaluation_split", "sample_slice") if c in raw.columns],
    )
    if check:
        require_empty(out.where(F.length("organisation_number") != 9), "invalid organisation number", "organisation_number")
        require_unique(out, ["organisation_number"], "organisation-number input contains duplicates")
    return out


def canonical_json(value: Column | str) -> Column:
    """Compact JSON with sorted keys; the VARIANT type keeps object fields in key order."""
    return F.to_json(F.parse_json(value))


def snapshot_fetch(requests: DataFrame, responses: DataFrame, retrieved_at: str, effective_at: str | None = None) -> DataFrame:
    """Answer each requested URL from stored responses.

    ``responses`` has url, status, body (JSON text), raw_json and optional times. A raw body is
    hashed as it is, a parsed body over its compact sorted JSON.
    """
    raw = F.coalesce(F.col("r.raw_json"), canonical_json("r.body"), F.lit("null"))
    hit = F.col("r.url").isNotNull()
    status = F.when(hit, F.coalesce(F.col("r.status"), F.lit(200))).otherwise(0)
    return (
        requests.alias("q")
        .join(responses.alias("r"), F.col("q.url") == F.col("r.url"), "left")
        .select(
            *[F.col(f"q.`{c}`") for c in requests.columns],
            status.alias("status"),
            F.when(hit & (status == 200), raw).alias("body"),
            F.when(~hit, F.lit("snapshot response missing"))
            .when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))
            .alias("error"),
            F.when(hit, F.sha2(raw, 256)).alias("content_sha256"),
            F.when(hit, F.octet_length(raw)).otherwise(0).alias("bytes_received"),
            F.coalesce("r.retrieved_at", F.lit(retrieved_at)).alias("retrieved_at"),
            F.coalesce("r.effective_at", F.lit(effective_at).cast("string")).alias("effective_at"),
        )
    )


def union_first(*frames: DataFrame, id_column: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Union of observation files in which the first row with an id wins.

    A row without an id is known by its whole content. Rows are ranked by file, then by the columns of
    order, which say a row's place in its file; without any, rows of one file and id are ranked by content.
    """
    ranked = [
        df.withColumn("__file", F.lit(i)) for i, df in enumerate(frames)
    ]
    both = union_all(*ranked)
    content = [c for c in both.columns if not c.startswith("__")]
    key = F.coalesce(F.nullif(F.col(id_column).cast("string"), F.lit("")), F.to_json(F.struct(*content)))
    return first_per_key(both.withColumn("__key", key), ["__key"], ["__file", *(order or [F.to_json(F.struct(*content))])]).select(*content)


def read_frames(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """Order-book frames from JSON lines, with path_id: a column of the records, or the name of the file that holds one path."""
    schema = FRAME_SCHEMA + (f", `{id_column}` STRING" if id_column else "")
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.withColumnRenamed(id_column, "path_id") if id_column else df.withColumn("path_id", F.col("_metadata.file_name"))
