"""Queries over the streaming jobs; each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.pages import Store, feed_pages, write_pages
from ..streaming import changes as C, jobs as J
from . import base
from .catalog import load, query
from .ranking import crawl_log

ORG = "organisation_number"


def _landings(df, path: str, order: str, parts: int = 3):
    """Write the rows as slices in ``order``, each at its natural parallelism; yields when a slice has landed."""
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0]
    slice_ = F.when(F.lit(False), 0)
    for i, cut in enumerate(cuts):
        slice_ = slice_.when(F.col(order) <= cut, i)
    sliced = df.withColumn("__slice", slice_.otherwise(parts - 1))
    for i in range(parts):
        sliced.where(F.col("__slice") == i).drop("__slice").write.mode("append").json(path)
        yield i


def _feed_landings(entries, path: str, parts: int = 3, size: int = 200):
    """Write the entries as feed pages in their order, a slice at a time; yields when a slice has landed."""
    cuts = entries.agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)])).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        slice_ = entries if low is None else entries.where(F.col("seq") > low)
        slice_ = slice_ if high is None else slice_.where(F.col("seq") <= high)
        write_pages(feed_pages(slice_, size, first=Store(path).end()), path)
        yield low


@query("str_01_job_feed", base.oracle("job_index", "SELECT organisation_number, job_id, title, updated FROM job_index"))
def job_feed(spark, folder):
    home = shared_folder(spark, "job-feed")
    for _ in _feed_landings(base.feed(spark, folder), f"{home}/pages"):
        index = J.job_feed_stream(spark, f"{home}/pages", f"{home}/state", f"{home}/out")
    return index.select(ORG, "job_id", "title", "updated")


@query(
    "str_02_footprint_windows",
    f"""SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS observations, CAST(sum({base._K}) AS BIGINT) AS engagement FROM events GROUP BY 1, 2""",
)
def footprint_windows(spark, folder):
    home = shared_folder(spark, "footprint")
    rows = load(spark, folder, "events").select(
        (F.col("user_id") + 100000000).cast("string").alias(ORG), F.col("ts").cast("timestamp").alias("ts"), F.expr(base._K).cast("long").alias("engagement"), F.col("event_id").alias("seq")
    )
    for _ in _landings(rows, f"{home}/in", "seq"):
        out = J.footprint_stream(spark, f"{home}/in", rows.schema, f"{home}/state", f"{home}/out")
    return out.select(ORG, F.date_format("window_start", "yyyy-MM-dd").alias("day"), "observations", "engagement")


def _shuffled(df, path: str, parts: int = 3):
    """Write the rows in slices that have nothing to do with their order; yields when a slice has landed."""
    for i in range(parts):
        df.where(F.pmod(F.xxhash64("seq"), F.lit(parts)) == i).write.mode("append").json(path)
        yield i


@query(
    "str_03_change_events",
    """SELECT CAST(o_custkey AS VARCHAR) AS organisation_number, 'status' AS field, o_orderkey AS seq, old AS old_value, o_orderstatus AS new_value FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old FROM orders) WHERE old IS NOT NULL AND old <> o_orderstatus""",
)
def change_events(spark, folder):
    """Rows land out of their order, which is that of the order number alone."""
    home = shared_folder(spark, "changes")
    rows = load(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias(ORG), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"), F.timestamp_seconds("o_orderkey").alias("ts"))
    for _ in _shuffled(rows, f"{home}/in"):
        changes = C.change_stream(spark, f"{home}/in", rows.schema, f"{home}/state", f"{home}/out")
    return changes


@query(
    "str_03_change_events_late",
    """SELECT CAST(o_custkey AS VARCHAR) AS organisation_number, f AS field, o_orderkey AS seq, old AS old_value, value AS new_value FROM (
    SELECT *, lag(value) OVER (PARTITION BY o_custkey, f ORDER BY o_orderdate, o_orderkey) AS old FROM (
    SELECT o_custkey, o_orderkey, o_orderdate, unnest([{'f': 'status', 'value': o_orderstatus}, {'f': 'priority', 'value': o_orderpriority}], recursive := true) FROM orders)) WHERE old IS NOT NULL AND old <> value""",
)
def change_events_late(spark, folder):
    """Two fields by order date; slices land out of order, but none later than the delay behind the latest date."""
    home = shared_folder(spark, "late-changes")
    fields = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]))
    rows = load(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias(ORG), fields, F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    for _ in _shuffled(rows, f"{home}/in"):
        changes = C.change_stream(spark, f"{home}/in", rows.schema, f"{home}/state", f"{home}/out", bucket="1000 days", delay="4000 days")
    return changes


@query("str_04_event_dedupe", base.oracle("crawl_log", "SELECT DISTINCT organisation_number, page_kind, final_url, content_sha256, status FROM crawl_log"))
def event_dedupe(spark, folder):
    home = shared_folder(spark, "dedupe")
    rows = crawl_log(load(spark, folder, "events"))
    for _ in _landings(rows, f"{home}/in", "seq"):
        log = J.dedupe_stream(spark, f"{home}/in", rows.schema, f"{home}/state", f"{home}/out")
    return log.drop("seq", "ts")
