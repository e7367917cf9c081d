"""Queries over readers and writers. Each writes a derived file set and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.blocks import number_rows
from ..operators.rows import union_all
from ..session import shared_folder
from ..sources import readers, sinks
from ..sources.pages import Store, feed_entries, feed_pages, read_pages, snapshot_responses, write_pages
from ..streaming import jobs as streams
from . import base
from .catalog import load, query

_REGISTRY_OUT = ["organisation_number", "name", "employees", "bankrupt", "website"]


@query("src_01_registry_csv", base.oracle("entities", "SELECT organisation_number, name, employees, bankrupt, website FROM entities"))
def registry_csv(spark, folder):
    from ..operators.normalise import normalise_registry

    path = shared_folder(spark, "registry-csv")
    raw = base.registry_raw(spark, folder).drop("c_custkey")
    raw.write.option("header", True).option("sep", ";").option("compression", "gzip").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return normalise_registry(readers.read_registry_csv(spark, path)).select(*_REGISTRY_OUT)


@query("src_02_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")
def jsonl(spark, folder):
    path = shared_folder(spark, "events-jsonl")
    rows = load(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    # every record is followed by a blank line, which the reader has to skip
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, rows.schema)


@query(
    "src_03_manifest",
    "SELECT CAST(100000000 + c_custkey AS VARCHAR) AS organisation_number, c_mktsegment AS evaluation_split FROM customer",
)
def manifest(spark, folder):
    path = shared_folder(spark, "manifest") + ".jsonl"
    key = (F.col("c_custkey") + 100000000).cast("string")
    spaced = F.concat_ws(" ", F.substring(key, 1, 3), F.substring(key, 4, 3), F.substring(key, 7, 3))
    load(spark, folder, "customer").select(
        F.to_json(F.struct(spaced.alias("organisation_number"), F.col("c_mktsegment").alias("evaluation_split"))).alias("value")
    ).write.text(path)
    return readers.read_manifest(spark, path).select("organisation_number", "evaluation_split")


@query(
    "src_03_manifest_forms",
    """SELECT f AS form, CAST(100000000 + c_custkey AS VARCHAR) AS organisation_number, row_number() OVER (PARTITION BY f ORDER BY c_custkey) - 1 AS position FROM customer, (VALUES ('lines'), ('list'), ('object'), ('text')) t(f)""",
)
def manifest_forms(spark, folder):
    """The same manifest as JSON lines, JSON list, JSON object and plain text, each with the place of every number."""
    key = (F.col("c_custkey") + 100000000).cast("string")
    numbers = load(spark, folder, "customer").select(key.alias("n"), "c_custkey").orderBy("c_custkey")
    whole = numbers.agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "n"))), lambda x: x["n"]).alias("n"))  # one document by its form
    forms = {
        "lines": (".jsonl", numbers.select(F.to_json(F.struct(F.col("n").alias("organisation_number"))))), "text": (".txt", numbers.select(F.concat("n", F.lit(" "), F.lit("\n")))),
        "list": (".json", whole.select(F.to_json("n"))), "object": (".json", whole.select(F.to_json(F.struct(F.col("n").alias("organisation_numbers"))))),
    }
    out = []
    for form, (end, rows) in forms.items():
        path = shared_folder(spark, "manifest") + end
        rows.write.text(path)
        out.append(readers.read_manifest(spark, path, check=False).select(F.lit(form).alias("form"), "organisation_number", F.col("position").cast("long").alias("position")))
    return union_all(*out)


@query(
    "src_04_snapshot_responses",
    """SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderstatus = 'F' THEN 404 ELSE 200 END AS status,
    CASE WHEN o_orderstatus = 'P' THEN 'snapshot response missing' WHEN o_orderstatus = 'F' THEN 'HTTP 404' END AS error,
    CASE WHEN o_orderstatus <> 'P' THEN sha256('{"a":"' || o_orderpriority || '","b":' || CAST(o_custkey AS VARCHAR) || '}') END AS content_sha256,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN '2026-02-02T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS retrieved_at
    FROM orders""",
)
def snapshot(spark, folder):
    orders = load(spark, folder, "orders")
    url = F.concat(F.lit("https://source.example/"), F.col("o_orderkey").cast("string"))
    requests = orders.select(F.col("o_orderkey").alias("request_id"), url.alias("url"))
    none = F.lit(None).cast("string")
    # keys out of order: the hash is over sorted compact JSON
    body = F.concat(F.lit('{ "b": '), F.col("o_custkey").cast("string"), F.lit(', "a": "'), F.col("o_orderpriority"), F.lit('" }'))
    responses = orders.where("o_orderstatus <> 'P'").select(
        url.alias("url"),
        F.when(F.col("o_orderstatus") == "F", 404).otherwise(200).alias("status"),
        body.alias("body"), none.alias("raw_json"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("2026-02-02T00:00:00Z")).alias("retrieved_at"),
        none.alias("effective_at"),
    )
    return readers.snapshot_fetch(requests, responses, "2026-01-01T00:00:00Z").select("request_id", "status", "error", "content_sha256", "retrieved_at")


@query(
    "src_04_stored_snapshots",
    """SELECT 'https://source.example/' || CAST(o_orderkey AS VARCHAR) AS url, CASE WHEN o_orderstatus = 'F' THEN 404 ELSE 200 END AS status, o_custkey AS customer,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '2026-02-02T00:00:00Z' ELSE '2026-01-0' || CAST(1 + o_custkey % 3 AS VARCHAR) END AS retrieved_at FROM orders""",
)
def stored_snapshots(spark, folder):
    """Snapshots of a few hundred responses each, read back from a store of pages; a response's time falls back on its snapshot's."""
    path = shared_folder(spark, "snapshots")
    response = F.struct(
        F.when(F.col("o_orderstatus") == "F", 404).otherwise(200).alias("status"), F.struct(F.col("o_custkey").alias("customer")).alias("body"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("2026-02-02T00:00:00Z")).alias("retrieved_at"),
    )
    day = F.concat(F.lit("2026-01-0"), (1 + F.col("o_custkey") % 3).cast("string"))
    orders = load(spark, folder, "orders")
    parts = F.ceil(F.lit(orders.count()) / 600)  # pages of about two hundred responses, three days each
    rows = orders.select(day.alias("retrieved_at"), F.pmod(F.xxhash64("o_orderkey"), parts).alias("part"), F.struct(F.concat(F.lit("https://source.example/"), F.col("o_orderkey").cast("string")).alias("key"), response.alias("value")).alias("r"))
    pages = rows.groupBy("retrieved_at", "part").agg(F.to_json(F.struct("retrieved_at", F.map_from_entries(F.collect_list("r")).alias("responses"))).alias("document"))
    write_pages(number_rows(pages, [], F.col("part"), ["retrieved_at"], "page"), path)
    out = snapshot_responses(read_pages(spark, path))
    return out.select("url", "status", F.get_json_object("body", "$.customer").cast("long").alias("customer"), "retrieved_at")


@query("src_05_feed_landing", base.oracle("jobs_parsed", "SELECT seq, job_id, active, organisation_number, title, published, updated FROM jobs_parsed"))
def landing(spark, folder):
    src, home = shared_folder(spark, "feed-pages"), shared_folder(spark, "feed-landing")
    told = F.concat(F.lit('{"_seq": '), F.col("seq").cast("string"), F.lit(", "), F.substring("entry", 2, 1 << 30))
    entries = base.feed(spark, folder).withColumn("entry", told)
    early = F.xxhash64("seq") % 2 == 0
    write_pages(feed_pages(entries.where(early), 100), src)
    streams.land_feed(spark, src, f"{home}/cursor", f"{home}/table")
    write_pages(feed_pages(entries.where(~early), 100, first=Store(src).end()), src)  # the second run resumes behind the cursor and adds only these
    landed = streams.land_feed(spark, src, f"{home}/cursor", f"{home}/table")
    # the number that an entry carries says which row it was; seq says where it stood in the store
    back = feed_entries(read_pages(spark, src)).select((F.col("page") * streams.PAGE_ROOM + F.col("position")).alias("place"), F.get_json_object("entry", "$._seq").cast("long").alias("seq"))
    return landed.withColumnRenamed("seq", "place").join(back, "place").select("seq", "job_id", "active", "organisation_number", "title", "published", "updated")


@query(
    "src_06_union_first",
    """WITH u AS (SELECT CAST(user_id % 40 AS VARCHAR) || '-' || props AS id, event_id, 0 AS f FROM events WHERE event_type <> 'click'
    UNION ALL SELECT CAST(user_id % 40 AS VARCHAR) || '-' || props, event_id, 1 FROM events WHERE event_type <> 'view')
    SELECT id, min(f) AS source_file, arg_min(event_id, (f, event_id)) AS event_id FROM u GROUP BY id""",
)
def union_first(spark, folder):
    events = load(spark, folder, "events").withColumn("id", F.concat_ws("-", (F.col("user_id") % 40).cast("string"), "props"))
    a = events.where("event_type <> 'click'").select("id", "event_id", F.lit(0).alias("source_file"))
    b = events.where("event_type <> 'view'").select("id", "event_id", F.lit(1).alias("source_file"))
    return readers.union_first(a, b, order=["event_id"]).select("id", "source_file", "event_id")


@query(
    "src_07_frames",
    """SELECT 'path_' || CAST(user_id AS VARCHAR) AS path, COUNT(*) AS frames, SUM(CAST(value AS DECIMAL(18,2))) AS price_sum,
    SUM(len(regexp_extract_all(props, '[0-9]'))) AS ask_levels FROM events GROUP BY 1""",
)
def frames(spark, folder):
    path = shared_folder(spark, "frames")
    size = F.length(F.regexp_replace("props", "[^0-9]", ""))
    asks = F.transform(F.sequence(F.lit(1), size), lambda i: F.array(F.lit(0.5) + i / 100.0, F.lit(5.0)))
    book = F.struct(asks.alias("asks"), F.array(F.array(F.lit(0.5), F.lit(5.0))).alias("bids"), F.lit(5.0).alias("minOrderSize"))
    frame = load(spark, folder, "events").select(
        F.concat(F.lit("path_"), F.col("user_id").cast("string")).alias("path"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"),
        F.struct(F.lit("m").alias("id"), F.lit(60.0).alias("secondsToClose")).alias("market"),
        F.struct(F.col("value").alias("btcMidUsd")).alias("reference"),
        F.struct(book.alias("YES"), book.alias("NO")).alias("books"),
    )
    frame.write.json(path)
    return (
        readers.read_frames(spark, path, "path")
        .groupBy(F.col("path_id").alias("path"))
        .agg(
            F.count("*").alias("frames"),
            F.sum(F.col("reference.btcMidUsd").cast("decimal(18,2)")).alias("price_sum"),
            F.sum(F.size("books.YES.asks")).cast("long").alias("ask_levels"),
        )
    )


@query(
    "snk_01_jsonl_in_order",
    "SELECT o_orderkey AS position, o_custkey, o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS line_rank FROM orders",
)
def jsonl_in_order(spark, folder):
    path = shared_folder(spark, "ordered-jsonl")
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("position"), "o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_jsonl(orders, path, "position")
    back = spark.read.schema("o_orderkey LONG, o_custkey LONG, o_orderstatus STRING").json(path)
    # a line's rank is what its file and its place in the file say; nothing is sorted again by key
    lines = back.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # numbers grow by one within a block of a file; blocks are few
    per_block = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(per_block.withColumn("before", before), ["file", "block"]).select(
        F.col("o_orderkey").alias("position"), "o_custkey", "o_orderstatus", (F.col("before") + F.col("at") - F.col("first")).alias("line_rank")
    )


@query("snk_02_resume", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS run FROM customer")
def resume(spark, folder):
    path = shared_folder(spark, "resume") + "/done"
    customers = load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")

    def work(run):
        return lambda todo: todo.select("c_custkey", "c_name", F.lit(run).alias("run"))

    sinks.resume(spark, customers.where("c_acctbal < 0"), ["c_custkey"], path, work(1))
    sinks.resume(spark, customers, ["c_custkey"], path, work(2))
    return sinks.resume(spark, customers, ["c_custkey"], path, work(3))


@query(
    "snk_03_csv_export",
    base.oracle("entities", "SELECT name, organisation_number, municipality, industry_label FROM entities WHERE website <> ''"),
)
def csv_export(spark, folder):
    path = shared_folder(spark, "export")
    rows = base.entities(spark, folder).where("website <> ''").select("name", "organisation_number", "municipality", "industry_label")
    sinks.export_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path).fillna("", ["industry_label"])


@query(
    "snk_04_entity_documents",
    base.oracle("entities", "SELECT organisation_number, name AS doc_name, employees AS doc_employees FROM entities"),
)
def documents(spark, folder):
    path = shared_folder(spark, "documents")
    table = sinks.write_documents(base.entities(spark, folder), "organisation_number", path.rsplit("/", 1)[-1].replace("-", "_"), 8, path)
    return table.select(
        "organisation_number",
        F.get_json_object("document", "$.name").alias("doc_name"),
        F.get_json_object("document", "$.employees").try_cast("int").alias("doc_employees"),
    )

