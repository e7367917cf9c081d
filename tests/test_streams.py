"""Streams against their batch twins: order of arrival, replays, late rows, merged tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factweave.sources import pages as P
from factweave.streaming import changes as C, jobs as J
from factweave.streaming.tables import UpsertTable

SCHEMA = "organisation_number string, field string, value string, seq long, ts timestamp"
START = datetime.datetime(2026, 1, 1)


def day(n):
    return START + datetime.timedelta(days=n)


class Stream:
    def __init__(self, spark, home, **how):
        self.spark, self.home, self.how = spark, home, how
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def land(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).write.mode("append").json(f"{self.home}/in")
        out = C.change_stream(self.spark, f"{self.home}/in", self.schema, f"{self.home}/cp", f"{self.home}/out", **self.how)
        return sorted((r.organisation_number, r.seq, r.old_value, r.new_value) for r in out.collect())


def batch(rows):
    out, by = [], {}
    for org, field, value, seq, ts in rows:
        by.setdefault((org, field), {})[ts, seq] = value
    for (org, _), values in by.items():
        order = sorted(values)
        out += [(org, p[1], values[q], values[p]) for q, p in zip(order, order[1:]) if values[q] != values[p]]
    return sorted(out)


def test_a_late_row_takes_back_what_it_makes_wrong(spark, tmp_path):
    s = Stream(spark, tmp_path)
    assert s.land([("a", "f", "A", 1, day(1)), ("a", "f", "C", 3, day(3))]) == [("a", 3, "A", "C")]
    assert s.land([("a", "f", "B", 2, day(2))]) == [("a", 2, "A", "B"), ("a", 3, "B", "C")]
    assert s.land([("a", "f", "C", 2, day(2))]) == [("a", 2, "A", "C")]  # of one place the greatest value counts
    assert s.land([("a", "f", "B", 2, day(2)), ("a", "f", None, None, day(2)), ("a", "f", "x", 9, None)]) == [("a", 2, "A", "C")]


def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), "f", rng.choice("XYZ"), i, day(rng.randrange(90))) for i in range(300)]
    rng.shuffle(rows)
    s = Stream(spark, tmp_path, bucket="7 days", delay="100 days")
    for i in range(3):
        got = s.land(rows[100 * i : 100 * i + 100])
    assert got == batch(rows)
    assert s.land(rows[:50]) == batch(rows)  # repeated rows change nothing


def test_rows_behind_the_watermark_are_dropped_and_their_state_is_gone(spark, tmp_path):
    s = Stream(spark, tmp_path, bucket="1 day", delay="1 day")
    s.land([("a", "f", "A", 1, day(1)), ("a", "f", "B", 20, day(20))])
    s.land([("a", "f", "C", 30, day(30))])  # now the watermark stands at day 19 or later
    assert s.land([("a", "f", "Z", 2, day(2))]) == [("a", 20, "A", "B"), ("a", 30, "B", "C")]


def test_upsert_table_merges_and_reads_little(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"])
    with pytest.raises(ValueError):
        table.read()
    rows = {}
    for n in range(12):
        size = 3000 if n == 0 else 100
        new = {(i * 7 + n) % 4000: n * 10_000 + i for i in range(size)}
        rows |= new
        table.write(spark.createDataFrame(list(new.items()), "k long, v long"), n)
    base, batches = table.state()
    assert base is not None and len(batches) < 12 and len(list((tmp_path / "t").glob("batch_id=*"))) == len(batches) and len(list((tmp_path / "t" / "base").glob("upto=*"))) == 1
    assert {r.k: r.v for r in table.read().collect()} == rows
    table.write(spark.createDataFrame([(1, -1)], "k long, v long"), base)  # a replay of a batch that is merged already
    assert {r.k: r.v for r in table.read().collect()} == rows
    assert sum(r[0] for r in table.read().select(F.count("*")).collect()) == len(rows)


def entry(n, status="ACTIVE"):
    return '{"id":"j%d","_feed_entry":{"status":"%s","title":"T%d","employer":{"orgnr":"923 609 016"},"published":"2026-01-01","updated":"2026-01-%02d"}}' % (n % 7, status, n, n % 28 + 1)


def test_pages_are_read_whole_and_behind_a_cursor(spark, tmp_path):
    store = str(tmp_path / "pages")
    assert P.read_pages(spark, store).count() == 0 and P.Store(store).end() == 0
    rows = spark.createDataFrame([(3 * i, entry(i)) for i in range(95)], "seq long, entry string")
    P.write_pages(P.feed_pages(rows.where("seq < 150"), 10), store)
    assert P.Store(store).end() == 5
    first = J.land_feed(spark, store, str(tmp_path / "cp"), str(tmp_path / "table"))
    assert first.count() == 50
    P.write_pages(P.feed_pages(rows.where("seq >= 150"), 10, first=5), store)
    (tmp_path / "pages" / "page-000000099.json").write_text('{"items": []}')  # behind a gap: not there yet
    landed = J.land_feed(spark, store, str(tmp_path / "cp"), str(tmp_path / "table"))
    assert P.Store(store).end() == 10 and landed.count() == 95
    assert [r.title for r in landed.orderBy("seq").collect()] == [f"T{i}" for i in range(95)]
    assert P.read_pages(spark, store, per_task=3).rdd.getNumPartitions() == 4


def test_a_failed_batch_is_read_again_alike(spark, tmp_path):
    store, seen = str(tmp_path / "pages"), []
    P.write_pages(P.feed_pages(spark.createDataFrame([(i, entry(i)) for i in range(25)], "seq long, entry string"), 10), store)

    def run(fail):
        def write(batch, n):
            seen.append((n, sorted((r.page, r.position, r.entry) for r in batch.collect())))
            if fail:
                raise ValueError("lost")

        P.feed_entries(P.read_pages(spark, store, stream=True)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(True)
    P.write_pages(P.feed_pages(spark.createDataFrame([(i, entry(i)) for i in range(5)], "seq long, entry string"), 10, first=3), store)  # arrives in between
    run(False)
    run(False)
    assert [(n, len(x)) for n, x in seen] == [(0, 25), (0, 25), (1, 5)] and seen[0] == seen[1]


def test_stored_responses_fall_back_on_their_snapshot(spark):
    page = '{"retrieved_at": "T0", "responses": {"https://a/": {"status": 200, "body": {"b": 1}}, "https://b/": {"status": 404, "retrieved_at": "T1", "raw_json": "x"}}}'
    got = P.snapshot_responses(spark.createDataFrame([(0, page)], P.SCHEMA)).orderBy("url").collect()
    assert [tuple(r) for r in got] == [("https://a/", 200, '{"b":1}', None, "T0", None), ("https://b/", 404, None, "x", "T1", None)]


def test_late_rows_of_an_open_bucket_count_and_values_may_be_null(spark, tmp_path):
    s = Stream(spark, tmp_path, bucket="10 days", delay="5 days")
    s.land([("a", "f", "A", 1, day(1)), ("a", "f", "B", 9, day(14))])
    assert s.land([("a", "f", None, 5, day(11))]) == [("a", 5, "A", None), ("a", 9, None, "B")]
    spark.createDataFrame([(None, "f", "x", 1, day(12)), (None, "f", "y", 2, day(13))], SCHEMA).write.mode("append").json(f"{tmp_path}/in")
    C.change_stream(spark, f"{tmp_path}/in", s.schema, f"{tmp_path}/cp", f"{tmp_path}/out", **s.how)
    got = {(r.organisation_number, r.seq, r.old_value, r.new_value) for r in C.changes(C.UpsertTable(spark, f"{tmp_path}/out", [*C.KEY, "bucket"]).read()).collect()}
    assert got == {("a", 5, "A", None), ("a", 9, None, "B"), (None, 2, "x", "y")}


def test_change_state_holds_no_python(spark, tmp_path):
    """Groups of state cost a call into Python each; at scale there are as many as entities, fields and buckets."""
    s = Stream(spark, tmp_path)
    s.land([("a", "f", "A", 1, day(1)), ("a", "f", "B", 2, day(2))])
    state = next((tmp_path / "cp" / "state" / "0").glob("_metadata/**/*"), None)
    text = "".join(p.read_text(errors="ignore") for p in (tmp_path / "cp" / "state" / "0" / "_metadata").rglob("*") if p.is_file())
    assert state is not None and "stateStoreSave" in text and "transformWithState" not in text
