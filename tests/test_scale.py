"""Plans that must hold at scale: scans, shuffles, stages of one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factweave.functions.ids import hash_rank
from factweave.operators import domains, percentiles as Q, sampling as W

ORG = "organisation_number"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts(df):
    """Scans and shuffles of the plan as it is before adaptive execution."""
    text = plan(df)
    return len(re.findall(r"(?:FileScan|Scan ExistingRDD|BatchScan)", text)), len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|RoundRobin)", text))


@pytest.mark.parametrize("name", ["agg_13_latency_summary", "agg_14_index_percentiles", "agg_15_host_fairness", "agg_22_path_summary"])
def test_ranks_take_two_scans_and_few_shuffles(spark, folder, name):
    scans, shuffles = counts(entry.queries()[name](spark, folder))
    assert scans <= 3 and shuffles <= 8


def test_ranks_of_large_groups_come_from_brackets(spark, monkeypatch):
    for name, value in (("ACCURACY", 200), ("SMALL", 160)):
        monkeypatch.setattr(Q, name, value)
    rng = random.Random(1)
    groups = {"even": [rng.random() for _ in range(20_000)], "narrow": [rng.random() * 1e-9 for _ in range(20_000)] + [0.0109], "few": [float(rng.randrange(3)) for _ in range(20_000)], "small": [rng.random() for _ in range(40)], "one": [2.5]}
    rules = {"low": Q.nearest_rank(0), "p10": Q.nearest_rank(0.1), "mid": Q.lower_middle, "up": Q.upper_middle, "p95": Q.scaled_index(0.95), "in95": Q.inner_index(0.95), "max": Q.nearest_rank(1)}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in [*x, None]], "g string, v double").repartition(7)
    for r in Q.rank_values(df, "v", rules, ["g"]).collect():
        x = sorted(groups[r.g])
        n = len(x)
        want = [x[0], x[max(0, -(-n // 10) - 1)], x[(n - 1) // 2], x[n // 2], x[min(n - 1, int(0.95 * n))], x[min(n - 1, int((n - 1) * 0.95))], x[-1]]
        assert [r.n, *[r[k] for k in rules]] == [n, *want], r.g
    # what is ordered is a small share: values inside the brackets, not the group
    bracketed = Q._brackets(df.where("v IS NOT NULL AND g = 'narrow'").select("g", F.col("v").alias("__v")), ["g"], {"mid": Q.lower_middle}).first()
    low, *_, high = bracketed["__r"][0]["b"]
    assert sum(low <= v <= high for v in groups["narrow"]) < 0.1 * 20_001


def test_draws_of_a_third_of_the_table_use_many_tasks(spark):
    reg = spark.range(30_000).select((F.col("id") + 900_000_000).cast("string").alias(ORG)).repartition(6)
    drawn = W.extension_sample(reg, 10_000, seed=5)
    ranks = sorted((r[0], r[1]) for r in reg.select(hash_rank(5, ORG), ORG).collect())
    assert {r[0] for r in drawn.select(ORG).collect()} == {org for _, org in ranks[:10_000]}
    placed = W.first_k(reg.withColumn("rank", hash_rank(5, ORG)), 10_000, [W.bucket("rank")], ["rank", ORG])
    assert [r[0] for r in placed.orderBy("position").select(ORG).collect()] == [org for _, org in ranks[:10_000]]
    assert {r.position for r in placed.collect()} == set(range(10_000))
    split = W.assign_splits(drawn.select(ORG), 10_000, hash_rank(9, ORG))
    assert {r[0]: r[1] for r in split.groupBy("evaluation_split").count().collect()} == {"development": 6000, "validation": 2000, "held_out": 2000}
    # the only exchange into one task carries the histogram, whose size does not grow
    for df in (drawn, placed, split):
        for line in plan(df).splitlines():
            if "SinglePartition" in line or "TakeOrdered" in line:
                assert "__n" in plan(df).split(line)[1].splitlines()[1] or "count" in plan(df).split(line)[1].splitlines()[1], line


def test_draws_larger_than_the_table_and_empty_ones(spark):
    reg = spark.range(50).select((F.col("id") + 900_000_000).cast("string").alias(ORG))
    assert W.extension_sample(reg, 80).count() == 50 and W.extension_sample(reg.limit(0), 5).count() == 0
    assert W.assign_splits(W.extension_sample(reg, 80).select(ORG), 80, hash_rank(1, ORG)).count() == 50


RULES = ["// list", "", "com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "CO.NZ  // note", "github.io", "*.compute.example.com", "a.b.c.d.no"]
HOSTS = {
    "example.com": "example.com", "www.example.com": "example.com", "com": "", "b.example.co.uk": "example.co.uk", "co.uk": "", "example.uk": "example.uk",
    "ck": "", "test.ck": "", "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "c.kobe.jp": "kobe.jp",
    "x.kawasaki.jp": "", "y.x.kawasaki.jp": "y.x.kawasaki.jp", "city.kawasaki.jp": "city.kawasaki.jp", "w.city.kawasaki.jp": "city.kawasaki.jp", "x.co.nz": "x.co.nz",
    "me.github.io": "me.github.io", "github.io": "", "io": "", "unknown.zz": "unknown.zz", "a.unknown.zz": "unknown.zz", "n.west.compute.example.com": "n.west.compute.example.com",
    "west.compute.example.com": "", "compute.example.com": "example.com", "x.a.b.c.d.no": "x.a.b.c.d.no", "b.c.d.no": "d.no", "example.com.": "example.com", "single": "",
}


def test_suffix_rules(spark):
    rules = domains.suffix_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))
    urls = spark.createDataFrame([(i, f"https://{h.upper() if i % 2 else h}/p") for i, h in enumerate(HOSTS)] + [(-1, None), (-2, "no host"), (-3, "https://example.com/again")], "i int, url string")
    got = {r.i: r.url_domain for r in domains.with_domains(urls, ["url"], rules).collect()}
    assert got == dict(enumerate(HOSTS.values())) | {-1: "", -2: "", -3: "example.com"}
    assert {r.url_domain for r in domains.with_domains(urls, ["url"], rules.limit(0)).where("i = 3").collect()} == {"co.uk"}  # without rules, the last label is the suffix


def test_mentions_of_names_of_any_length(spark):
    from factweave.operators import joins as J

    rng = random.Random(4)
    vocabulary = ["fjord", "nord", "av", "og", "for", "æra", "x1"]
    names = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 9, 40, 45)]
    titles = []
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))] + (rng.choice(names) if rng.random() < 0.7 else []) + [rng.choice(vocabulary) for _ in range(rng.randrange(3))]
        titles.append((i, " ".join(words).title() + (" - Avisen" if i % 3 == 0 else "")))
    titles += [(900, None), (901, "")]
    got = J.title_mentions(spark.createDataFrame([(str(i), " ".join(n)) for i, n in enumerate(names)] + [("98", ""), ("99", None)], f"{ORG} string, name string"), spark.createDataFrame(titles, "title_id int, title string"))
    want = set()
    for i, t in titles:
        w = (t or "").lower().removesuffix(" - avisen").split()
        for k, n in enumerate(names):
            if any(w[j : j + len(n)] == n for j in range(len(w)) if j == 0 or w[j - 1] in ("av", "og", "for")):
                want.add((str(k), i))
    assert {(r[ORG], r.title_id) for r in got.collect()} == want and any(len(names[int(k)]) > 35 for k, _ in want)


def test_folding_is_that_of_the_full_table(spark):
    import unicodedata

    texts = ["", "Plain ASCII, 1 x", "Ærlig Øl på Åsen", "Crème brûlée — ñandú", "straße ﬁne Ĳssel ½ １２ ＡＢ", "İstanbul ǅ ª²  x", "éÉ" * 50, None, "\x01\x7f\x80"]
    texts += ["".join(chr(random.Random(i).randrange(0x20, 0x250)) for _ in range(40)) for i in range(60)]

    def fold(t):
        out = []
        for c in (t or "").replace("æ", "ae").replace("Æ", "AE").replace("ø", "o").replace("Ø", "O"):
            plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            out.append(plain if len(plain) == 1 or (plain.isalpha() and unicodedata.category(c)[0] == "L") else "")
        return "".join(out).lower()

    from factweave.functions import text as T

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.fold("t").alias("f")).collect()
    assert {r.i: r.f for r in rows} == {i: fold(t) for i, t in enumerate(texts)}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    from factweave.operators import joins as J
    from factweave.sources import sinks

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        obs = spark.range(400).select((F.col("id") % 50).cast("string").alias(ORG), F.lit("p").alias("platform"), F.col("id").cast("string").alias("retrieved_at"))
        left = sinks.write_bucketed(spark.range(60).select(F.col("id").cast("string").alias(ORG)), "scale_profiles", ORG, 4, str(tmp_path / "a"))
        right = sinks.write_bucketed(obs, "scale_observations", ORG, 4, str(tmp_path / "b"))
        joined = J.observations_by_entity(left, right)
        # count_distinct by platform deals out (entity, platform) once more; the tables themselves are not moved
        text = plan(left.join(right, ORG))
        assert "Exchange" not in text and "SortMergeJoin" in text
        assert joined.count() == 60 and joined.where("observations = 8").count() == 50
        assert len(list((tmp_path / "b").glob("*.parquet"))) == 4
        documents = sinks.write_documents(obs, ORG, "scale_documents", 4, str(tmp_path / "c"))
        assert documents.where(F.col(ORG) == "7").count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ledger_numbers_one_entity_over_many_blocks(spark):
    from factweave.operators import contract as C

    profiles = spark.createDataFrame([("1", "available", True, "https://a/", ""), ("2", None, None, None, "b.no")], f"{ORG} string, website_status string, website_publishable boolean, website_url string, registry_site string").withColumn("roles_status", F.lit("available")).withColumn("website_score", F.lit(0.9))
    items = spark.range(9000).select(F.lit("1").alias(ORG), F.lit("news").alias("kind"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.lit("q").alias("quote"))
    socials = spark.range(5000).select(F.lit("1").alias(ORG), F.lit("x").alias("platform"), F.concat(F.lit("https://x.com/"), F.lpad(F.col("id").cast("string"), 30, "0")).alias("url"))
    entries = C.ledger(profiles, site_items=items.unionByName(items.limit(3).withColumn(ORG, F.lit("2"))), socials=socials)
    rows = [r for r in entries.collect() if r[ORG] == "1"]
    ids = {r.evidence_id: r.value for r in rows if r.kind == "fact"}
    # two heads (roles, website) come first, then the news by place, then the accounts by address
    assert len(ids) == 14_000 and ids["ev-web-2"] == "v0" and ids["ev-web-9001"] == "v8999" and ids["ev-web-9002"].endswith("/" + "0" * 30) and ids["ev-web-14001"].endswith("4999")
    assert {r.kind for r in rows} == {"head", "fact", "shared"} and [r.field for r in entries.where(f"{ORG} = '2' AND kind <> 'head'").orderBy("field").collect()] == ["official_website", "roles"]
    text = plan(entries.select("*"))  # not run yet, so it is the plan before adaptive execution
    assert text.count("FileScan") <= 8
    assert not [line for line in text.splitlines() if "Window" in line and f"[{ORG}" in line and "block" not in line]


def test_only_unequal_buckets_are_read(spark, tmp_path):
    from factweave.operators import refresh as R

    rows = [(str(i), f"n{i}", {"k": i}) for i in range(3000)]
    schema = f"{ORG} string, name string, extra map<string,int>"
    old = R.Snapshot.write(spark.createDataFrame(rows, schema), str(tmp_path / "old"))
    changed = [(o, "new" if o in ("7", "1234") else n, {"k": 0} if o == "99" else x) for o, n, x in rows]
    new = R.Snapshot.write(spark.createDataFrame(changed, schema).repartition(5), str(tmp_path / "new"))
    leaves = old.unequal(new)
    assert len(leaves) == 3 and old.unequal(old) == []
    read = new.rows(leaves)
    assert 3 <= read.count() < 30 and re.search(r"PartitionFilters: \[[^\]]*__part#\d+ IN", plan(read)) and re.search(r"PushedFilters: \[[^\]]*__leaf", plan(read))
    got = R.diff_snapshots(old, new, {"registry.name": "name", "registry.extra": "extra"}).collect()
    assert {(r[ORG], r.field, r.new_value) for r in got} == {("7", "registry.name", "new"), ("1234", "registry.name", "new"), ("99", "registry.extra", '{"k":0}')}
    assert R.diff_snapshots(new, new, ["name"]).count() == 0
    with pytest.raises(Exception, match="datasets differ in membership: 5"):
        R.diff_snapshots(old, R.Snapshot.write(spark.createDataFrame([r for r in rows if r[0] != "5"], schema), str(tmp_path / "less")), ["name"]).count()


def test_tables_of_one_file_are_dealt_over_all_cores(spark, folder):
    from factweave.plans import base, identity

    for made in (base.registry_raw, base.feed, identity.social_links):
        assert made(spark, folder).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism, made.__name__


def test_feed_entries_are_parsed_once(spark, folder):
    from factweave.operators import feed, normalise
    from factweave.plans import base
    from factweave.sources.pages import feed_entries

    pages = spark.createDataFrame([(0, '{"items": [{"id": "a"}, null, {"id": "b"}]}'), (1, '{"items": []}'), (2, "{}"), (3, None)], "page long, document string")
    index = feed.job_index(normalise.parse_feed(base.feed(spark, folder)))
    assert len(re.findall(r"parseJson", index._jdf.queryExecution().optimizedPlan().toString())) == 1
    entries = feed_entries(pages)
    assert len(re.findall(r"JsonToStructsEvaluator|from_json", entries._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert sorted((r.page, r.position, r.entry) for r in entries.collect() if r.entry) == [(0, 0, '{"id":"a"}'), (0, 2, '{"id":"b"}')]
    assert entries.count() == 3


def test_a_store_of_many_pages_is_read_in_few_tasks(tmp_path):
    from factweave.sources import pages as P

    for n in (0, 5, 16_384, 360_000, 3_000_000):
        ranges = P._ranges(3, 3 + n, 16)
        assert [p for r in ranges for p in (r.first, r.end - 1)] == sorted(p for r in ranges for p in (r.first, r.end - 1))
        assert sum(r.end - r.first for r in ranges) == n and (not n or (ranges[0].first, ranges[-1].end) == (3, 3 + n))
        assert len(ranges) <= max(1024, -(-n // 1024))
    import pyarrow as pa

    store = P.Store(str(tmp_path))
    store.write([pa.RecordBatch.from_pydict({"page": list(range(9)), "document": [f'{{"items": [{i}]}}' for i in range(9)]})])
    batches = list(store.read(2, 9))
    assert len(batches) == 1 and batches[0]["page"].to_pylist() == list(range(2, 9)) and batches[0]["document"].to_pylist()[0] == '{"items": [2]}'


def test_titles_are_not_dealt_with_every_entity_they_name(spark):
    from factweave.operators import observations as O

    names = spark.createDataFrame([("100000001", "Alfa"), ("100000002", "Alfa Beta")], f"{ORG} string, name string")
    rows = [(1, "Alfa Beta vinner", "l", "p", None), (1, "Alfa Beta vinner", "l", "p", None), (1, "ALFA beta taper", "m", "p", "d"), (2, "ALFA BETA VINNER", "l", "P", None), (3, "Alfa Beta vinner", "", "q", None), (4, "Alfa", "l", None, None)]
    titles = spark.createDataFrame(rows, "title_id long, title string, link string, publisher string, published_at string")
    out = O.mention_observations(names, titles, "2026-01-01T00:00:00Z")
    got = sorted((r[ORG], r.evidence_span, r.source_url, r.effective_at) for r in out.collect())
    assert got == sorted([("100000001", "Alfa", "l", None)] + [(o, t, u, e) for o in ("100000001", "100000002") for t, u, e in (("Alfa Beta vinner", "l", None), ("ALFA beta taper", "m", "d"))])
    text = plan(out)
    assert not re.search(r"Exchange hashpartitioning\(organisation_number#\d+, (?:lower|__t#\d+, __p#\d+, title)", text)
    assert not any("title#" in line for line in re.findall(r"Window \[[^\n]*", text))


def test_a_gate_on_observations_computes_each_column_once(spark, folder):
    from factweave.operators import gates as G
    from factweave.plans import base

    gated = base.observations(spark, folder).where(G.publishable()).select(ORG, "retrieved_at")
    optimised = gated._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("regexp_extract(props") == 1 and optimised.count("date_format(") == 1 and "Repartition" in optimised
    assert max(line.count("CASE WHEN") for line in optimised.splitlines() if line.lstrip(" +-:").startswith("Filter")) <= 3


def test_ledger_rows_are_read_twice_and_sources_join_by_entity(spark, tmp_path):
    from factweave.operators import contract as C

    states = "registry_status string, financials_status string, roles_status string, locations_status string, website_status string, website_publishable boolean, website_url string, website_score double, registry_site string"
    profiles = spark.createDataFrame([("1", "available", None, "available", None, "available", True, "https://a/", None, "a.no"), ("2", None, "not_found", None, None, "not_found", None, None, None, " "), ("3", None, None, None, None, "blocked", None, None, None, "c.no")], f"{ORG} string, {states}")
    records = spark.createDataFrame([("1", 1, "2024", 5.0, None), ("1", 2, "2023", None, None), ("2", 1, "2024", None, None)], f"{ORG} string, seq int, period string, revenue double, debt double")
    items = spark.createDataFrame([(o, "news", n, v, v) for o in "13" for n, v in ((None, "a"), (1, "b"), (9000, "c"))], f"{ORG} string, kind string, seq int, value string, quote string")
    entries = C.ledger(profiles, records=records, site_items=items, socials=spark.createDataFrame([("1", "x", "u"), ("3", "x", "u")], f"{ORG} string, platform string, url string"))
    assert plan(entries.select("*")).count("FileScan") == 2
    got = {(r[ORG], r.kind, r.field, r.value, r.evidence_id) for r in entries.collect()}
    assert got == {
        ("1", "head", None, None, "ev-registry"), ("1", "fact", "financials.revenue", "5.0", "ev-fin-1"), ("1", "head", None, None, "ev-roles"), ("1", "shared", "roles", None, "ev-roles"),
        ("1", "head", None, None, "ev-website"), ("1", "shared", "official_website", "https://a/", "ev-website"), ("1", "fact", "news", "a", "ev-web-3"), ("1", "fact", "news", "b", "ev-web-5"),
        ("1", "fact", "news", "c", "ev-web-6"), ("1", "fact", "social.x", "u", "ev-web-7"), ("2", "head", None, None, "ev-financials"), ("2", "head", None, None, "ev-website"),
        ("2", "shared", "official_website", None, "ev-website"), ("3", "head", None, None, "ev-website"), ("3", "shared", "official_website", "c.no", "ev-registry"), ("3", "fact", "social.x", "u", "ev-web-1"),
    }
    sources = spark.createDataFrame([("1", "r", "w"), ("1", "r2", "w2"), ("2", "q", None)], f"{ORG} string, registry_source_url string, website_source_url string")
    claimed = spark.createDataFrame([("1", "ev-web-3", "s"), ("1", "ev-web-3", "t"), ("1", "ev-registry", None), ("1", "other", None), ("2", "ev-website", "v"), ("9", "ev-fin-1", "x")], f"{ORG} string, evidence_id string, span string")
    known = C.evidence(claimed, sources)
    assert "module" not in "".join(re.findall(r"Exchange hashpartitioning[^\n]*", plan(known)))
    assert sorted(tuple(str(x) for x in r) for r in known.select(ORG, "evidence_id", "source_url", "span").collect()) == sorted([
        ("1", "ev-web-3", "w", "t"), ("1", "ev-web-3", "w2", "t"), ("1", "ev-registry", "r", "None"), ("1", "ev-registry", "r2", "None"), ("1", "other", "None", "None"), ("2", "ev-website", "None", "v"), ("9", "ev-fin-1", "None", "x"),
    ])
