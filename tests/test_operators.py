import pytest
from pyspark.sql import functions as F

from factweave.functions import constants as K
from factweave.operators import contract as C, evaluate as E, extract as X, feed, footprint as P, gates as G, identity as I, joins as J
from factweave.operators import normalise as N, observations as O, percentiles as Q, refresh as R, sampling as W, screen as S
from factweave.operators.blocks import number_rows, running_max

ORG = "organisation_number"
OBS = (
    "id string, organisation_number string, platform string, signal_type string, source_url string, retrieved_at string, content_sha256 string, exact_entity boolean,"
    " identity_proof array<struct<type:string,value:string>>, acquisition_mode string, rights_status string, source_class string, evidence_span string, sentiment_label string,"
    " sentiment_model_version string, reviewer_id string, strategy string, likes long, comments long, shares long, rating double, review_count long"
)
GOOD = ("o1", "923609016", "google_places", "review", "https://a.no/1", "2026-01-01T00:00:00Z", "a" * 64, True, [("n", "v")], "official_api", "approved", "customer_review", "fine", None, None, None, None, None, None, None, None, None)


def obs(spark, *changes):
    names = [c.split(" ")[0] for c in OBS.split(", ")]
    rows = []
    for i, change in enumerate(changes):
        row = dict(zip(names, GOOD)) | {"id": f"o{i}"} | change
        rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, OBS)


def test_observation_validator(spark):
    df = obs(spark, {}, {"exact_entity": False, "content_sha256": None, "evidence_span": None, "rights_status": "unknown"}, {"platform": "linkedin", "signal_type": "job_posting", "acquisition_mode": "jobspy_experiment"})
    reasons = [r.r for r in df.select(G.observation_reasons().alias("r")).collect()]
    assert reasons[0] == [] and len(reasons[1]) == 4 and reasons[2] == ["acquisition mode is not approved for publication"]


def test_footprint_sentiment(spark):
    graded = {"sentiment_label": "positive", "sentiment_model_version": "v1"}
    thin = P.footprint(obs(spark, graded, {"signal_type": "profile_metrics"}), "2026-01-02T00:00:00Z").first()
    assert thin.accepted_observations == 2 and thin.sentiment_status == "abstain" and thin.sentiment_score is None
    ten = P.footprint(obs(spark, *[{**graded, "reviewer_id": str(i)} for i in range(10)]), "2026-01-02T00:00:00Z").first()
    assert ten.sentiment_status == "available" and ten.sentiment_score == 100.0


def test_experimental_potential(spark):
    ex = {"acquisition_mode": "rights_review_experiment"}
    profiles = spark.createDataFrame([("923609016", False)], f"{ORG} string, site_publishable boolean")
    a = P.development_score(profiles, obs(spark, {**ex, "signal_type": "place_summary"}, {**ex, "signal_type": "review_summary"})).first()
    assert (a.score, a.experimental_potential_score) == (0.0, 35.0)
    b = P.development_score(profiles, obs(spark, {**ex, "platform": "company_directory", "signal_type": "review_summary", "rating": 4.4, "review_count": 21}, {**ex, "platform": "company_directory", "signal_type": "buzz_metrics"})).first()
    assert (b.score, b.experimental_potential_score) == (0.0, 35.0)


def feed_rows(spark, *events):
    entry = '{"id":"%s","_feed_entry":{"status":"%s","title":"%s","employer":{"orgnr":"923 609 016"},"published":"%s","updated":"%s"}}'
    return N.parse_feed(spark.createDataFrame([(i, entry % e) for i, e in enumerate(events)], "seq long, entry string"))


def test_job_feed(spark):
    j1 = ("j1", "ACTIVE", "A", "2026-09-10", "2026-09-10")
    gone = ("j1", "INACTIVE", "A", "2026-09-10", "2026-09-11")
    assert feed.job_index(feed_rows(spark, j1)).count() == 1
    assert feed.job_index(feed_rows(spark, gone)).count() == 0
    assert feed.job_index(feed_rows(spark, j1, gone)).count() == 0
    assert feed.job_index(feed_rows(spark, gone, j1)).count() == 1
    newer = ("j1", "ACTIVE", "New", "2026-09-10", "2026-09-15")
    rows = feed.job_index(feed_rows(spark, newer, j1, j1)).collect()
    assert [r.title for r in rows] == ["New"]
    who = spark.createDataFrame([("923 609 016",), ("111111111",)], f"{ORG} string")
    assert J.jobs_for(feed.job_index(feed_rows(spark, j1)), who).count() == 1
    cover = lambda p: feed.fresh_coverage(spark.createDataFrame([("923609016",)], f"{ORG} string"), feed.job_index(feed_rows(spark, ("j", "ACTIVE", "A", p, p))), "2026-09-24T00:00:00Z").first().fresh_coverage
    assert cover("2026-09-10") == 1.0 and cover("2020-01-01") == 0.0


@pytest.mark.parametrize(
    "name, org, title, footer, body, status",
    [
        ("Norsk Fiskeeksport AS", "1", "Norsk Fiskeeksport AS", "", "", "exact"), ("Tevlingveien 23 Invest AS", "1", "Ragde Eiendom", "", "", "related_or_uncertain"),
        ("Condalign AS", "1", "CondAlign.com is for sale | HugeDomains", "", "", "related_or_uncertain"), ("Primulator B.I.L.", "1", "Primulator", "Premium products for HoReCa", "", "related_or_uncertain"),
        ("NETSOLUTION VIKEN AS", "985628572", "Hjem", "Netsolution Viken AS, Oslo", "", "exact"), ("Alpha Beta Gamma AS", "1", "Alpha Beta Corp", "", "Gamma", "review"),
        ("Helt Annet AS", "923609016", "x", "Org 923 609 016", "", "exact"),
    ],
)
def test_site_identity(spark, name, org, title, footer, body, status):
    df = spark.createDataFrame([(name, org, "https://s.no/", title, "", footer, body)], f"name string, {ORG} string, final_url string, title string, description string, identity_text string, main_text string")
    assert I.assess_site(df).first().site_status == status


def test_social_identity(spark):
    from factweave.functions.text import identity_tokens

    df = spark.createDataFrame([("Aon Norway AS", "https://linkedin.com/company/aon"), ("Norsk Fiskeeksport AS", "https://linkedin.com/company/norsk-fiskeeksport")], "n string, u string")
    scores = [r.s for r in df.select(I.social_score(identity_tokens("n"), F.col("u")).alias("s")).collect()]
    assert scores[0] < 0.9 <= scores[1]


def test_discovery(spark):
    cases = [("Org.nr 923609016", "verified_orgnr"), ("post@example.no 974760673", "rejected_conflicting_orgnr"), ("mail post@example.no", "verified_contact"), ("tlf 22500737", "verified_contact"), ("Example AS", "no_match")]
    for page, verdict in cases:
        a = spark.createDataFrame([("923609016", 1, "available", "https://x.no", page, "22 50 07 37", "post@example.no")], f"{ORG} string, ord int, status string, url string, page string, phone string, email string")
        assert I.discover_sites(a, a).first().verdict == verdict


def test_places_and_listings(spark):
    place = lambda shown, where: spark.range(1).select(I.place_match(F.lit("G3 Gausdal Treindustrier SA"), F.lit("GAUSDAL"), F.lit(shown), F.lit(where)).alias("r")).first().r
    assert place("G3 Gausdal Treindustrier", "2651 Gausdal") and not place("G3 Gausdal Treindustrier", "Oslo") and not place("Gausdal Bil", "Gausdal")
    schema = f"{ORG} string, name string, street string, postcode string, city string, registry_phone string, site_url string, title string, address string, phone string, web_site string, review_count int"
    rows = [
        ("1", "AF GRUPPEN ASA", "Standardveien 1", "0581", "OSLO", "22 89 11 00", "https://afgruppen.no", "AF Gruppen", "Standardveien 1, 0581 Oslo", "+47 22 89 11 00", "https://afgruppen.no", 10),
        ("1", "AF GRUPPEN ASA", "Standardveien 1", "0581", "OSLO", "22 89 11 00", "https://afgruppen.no", "AF Eiendom", "Standardveien 1, 0581 Oslo", "+47 22 89 11 00", "https://afgruppen.no", 10),
        ("1", "Kiosk Nord AS", "Gata 1", "0581", "OSLO", "", "", "Kiosk Nord", "Vegen 9, 0581 Oslo", "", "", 0),
        ("932083108", "X AS", "Gata 1", "0581", "OSLO", "22891100", "", "PrivatMegleren Premium", "Gata 1, 0581 Oslo", "22891100", "", 0),
        ("111111111", "X AS", "Gata 1", "0581", "OSLO", "22891100", "", "PrivatMegleren Premium", "Gata 1, 0581 Oslo", "22891100", "", 0),
        ("932083108", "X AS", "Gata 1", "0581", "OSLO", "22891100", "", "PrivatMegleren Premium", "Gata 1, 0581 Oslo", "99999999", "", 0),
    ]
    assert [r.accepted for r in I.score_listings(spark.createDataFrame(rows, schema)).collect()] == [True, False, True, True, False, False]


def test_mentions(spark):
    names = spark.createDataFrame([("1", "NORDIC DOOR AS"), ("2", "SOLVANG ASA"), ("3", "VIND HOLDING AS"), ("4", "CONSTO AS"), ("5", "En To Tre Fire Fem AS")], f"{ORG} string, name string")
    titles = [
        (1, "Nordic Door AS åpner ny fabrikk - Lokalavisa"), (2, "Sterkt årsresultat fra Solvang ASA i 2024 - Avisa"), (3, "Fikk nei: Aneo Roan Vind Holding AS stupte"), (4, "Kontrakt for Consto Bergen AS"),
        (5, "Nytt om En to tre fire FEM as - Avis"), (6, "om En to tre fire seks as"),
    ]
    got = J.title_mentions(names, spark.createDataFrame(titles, "title_id int, title string"))
    assert {(r[ORG], r.title_id) for r in got.collect()} == {("1", 1), ("2", 2), ("5", 5)}


@pytest.mark.parametrize(
    "text, status, value, measure",
    [
        ("Note 2 - Lonnskostnader, antall ansatte og lan til ansatte", "no_employee_phrase", None, None), ("Det er to ansatte i sameiet.", "accepted", 2.0, "employees"),
        ("Selskapet har 1 2025 sysselsatt 2 arsverk.", "accepted", 2.0, "full_time_equivalents"), ("Antall arsverk syssetsatt i regnskapsaret: 3", "accepted", 3.0, "full_time_equivalents"),
        ("Stiftelsen har ingen ansatte og ingen arsverk.", "accepted", 0.0, "employees"), ("Note Antall Aarsverk i regnskapsaret 0.00", "accepted", 0.0, "full_time_equivalents"),
        ("Tal pa Aarsverk i rekneskapsaret 1.50", "accepted", 1.5, "full_time_equivalents"),
    ],
)
def test_workforce(spark, text, status, value, measure):
    r = X.workforce(spark.createDataFrame([(1, text)], "k int, text string"), "k").first()
    assert (r.status, r.value, r.measure) == (status, value, measure)


def test_jsonld_feeds_and_dates(spark):
    html = """<html><ul><li><time datetime="2025-09-22">x</time> <a href="/a">Ny rigg</a></li></ul>
    <script type="application/ld+json">{"@type":"Organization","telephone":["","22"],"sameAs":"https://x.com/me","department":[{"@type":"JobPosting","title":"T"},{"@type":"JobPosting"}]}</script></html>"""
    pages = spark.createDataFrame([(1, "https://e.no/x/", html)], "page_id int, final_url string, html string")
    nodes = X.jsonld_nodes(pages)
    assert X.org_facts(nodes).first().telephone == "22"
    assert [r.title for r in X.job_postings(nodes).collect()] == ["T"]
    assert X.sameas_socials(nodes).first().url == "https://x.com/me"
    item = X.dated_items(pages).first()
    assert (item.headline, item.date_published, item.url) == ("Ny rigg", "2025-09-22", "https://e.no/a")
    bad = spark.createDataFrame([(1, "https://e.no", "<rss><item>")], "page_id int, url string, body string")
    assert X.feed_items(bad).count() == 0 and X.sitemap_items(bad).count() == 0


def test_samples(spark):
    rows = [(f"2000000{i:02d}", "AS", i, False, i == 11, "2025" if i < 12 else "2024", f"h{i % 3}.no") for i in range(14)]
    reg = spark.createDataFrame(rows, f"{ORG} string, legal_form string, employees int, liquidating boolean, bankrupt boolean, latest_submitted_accounts string, website string")
    keep = spark.createDataFrame([("200000003",)], f"{ORG} string")
    drawn = W.filer_sample(reg, 5, "2025", keep, seed=7).collect()
    assert len(drawn) == 5 and "200000003" in {r[ORG] for r in drawn}
    again = W.filer_sample(reg.repartition(7).orderBy(F.rand(3)), 5, "2025", keep, seed=7).collect()
    assert [r[ORG] for r in sorted(drawn, key=lambda r: r.position)] == [r[ORG] for r in sorted(again, key=lambda r: r.position)]
    assert W.extension_sample(reg, 5, keep, 3).join(keep, ORG).count() == 0
    assert W.host_unique_sample(reg, 10).count() == 3
    one = spark.createDataFrame([("AS", 12, False, False, "x.no"), ("AS", 12, True, False, "")], "legal_form string, employees int, bankrupt boolean, liquidating boolean, website string")
    assert [r.s for r in one.select(W.stratum().alias("s")).collect()] == ["AS|5-19|active|web", "AS|5-19|adverse|no-web"]


def test_percentiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "v double")
    r = Q.latency_summary(df, "v").first()
    assert (r.n, r.p50, r.p95, r.max) == (5, 3.0, 100.0, 100.0)
    wide = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000 - 1000).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    for r in Q.latency_summary(wide, "v", ["g"]).collect():
        vals = sorted(x.v for x in wide.where(F.col("g") == r.g).collect())
        assert r.p50 == vals[-(-len(vals) // 2) - 1] and r.max == vals[-1]


def test_gold_report(spark):
    labels = ["positive", "neutral", "negative"]
    gold = spark.createDataFrame([(str(i), labels[i % 3]) for i in range(300)], "id string, label string")
    pred = gold.select("id", "label", F.lit(True).alias("exact_entity"), F.lit("public_news").alias("source_class"), *[F.lit("x").alias(c) for c in ("source_url", "retrieved_at", "evidence_span", "content_sha256")])
    r = E.classification_report(gold, pred).first()
    assert r.accuracy == 1 and r.macro_f1 == 1 and r.qualification_passed and not r.production_scale_gate_passed
    wrong = pred.withColumn("exact_entity", F.col("id") != "5")
    assert not E.classification_report(gold, wrong).first().qualification_passed
    with pytest.raises(ValueError):
        E.classification_report(gold, pred, 200)
    with pytest.raises(Exception, match="gold item ids must be unique"):
        E.classification_report(gold.union(gold.limit(1)), pred).collect()


def test_refresh(spark):
    old = spark.createDataFrame([("1", None, ["a", "b"]), ("2", 5, ["a"])], f"{ORG} string, employees int, jobs array<string>")
    new = spark.createDataFrame([("1", 0, ["a", "b"]), ("2", 5, ["a", "c"])], f"{ORG} string, employees int, jobs array<string>")
    fields = {"registry.employees": "employees", "website.job_postings": "jobs"}
    got = {(r[ORG], r.field, r.old_value, r.new_value) for r in R.diff(old, new, fields).collect()}
    assert got == {("1", "registry.employees", None, "0"), ("2", "website.job_postings", '["a"]', '["a","c"]')}
    assert R.diff(new, new, fields).count() == 0
    with pytest.raises(Exception, match="datasets differ in membership: [12]"):
        R.diff(old, new.limit(1), fields).count()


def test_registry_rules(spark):
    raw = spark.createDataFrame(
        [("100000001", "Å AS", "", "Storgata 1", "0155", "OSLO", "", "100000.00", "42"), ("100000002", "B", "n/a", "", "", "", "", "", "n/a")],
        "organisasjonsnummer string, navn string, konkurs string, `forretningsadresse.adresse` string, `forretningsadresse.postnummer` string, `forretningsadresse.poststed` string, `forretningsadresse.land` string, `kapital.belop` string, antallAnsatte string",
    )
    claims = {(r[ORG], r.field): r.value for r in N.registry_claims(raw).collect()}
    assert claims[("100000001", "business_address")] == '"Storgata 1, 0155 OSLO"'
    assert claims[("100000001", "share_capital")] == '{"amount":"100000.00","currency":"NOK"}'
    assert claims[("100000001", "employees_registered")] == '"42"' and ("100000002", "employees_registered") not in claims
    assert [r.employees for r in N.normalise_registry(raw).orderBy(ORG).collect()] == [42, None]


def test_contract_states_and_screens(spark):
    state = lambda s, n: spark.range(1).select(C.terminal_state(F.lit(s), F.lit(n)).alias("r")).first().r
    assert state("blocked", "robots.txt denied") == "blocked_robots" and state("not_fetched", None) == "submission_error" and state("source_error", "budget_exhausted: x") == "budget_exhausted"
    assert not S.ScreenPlan((S.Filter("employees", ">", 1, "registry"),), unsupported=("sentiment",)).executable
    topics = lambda q: spark.range(1).select(S.topics(F.lit(q)).alias("r")).first().r
    assert topics("What is the revenue?") == ["financials"] and len(topics("Tell me all")) == 6 and topics("Any sentiment?") == []


def test_membership_guards(spark):
    a = spark.createDataFrame([("1",), ("2",)], f"{ORG} string")
    with pytest.raises(Exception, match="completed entities outside the batch: 2"):
        J.pending(a.where("organisation_number = '1'"), a).count()
    assert [r[0] for r in J.pending(a, a.where("organisation_number = '1'")).collect()] == ["2"]
    seeds = a.withColumn("website", F.lit("x.no")).withColumn("proof_url", F.lit("https://p")).withColumn("proof", F.lit(""))
    with pytest.raises(Exception, match="seed needs absolute website"):
        J.apply_seeds(a.withColumn("website", F.lit("")), seeds).count()
    with pytest.raises(Exception, match="verified seeds contain unknown organisations: 2"):
        J.apply_seeds(a.where("organisation_number = '1'").withColumn("website", F.lit("")), seeds.withColumn("website", F.lit("https://x.no"))).count()
    twice = spark.createDataFrame([("1", "positive"), ("1", "positive")], "id string, label string")
    with pytest.raises(Exception, match="label ids must be unique: 1"):
        J.audit_join(twice.select("id"), twice).count()
    with pytest.raises(Exception, match="unknown gold label: odd"):
        J.gold_join(spark.createDataFrame([("1", "odd")], "id string, label string"), twice.limit(1)).count()
    config = a.select("organisation_number", *[F.lit(x).alias(c) for c, x in (("source_url", "u"), ("signal_type", "s"), ("platform", "p"), ("content_sha256", "0" * 64), ("proof", "x"), ("acquisition_mode", ""), ("rights_status", ""), ("source_class", ""), ("strategy", ""), ("evidence_span", "e"))])
    names = a.withColumn("name", F.lit("N"))
    assert J.reviewed_observations(config, names, "t").count() == 2
    with pytest.raises(Exception, match="unknown organisation number: 2"):
        J.reviewed_observations(config, names.where("organisation_number = '1'"), "t").count()
    with pytest.raises(Exception, match="invalid content hash"):
        J.reviewed_observations(config.withColumn("content_sha256", F.lit("x")), names, "t").count()
    from factweave.sources.readers import clean_manifest

    with pytest.raises(ValueError):
        clean_manifest(spark.createDataFrame([(1, "12345")], "position long, org string"))
    with pytest.raises(ValueError):
        clean_manifest(spark.createDataFrame([(1, "923609016"), (2, "923 609 016")], "position long, org string"))


def test_weights_are_a_partition():
    assert sum(K.FOUNDATION_WEIGHTS.values()) + sum(K.ENRICHMENT_WEIGHTS.values()) == 100
    assert sum(K.SCORE_MAXIMA.values()) == 100


def test_blocks_equal_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.range(0, 500).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), ((F.col("id") * 37) % 101).alias("v"))
    w = Window.partitionBy("k").orderBy("t")
    want = {r.t: (r.n, r.m) for r in df.select("t", (F.row_number().over(w) - 1).alias("n"), F.max("v").over(w).alias("m")).collect()}
    numbered = {r.t: r.position for r in number_rows(df, ["k"], F.floor(F.col("t") / 50), ["t"]).collect()}
    peaks = {r.t: r.m for r in running_max(df, ["k"], F.floor(F.col("t") / 50), ["t"], "v", "m").collect()}
    assert all((numbered[t], peaks[t]) == want[t] for t in want)


def test_tasks(spark):
    p = spark.createDataFrame([("1", "A", "OSLO", None), ("2", "B", "OSLO", [("x", "https://x.com/b")])], f"{ORG} string, name string, municipality string, social_links array<struct<platform:string,url:string>>")
    tasks = O.plan_tasks(p).collect()
    assert len(tasks) == 8 and len({t.task_id for t in tasks}) == 8 and {t.task_id for t in tasks} == {t.task_id for t in O.plan_tasks(p.repartition(3)).collect()}


def test_hostile_pages_do_not_stop_a_job(spark):
    deep = '<script type="application/ld+json">' + '{"a":' * 5000 + '{"@type":"Organization","name":"x"}' + "}" * 5000 + "</script>"
    html = "<div>" * 5000 + '<time datetime="2025-01-02">t</time><a href="/n">News</a>' + "</div>" * 5000
    fine = '<script type="application/ld+json">[{"@type":"Organization","name":"y","sub":{"@type":"Person"}}]</script>'
    pages = spark.createDataFrame([(1, "https://a.no/", deep), (2, "https://b.no/", html), (3, "https://c.no/", fine)], "page_id int, final_url string, html string")
    nodes = X.jsonld_nodes(pages).collect()
    assert [(r.page_id, r.seq, r.top, r.kinds) for r in nodes if r.page_id == 3] == [(3, 0, True, ["Organization"]), (3, 1, False, ["Person"])]
    assert [(r.page_id, r.date_published) for r in X.dated_items(pages).collect()] == [(2, "2025-01-02")]


def test_ranks_in_a_narrow_range_are_exact_and_split(spark):
    values = [0.01 * ((i * 7919) % 20011) / 20011 for i in range(20011)]
    got = Q.rank_values(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"p50": Q.nearest_rank(0.5), "p95": Q.nearest_rank(0.95), "max": Q.nearest_rank(1.0)}).first()
    values.sort()
    assert (got.n, got.p50, got.p95, got.max) == (20011, values[10005], values[19010], values[-1])
