"""Queries over samples, latest-wins folds, de-duplication and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control, extract as X, feed, normalise as N, sampling as W, screen as Q
from ..operators.joins import resolved_handles
from ..session import written
from . import base, sqltext as S
from .aggregates import STRATUM_SQL, _REWARD, history
from .catalog import load, query
from .joins import order_manifest

ORG = "organisation_number"


def _rank(seed: str) -> str:
    return f"sha256('{seed}:' || organisation_number)"


@query(
    "win_01_extension_sample",
    base.oracle("entities manifest", f"""SELECT organisation_number, 'extension' AS sample_slice FROM entities WHERE organisation_number NOT IN (SELECT organisation_number FROM manifest)
    ORDER BY {_rank('20260824')} LIMIT 200"""),
)
def extension_sample(spark, folder):
    return W.extension_sample(base.entities(spark, folder), 200, order_manifest(spark, folder)).select(ORG, "sample_slice")


@query(
    "win_01_sample_digest",
    base.oracle("entities", f"""SELECT count(*) AS selected, sha256(string_agg(organisation_number, chr(10) ORDER BY organisation_number)) AS selected_sha256 FROM (SELECT organisation_number FROM entities ORDER BY {_rank('20260824')} LIMIT 150)"""),
)
def sample_digest(spark, folder):
    return W.sample_digest(W.extension_sample(base.entities(spark, folder), 150))


@query(
    "win_02_filer_sample",
    base.oracle("entities manifest", f"""WITH e AS (SELECT *, organisation_number IN (SELECT organisation_number FROM manifest) AS kept FROM entities WHERE latest_submitted_accounts = '2024' AND NOT bankrupt AND NOT liquidating),
    d AS (SELECT * FROM e ORDER BY kept DESC, CASE WHEN kept THEN {_rank('20260825:preserved')} ELSE {_rank('20260825')} END LIMIT 120),
    p AS (SELECT *, row_number() OVER (ORDER BY {_rank('20260825:order')}) - 1 AS position FROM d)
    SELECT organisation_number, position, CASE WHEN kept THEN 'preserved_eligible' ELSE 'financial_filer_population' END AS sample_slice,
    CASE WHEN position < 72 THEN 'development' WHEN position < 96 THEN 'validation' ELSE 'held_out' END AS evaluation_split FROM p"""),
)
def filer_sample(spark, folder):
    out = W.filer_sample(base.entities(spark, folder), 120, "2024", order_manifest(spark, folder))
    return out.select(ORG, F.col("position").cast("long").alias("position"), "sample_slice", "evaluation_split")


@query(
    "win_03_stratified_sample",
    base.oracle("entities", f"""WITH e AS (SELECT *, {STRATUM_SQL} AS stratum FROM entities), p AS (SELECT * FROM e ORDER BY {_rank('20260822')} LIMIT 210),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_rank('20260822:stress')}) AS rn FROM e WHERE organisation_number NOT IN (SELECT organisation_number FROM p)),
    m AS (SELECT * FROM r WHERE rn <= (SELECT greatest(1, least(3, 90 // count(DISTINCT stratum))) FROM e)),
    f AS (SELECT * FROM r WHERE organisation_number NOT IN (SELECT organisation_number FROM m) ORDER BY {_rank('20260822:stress')} LIMIT 90),
    d AS (SELECT * FROM (SELECT organisation_number, stratum, 0 AS turn, 'population' AS s FROM p UNION ALL SELECT organisation_number, stratum, 1, 'stress' FROM m UNION ALL SELECT organisation_number, stratum, 2, 'stress' FROM f)
      ORDER BY turn, stratum, {_rank('20260822')} LIMIT 300)
    SELECT organisation_number, stratum, s AS sample_slice, CASE WHEN n < 180 THEN 'development' WHEN n < 240 THEN 'validation' ELSE 'held_out' END AS evaluation_split FROM
    (SELECT *, row_number() OVER (ORDER BY {_rank('20260822')}) - 1 AS n FROM d)"""),
)
def stratified_sample(spark, folder):
    return W.stratified_sample(base.entities(spark, folder), 300).select(ORG, "stratum", "sample_slice", "evaluation_split")


@query(
    "win_04_host_unique_sample",
    f"""WITH e AS (SELECT CAST(900000000 + page_id AS VARCHAR) AS organisation_number, {S.host('url')} AS host FROM pages WHERE page_id % 10 <> 3),
    r AS (SELECT *, {_rank('20260823')} AS rank FROM e WHERE host NOT IN (SELECT {S.host('url')} FROM pages WHERE page_id < 3)),
    o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank) AS rn FROM r) SELECT organisation_number, host FROM o WHERE rn = 1 ORDER BY rank LIMIT 40""",
)
def host_unique_sample(spark, folder):
    from ..functions.url import host

    pages = load(spark, folder, "pages")
    e = pages.select((F.col("page_id") + 900000000).cast("string").alias(ORG), F.col("url").alias("website"), "page_id")
    out = W.host_unique_sample(e, 40, e.where("page_id % 10 = 3").select(ORG), pages.where("page_id < 3").select(host("url").alias("host")).distinct())
    return out.select(ORG, "host")


@query(
    "win_05_split_assignment",
    base.oracle("entities", f"""WITH d AS (SELECT organisation_number FROM entities ORDER BY {_rank('7')} LIMIT 101)
    SELECT organisation_number, CASE WHEN n < 61 THEN 'development' WHEN n < 81 THEN 'validation' ELSE 'held_out' END AS evaluation_split FROM (SELECT *, row_number() OVER (ORDER BY {_rank('9')}) - 1 AS n FROM d)"""),
)
def split_assignment(spark, folder):
    from ..functions.ids import hash_rank

    drawn = W.extension_sample(base.entities(spark, folder), 101, seed=7).select(ORG)
    return W.assign_splits(drawn, 101, hash_rank(9, ORG)).select(ORG, "evaluation_split")


@query("win_06_entry_batch", base.oracle("entities", f"SELECT organisation_number FROM entities ORDER BY {_rank('0')} LIMIT 1000"))
def entry_batch(spark, folder):
    return W.entry_batch(base.entities(spark, folder).select(ORG), 1000)


@query("win_07_job_index", base.oracle("job_index", "SELECT * FROM job_index"))
def job_index(spark, folder):
    return feed.job_index(N.parse_feed(base.feed(spark, folder))).select(ORG, "job_id", "title", "published", "updated", "municipal")


def crawl_log(events):
    """Events as page events that repeat: kind, address and content come from few values."""
    k = F.col("k")
    return events.withColumn("k", F.expr(base._K)).select(
        (F.col("user_id") + 100000000).cast("string").alias(ORG), F.col("event_type").alias("page_kind"),
        F.concat(F.lit("https://a.example/"), (k % 5).cast("string")).alias("final_url"), F.sha2((k % 3).cast("string"), 256).alias("content_sha256"),
        F.when(k % 7 == 0, "source_error").otherwise("available").alias("status"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
    )


CRAWL_LOG_SQL = f"""SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, event_type AS page_kind, 'https://a.example/' || CAST(k % 5 AS VARCHAR) AS final_url, sha256(CAST(k % 3 AS VARCHAR)) AS content_sha256,
 CASE WHEN k % 7 = 0 THEN 'source_error' ELSE 'available' END AS status, event_id AS seq FROM (SELECT *, {base._K} AS k FROM events)"""
base.VIEWS["crawl_log"] = ((), CRAWL_LOG_SQL)


@query(
    "win_08_event_dedupe",
    base.oracle("crawl_log", "SELECT organisation_number, page_kind, final_url, content_sha256, status, min(seq) AS seq FROM crawl_log GROUP BY ALL"),
)
def event_dedupe(spark, folder):
    return feed.dedupe_events(crawl_log(load(spark, folder, "events"))).drop("ts")


@query(
    "win_09_crawl_merge",
    base.oracle("crawl_events", """WITH h AS (SELECT organisation_number, arg_max(status, (retrieved_at, page_id)) AS st, arg_max(final_url, (retrieved_at, page_id)) AS url FROM crawl_events WHERE page_kind = 'homepage' GROUP BY 1)
    SELECT 'site' AS kind, o.organisation_number, COALESCE(st, 'not_found') AS status, url, 1 AS n FROM (SELECT DISTINCT organisation_number FROM crawl_events) o LEFT JOIN h USING (organisation_number)
    UNION ALL SELECT 'pages', c.organisation_number, NULL, NULL, count(DISTINCT final_url) FROM crawl_events c JOIN h USING (organisation_number) WHERE st = 'available' AND status = 'available' GROUP BY 2
    UNION ALL SELECT 'errors', c.organisation_number, NULL, NULL, count(*) FROM crawl_events c JOIN h USING (organisation_number) WHERE st = 'available' AND status <> 'available' GROUP BY 2"""),
)
def crawl_merge(spark, folder):
    events = X.page_events(base.captures(spark, folder)).withColumn("seq", F.col("page_id"))
    sites, pages, _, errors, _ = feed.merge_events(written(events.select(ORG, "seq", "page_kind", "status", "final_url", "requested_url", "retrieved_at", "error", "title", "content_sha256"), "events"))
    none = F.lit(None).cast("string")
    out = sites.select(F.lit("site").alias("kind"), ORG, "status", F.col("source_url").alias("url"), F.lit(1).cast("long").alias("n"))
    count = lambda df, kind: df.groupBy(ORG).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), ORG, none.alias("status"), none.alias("url"), "n")
    return out.unionByName(count(pages, "pages")).unionByName(count(errors, "errors"))


_SITE = """WITH c AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'Firma' ELSE 'Side ' || CAST(page_id AS VARCHAR) END AS t FROM crawl_events),
 h AS (SELECT organisation_number, arg_max(status, (retrieved_at, page_id)) AS st, arg_max(page_id, (retrieved_at, page_id)) AS id, arg_max(t, (retrieved_at, page_id)) AS title FROM c WHERE page_kind = 'homepage' GROUP BY 1),
 l AS (SELECT * FROM h WHERE st = 'available'), ok AS (SELECT c.* FROM c JOIN l USING (organisation_number) WHERE status = 'available'),
 p AS (SELECT *, row_number() OVER (PARTITION BY organisation_number, final_url ORDER BY page_kind = 'homepage', page_id DESC) AS rn FROM ok)"""


@query(
    "win_09_crawl_sites",
    base.oracle("crawl_events", _SITE + """ SELECT organisation_number, 'site' AS kind, title AS name, 'Om ' || CAST(id AS VARCHAR) AS value, sha256('Tekst ' || CAST(id AS VARCHAR)) AS text_sha256 FROM l
    UNION ALL SELECT organisation_number, 'page', t, final_url, sha256('Tekst ' || CAST(page_id AS VARCHAR)) FROM p WHERE rn = 1
    UNION ALL SELECT DISTINCT organisation_number, 'social', 'facebook', 'https://facebook.com/Pa' || CAST(page_id % 9 AS VARCHAR), NULL FROM ok
    UNION ALL SELECT organisation_number, 'organisation', 'Store', 'O' || CAST(id AS VARCHAR), NULL FROM l UNION ALL SELECT organisation_number, 'organisation', 'Organization', 'P', NULL FROM l"""),
)
def crawl_sites(spark, folder):
    """The whole record of a crawl: texts of sites and pages, social links, and the homepage's structured organisations."""
    key = F.col("page_id").cast("string")
    title = F.when(F.col("page_id") % 2 == 0, "Firma").otherwise(F.concat(F.lit("Side "), key))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit('</title><meta name="description" content="Om '), key, F.lit('"><script type="application/ld+json">{"@graph":[{"@type":"Store","name":"O'), key,
        F.lit('","parentOrganization":{"@type":"Organization","name":"P"}}]}</script></head><body><article> Tekst\n<b>'), key, F.lit('</b></article><a href="https://www.facebook.com/Pa'), (F.col("page_id") % 9).cast("string"), F.lit('/">f</a></body></html>'),
    )
    captures = base.captures(spark, folder).withColumn("html", html).withColumn("seq", F.col("page_id"))
    events = written(X.page_events(captures), "events")
    socials = X.page_socials(captures).select(F.col("page_id").alias("seq"), "platform", "url")
    organisations = X.organisation_nodes(X.jsonld_nodes(captures)).select(F.col("page_id").alias("seq"), F.col("kinds")[0].alias("kind"), "name")
    sites, pages, linked, _, named = feed.merge_events(events, socials, organisations)
    row = lambda df, kind, name, value, body: df.select(ORG, F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), (F.sha2(body, 256) if body is not None else F.lit(None).cast("string")).alias("text_sha256"))
    col = F.col
    return (
        row(sites.where("status = 'available'"), "site", col("title"), col("description"), col("main_text"))
        .unionByName(row(pages, "page", col("title"), col("url"), col("main_text")))
        .unionByName(row(linked, "social", col("platform"), col("url"), None))
        .unionByName(row(named, "organisation", col("kind"), col("name"), None))
    )


@query(
    "win_10_dedupe_articles",
    """WITH a AS (SELECT source AS organisation_number, 'Head ' || CAST(n_chars % 60 AS VARCHAR) AS headline, lang AS date_published, doc_id AS seq FROM documents),
    d AS (SELECT *, row_number() OVER (PARTITION BY organisation_number, lower(headline), date_published ORDER BY seq) AS r FROM a)
    SELECT organisation_number, headline, date_published, seq, position FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY date_published, lower(headline)) AS position FROM d WHERE r = 1)""",
)
def dedupe_articles(spark, folder):
    a = load(spark, folder, "documents").select(
        F.col("source").alias(ORG), F.concat(F.when(F.col("doc_id") % 2 == 0, "Head ").otherwise("Head "), (F.col("n_chars") % 60).cast("string")).alias("headline"),
        F.col("lang").alias("date_published"), F.col("doc_id").alias("seq"),
    )
    return feed.dedupe_articles(a)


@query(
    "win_10_dedupe_postings",
    """WITH a AS (SELECT source AS organisation_number, 'Job ' || CAST(n_chars % 9 AS VARCHAR) AS title, 'https://X.no/' || lang AS url, CAST(n_chars % 7 AS VARCHAR) AS date_posted, doc_id AS seq FROM documents),
    d AS (SELECT *, row_number() OVER (PARTITION BY organisation_number, lower(title), lower(url) ORDER BY seq) AS r FROM a)
    SELECT organisation_number, title, url, date_posted, seq, position FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY date_posted, lower(title), url) AS position FROM d WHERE r = 1)""",
)
def dedupe_postings(spark, folder):
    a = load(spark, folder, "documents").select(
        F.col("source").alias(ORG), F.concat(F.lit("Job "), (F.col("n_chars") % 9).cast("string")).alias("title"), F.concat(F.lit("https://X.no/"), "lang").alias("url"),
        (F.col("n_chars") % 7).cast("string").alias("date_posted"), F.col("doc_id").alias("seq"),
    )
    return feed.dedupe_postings(a)


@query(
    "win_11_latest_record",
    base.oracle("accounts", "SELECT organisation_number, max(year) AS year, CAST(arg_max(revenue, year) AS DOUBLE) AS revenue FROM accounts GROUP BY 1"),
)
def latest_record(spark, folder):
    return Q.latest_accounts(base.accounts(spark, folder)).select(ORG, "year", F.col("revenue").cast("double").alias("revenue"))


def screen_profiles(spark, folder):
    """Profiles with their latest account and the provenance of each module."""
    from .projections import graded_profiles

    latest = Q.latest_accounts(base.accounts(spark, folder)).withColumnRenamed("year", "period")
    joined = graded_profiles(spark, folder).join(latest, ORG, "left")
    meta = []
    for m in ("registry", "financials", "website", "roles", "locations"):
        meta += [
            F.lit(f"https://source.example/{m}").alias(f"{m}_source_url"), F.lit("2026-01-01T00:00:00Z").alias(f"{m}_retrieved_at"),
            F.sha2(F.concat(F.col(ORG), F.lit(m)), 256).alias(f"{m}_content_sha256"),
        ]
    return joined.select("*", *meta)


base.VIEWS["screen"] = (("graded", "accounts"), """SELECT g.*, a.year AS period, a.revenue, a.annual_result FROM graded g LEFT JOIN (SELECT organisation_number, max(year) AS year, arg_max(revenue, year) AS revenue, arg_max(annual_result, year) AS annual_result FROM accounts GROUP BY 1) a USING (organisation_number)""")


@query(
    "win_12_screen_top_k",
    base.oracle("screen", "SELECT organisation_number, CAST(revenue AS DOUBLE) AS revenue, employees FROM screen ORDER BY employees DESC NULLS LAST, organisation_number LIMIT 500"),
)
def screen_top_k(spark, folder):
    out = Q.screen(screen_profiles(spark, folder), Q.ScreenPlan(sort=Q.Sort("employees", 500)))
    return out.select(ORG, F.col("revenue").cast("double").alias("revenue"), "employees")


@query(
    "win_13_strategy_order",
    base.oracle("history", f"""WITH p AS (SELECT strategy, count(*) AS runs, CAST(sum(CAST({_REWARD} AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean FROM history GROUP BY 1)
    SELECT strategy, runs, row_number() OVER (ORDER BY mean + 0.35 * sqrt(ln((SELECT sum(runs) FROM p) + 1) / (runs + 1)) DESC) AS position FROM p"""),
)
def strategy_order(spark, folder):
    return control.strategy_order(history(spark, folder)).select("strategy", "runs", F.col("position").cast("long").alias("position"))


@query(
    "win_15_frontier",
    f"""WITH b AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root, url, html || '<a class="x" href="/om-oss/#team">Om</a><a href=''kontakt.html''>Kontakt <b>oss</b></a><a href="https://other.no/about">x</a><a href="/careers/">j</a>' AS html FROM pages),
    a AS (SELECT page_id, root, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1)) AS label FROM b),
    t AS (SELECT page_id, root, CASE WHEN href LIKE '/%' THEN root || regexp_extract(href, '^[^?#]*') WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^([a-z]+://[^/]+[^?#]*/)', 1) || href END AS target, lower(label) AS label FROM a),
    r AS (SELECT page_id, root, target, min(CASE {' '.join(f"WHEN position('{term}' IN lower(substr(target, length(root) + 1)) || ' ' || label) > 0 THEN {i}" for i, term in enumerate(X.K.PRIORITY_TERMS))} END) AS rank FROM t WHERE target LIKE root || '/%' OR target = root GROUP BY 1, 2, 3),
    l AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, target) AS rn FROM r WHERE rank IS NOT NULL),
    p AS (SELECT page_id, root || '/' || path AS url, i AS ord FROM b, (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(X.K.PROBE_PATHS))}) v(path, i)
      UNION ALL SELECT page_id, target, 11 + rn FROM l), d AS (SELECT *, row_number() OVER (PARTITION BY page_id, rtrim(url, '/') ORDER BY ord) AS once FROM p)
    SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS position FROM d WHERE once = 1""",
)
def frontier(spark, folder):
    extra = """<a class="x" href="/om-oss/#team">Om</a><a href='kontakt.html'>Kontakt <b>oss</b></a><a href="https://other.no/about">x</a><a href="/careers/">j</a>"""
    pages = load(spark, folder, "pages").select("page_id", F.col("url").alias("final_url"), F.concat("html", F.lit(extra)).alias("html"))
    return X.frontier(pages).withColumn("position", F.col("position").cast("long"))


@query(
    "win_16_resolved_handles",
    f"""SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, CAST(k % 20 AS VARCHAR) AS resolved_url, CAST(min(event_id) AS VARCHAR) AS requested_url, count(*) - 1 AS duplicates FROM (SELECT *, {base._K} AS k FROM events) GROUP BY 1, 2""",
)
def handles(spark, folder):
    e = load(spark, folder, "events").withColumn("k", F.expr(base._K)).select(
        (F.col("user_id") + 100000000).cast("string").alias(ORG), (F.col("k") % 20).cast("string").alias("resolved_url"), F.col("event_id").cast("string").alias("requested_url"), F.col("event_id").alias("seq")
    )
    first, again = resolved_handles(e)
    return first.join(again.select(ORG, "resolved_url", "duplicates"), [ORG, "resolved_url"], "left").fillna(0, ["duplicates"])


@query(
    "win_17_manifest_order",
    base.oracle("manifest entities", "SELECT organisation_number, position, name FROM manifest JOIN entities USING (organisation_number)"),
)
def manifest_order(spark, folder):
    return feed.in_manifest_order(base.entities(spark, folder), order_manifest(spark, folder)).select(ORG, "position", "name")
