"""Queries over the gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, url as U
from ..operators import gates as G
from . import base
from .catalog import load, query


@query(
    "flt_01_observation_reasons",
    base.oracle("observations", f"SELECT event_id, {base.REASONS_SQL} AS reasons FROM observations"),
)
def observation_reasons(spark, folder):
    return base.observations(spark, folder).select("event_id", F.array_join(G.observation_reasons(), "; ").alias("reasons"))


@query(
    "flt_02_publishable_split",
    base.oracle("accepted", """SELECT o.platform, count(*) AS total, count(a.event_id) AS accepted, count(*) - count(a.event_id) AS rejected
    FROM observations o LEFT JOIN accepted a USING (event_id) GROUP BY 1"""),
)
def publishable_split(spark, folder):
    good, bad = G.split_observations(base.observations(spark, folder))
    both = good.select("platform", F.lit(1).alias("ok")).unionByName(bad.select("platform", F.lit(0).alias("ok")))
    return both.groupBy("platform").agg(
        F.count("*").alias("total"), F.sum("ok").alias("accepted"), F.sum(1 - F.col("ok")).alias("rejected")
    )


@query("flt_03_experimental", base.oracle("experimental", "SELECT event_id, platform FROM experimental"))
def experimental(spark, folder):
    return base.observations(spark, folder).where(G.experimental()).select("event_id", "platform")


_ELIGIBLE = [
    ("NOT exact_entity", "exact company identity is not verified"),
    (f"source_class NOT IN {K.ROLLUP_SENTIMENT_CLASSES}", "source is not an allowed independent class"),
    ("source_url IS NULL", "missing source_url"),
    ("retrieved_at IS NULL", "missing retrieved_at"),
    ("evidence_span IS NULL", "missing evidence_span"),
    ("content_sha256 IS NULL", "missing content_sha256"),
    ("k = 50 OR evidence_span IS NULL", "missing text"),
]


@query(
    "flt_04_sentiment_eligibility",
    base.oracle("observations", "SELECT event_id, concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in _ELIGIBLE) + ") AS reasons FROM observations"),
)
def sentiment_eligibility(spark, folder):
    obs = base.observations(spark, folder).withColumn("text", F.when(F.col("k") == 50, "").otherwise(F.col("evidence_span")))
    return obs.select("event_id", F.array_join(G.sentiment_reasons(), "; ").alias("reasons"))


@query(
    "flt_05_publishable_sentiment",
    base.oracle("observations", f"""SELECT event_id, sentiment_label FROM observations WHERE exact_entity AND source_class IN {K.ROLLUP_SENTIMENT_CLASSES}
    AND source_url IS NOT NULL AND retrieved_at IS NOT NULL AND evidence_span IS NOT NULL AND sentiment_label IN {K.SENTIMENT_LABELS}"""),
)
def publishable_sentiment(spark, folder):
    return base.observations(spark, folder).where(G.publishable_sentiment("sentiment_label")).select("event_id", "sentiment_label")


@query(
    "flt_06_filer_eligible",
    base.oracle("entities", "SELECT organisation_number, legal_form FROM entities WHERE latest_submitted_accounts = '2024' AND NOT bankrupt AND NOT liquidating"),
)
def filer_eligible(spark, folder):
    return base.entities(spark, folder).where(G.filer_eligible("2024")).select("organisation_number", "legal_form")


def module_records(spark, folder):
    """One evidence record per observed (entity, module, status)."""
    events = load(spark, folder, "events").withColumn("k", F.expr(base._K))
    return events.select(
        (F.col("user_id") + 100000000).cast("string").alias("organisation_number"),
        F.expr(base.pick("k % 9", K.MODULES)).alias("module"),
        F.when(F.col("event_type") == "error", "not_fetched").otherwise("available").alias("status"),
    )


@query(
    "flt_07_module_completeness",
    f"""SELECT CAST(100000000 + user_id AS VARCHAR) AS organisation_number, count(DISTINCT CASE WHEN event_type <> 'error' THEN m END) = 3 AS complete
    FROM (SELECT *, CASE WHEN {base._K} % 9 IN (0, 3, 5) THEN {base._K} % 9 END AS m FROM events) GROUP BY user_id""",
)
def module_completeness(spark, folder):
    return G.complete_entities(module_records(spark, folder), ["registry", "financials", "roles"])


@query(
    "flt_08_exact_identity",
    base.oracle("entities", """SELECT organisation_number, CASE WHEN employees IS NULL THEN false ELSE employees % 5 <> 0 END AS exact FROM entities"""),
)
def exact_identity(spark, folder):
    live = F.when(F.col("employees") % 5 != 0, F.col("organisation_number")).when(F.col("employees").isNotNull(), F.lit("999999999"))
    return base.entities(spark, folder).select("organisation_number", G.exact_identity(live, "organisation_number").alias("exact"))


_BLOCKED = ("example.net", "ththth.example.com", "example.org")


@query(
    "flt_09_blocked_host",
    """SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^www\\.', '') AS host,
    regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^www\\.', ''), '(^|\\.)(example\\.net|ththth\\.example\\.com|example\\.org)$') AS blocked FROM pages""",
)
def blocked_host(spark, folder):
    h = U.host("url")
    return load(spark, folder, "pages").select("page_id", h.alias("host"), U.is_blocked(h, _BLOCKED).alias("blocked"))


def page_results(spark, folder):
    """Pages as ranked search results of the entities of 40 nations' sites."""
    return load(spark, folder, "pages").select(
        (F.col("page_id") % 40 + 100000000).cast("string").alias("organisation_number"), "url", F.col("page_id").alias("rank")
    )


@query(
    "flt_10_candidate_sites",
    """WITH h AS (SELECT CAST(100000000 + page_id % 40 AS VARCHAR) AS organisation_number, url, page_id AS rank, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)), '^www\\.', '') AS host FROM pages),
    one AS (SELECT *, row_number() OVER (PARTITION BY organisation_number, host ORDER BY rank, url) AS r FROM h WHERE host NOT LIKE '%x.com%')
    SELECT organisation_number, url, host, position FROM (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY rank, url) AS position FROM one WHERE r = 1)""",
)
def candidate_sites(spark, folder):
    return G.candidate_sites(page_results(spark, folder)).select("organisation_number", "url", "host", "position")


@query(
    "flt_11_path_predicates",
    """SELECT page_id, regexp_matches(u, '^[a-z]+://[^/?#]*[^?#]*/(news|press|aktuelt|nyheter|artikler|blog)(/|$|[?#])') AS news,
    regexp_matches(lower(u || ' ' || t), 'careers|career|jobb|jobber|ledige-stillinger|stilling|stillinger|vacancies|karriere|arbeid-hos-oss') AS careers,
    regexp_matches(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/nyhet|/aktuelt|/news|/press|/blog|/artikkel|/story|/siste-nytt|/pressemelding|/presserom') AS article
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '/en/', '/news/') WHEN 1 THEN replace(url, '/de/', '/pressemelding/') ELSE url END AS u,
    CASE WHEN page_id % 3 = 0 THEN 'Ledige stillinger og karriere' ELSE '' END AS t FROM pages)""",
)
def path_predicates(spark, folder):
    u = F.expr("CASE page_id % 4 WHEN 0 THEN replace(url, '/en/', '/news/') WHEN 1 THEN replace(url, '/de/', '/pressemelding/') ELSE url END")
    t = F.when(F.col("page_id") % 3 == 0, "Ledige stillinger og karriere").otherwise("")
    return load(spark, folder, "pages").select(
        "page_id", U.is_news_path(u).alias("news"), U.is_careers(u, t).alias("careers"), U.is_article_path(u).alias("article")
    )
