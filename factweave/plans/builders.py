"""Queries over the observation builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed, gates as G, identity as I, normalise as N, observations as O
from . import base
from .catalog import load, query
from .extraction import _arms
from .identity import _listing, channel_hits, sites
from .joins import MENTION_SQL, mention_names

ORG = "organisation_number"
RUN = "2026-01-01T00:00:00Z"


@query(
    "obs_01_registry",
    base.oracle("entities", """SELECT 'brreg-entity-' || organisation_number AS id, organisation_number, 'company_profile' AS signal_type, sha256(organisation_number || 'brreg') AS content_sha256, name AS evidence_span, CAST(NULL AS VARCHAR) AS staff FROM entities
    UNION ALL SELECT 'brreg-workforce-' || organisation_number, organisation_number, 'workforce_snapshot', sha256(organisation_number || 'brreg'), name || ': ' || CAST(employees AS VARCHAR) || ' registered employees', CAST(employees AS VARCHAR) FROM entities WHERE employees IS NOT NULL"""),
)
def registry(spark, folder):
    return O.registry_observations(base.entities(spark, folder), RUN).select("id", ORG, "signal_type", "content_sha256", "evidence_span", F.try_element_at("metrics", F.lit("employees_registered")).alias("staff"))


def rich_sites(spark, folder):
    graded = I.assess_site(sites(spark, folder)).withColumn("k", F.col("page_id"))
    none = F.lit(None).cast("string")
    return graded.select(
        "k", ORG, "final_url", F.lit(RUN).alias("retrieved_at"), F.sha2("final_url", 256).alias("content_sha256"), "title", F.lit("d.no").alias("registered_domain"), "site_publishable", "site_status", "site_score",
        F.array(F.struct(F.lit("x").alias("platform"), F.lit("https://x.com/a").alias("url"))).alias("social_links"),
        F.array(F.struct(F.lit("Job").alias("title"), F.lit("2025-01-01").alias("date_posted"), F.lit("https://j.no/1").alias("url")), F.struct(F.lit("Job2").alias("title"), none.alias("date_posted"), none.alias("url"))).alias("job_postings"),
        F.array(F.struct(F.lit("Karriere").alias("title"), F.lit("https://j.no/k").alias("url"))).alias("careers_pages"),
        F.array(F.struct(F.lit("  ").alias("headline"), none.alias("date_published"), none.alias("url")), F.struct(F.lit("Ny rigg").alias("headline"), F.lit("2025-02-02").alias("date_published"), none.alias("url"))).alias("news_articles"),
        F.array(F.struct(F.lit(8.0).alias("rating"), (F.col("k") % 3).cast("long").alias("review_count"), F.lit(10.0).alias("best"))).alias("ratings"),
        F.array(F.struct(F.lit("Bra").alias("body"), none.alias("date"), none.alias("author"), F.lit(9.0).alias("rating"), F.lit(5.0).alias("best"))).alias("reviews"),
    )


@query(
    "obs_02_site",
    base.oracle("graded_sites", """SELECT 'handle-' || organisation_number || '-x' AS id, 'profile_handle' AS signal_type, 'https://x.com/a' AS source_url, CAST(NULL AS VARCHAR) AS rating FROM graded_sites
    UNION ALL SELECT p.prefix || organisation_number || p.suffix, p.signal, COALESCE(p.url, final_url), p.rating FROM graded_sites, (VALUES ('job-', '-0', 'job_posting', 'https://j.no/1', NULL), ('job-', '-1', 'job_posting', NULL, NULL),
     ('careers-', '-0', 'job_posting', 'https://j.no/k', NULL), ('news-', '-1', 'public_post', NULL, NULL), ('company-profile-', '', 'company_profile', NULL, NULL), ('review-', '-0', 'review', NULL, NULL)) p(prefix, suffix, signal, url, rating) WHERE site_score >= 0.9
    UNION ALL SELECT 'rating-' || organisation_number || '-0', 'review_summary', final_url, '4.0' FROM graded_sites WHERE site_score >= 0.9 AND page_id % 3 > 0"""),
)
def site(spark, folder):
    return O.site_observations(rich_sites(spark, folder)).select("id", "signal_type", "source_url", F.try_element_at("metrics", F.lit("rating")).alias("rating"))


@query(
    "obs_03_jobs",
    base.oracle("job_index", "SELECT 'navjob-' || organisation_number || '-' || job_id AS id, organisation_number, published AS effective_at, title AS evidence_span, municipal FROM job_index"),
)
def jobs(spark, folder):
    out = O.job_observations(feed.job_index(N.parse_feed(base.feed(spark, folder))), RUN)
    return out.where(G.publishable()).select("id", ORG, "effective_at", "evidence_span", F.try_element_at("metrics", F.lit("municipal")).alias("municipal"))


@query(
    "obs_04_knowledge_base",
    base.oracle("entities", """SELECT 'wikidata-' || organisation_number || '-profile' AS id, 'wikidata' AS platform, 'company_profile' AS signal_type, 'Q' || organisation_number AS source_url, sha256(organisation_number || '|Q' || organisation_number || '|profile') AS content_sha256 FROM entities WHERE employees > 10
    UNION ALL SELECT 'wikidata-' || organisation_number || '-wikipedia', 'wikipedia', 'company_profile', 'https://no.wikipedia.org/' || municipality, sha256(organisation_number || '|Q' || organisation_number || '|wikipedia') FROM entities WHERE employees > 100
    UNION ALL SELECT 'wikidata-' || organisation_number || '-handle-linkedin', 'linkedin', 'profile_handle', 'https://linkedin.com/company/' || legal_form, sha256(organisation_number || '|Q' || organisation_number || '|handle-linkedin') FROM entities WHERE employees > 10"""),
)
def knowledge_base(spark, folder):
    none = F.lit(None).cast("string")
    kb = base.entities(spark, folder).select(
        ORG, F.when(F.col("employees") > 10, F.concat(F.lit("Q"), ORG)).alias("item"), F.col("name").alias("label"), F.col("website"), F.col("employees").cast("string").alias("employees"),
        none.alias("inception"), F.when(F.col("employees") > 100, F.concat(F.lit("https://no.wikipedia.org/"), "municipality")).alias("article"), F.col("legal_form").alias("P4264"), F.lit("").alias("P2013"),
    )
    return O.kb_observations(kb, RUN).select("id", "platform", "signal_type", "source_url", "content_sha256")


@query(
    "obs_05_places",
    base.oracle("entities", """SELECT 'places-' || organisation_number AS id, 'place_summary' AS signal_type, municipality AS evidence_span, sha256(organisation_number || '|P' || organisation_number) AS content_sha256 FROM entities
    UNION ALL SELECT 'places-rating-' || organisation_number, 'review_summary', 'Google Places rating 4.5/5 from ' || CAST(employees AS VARCHAR) || ' reviews.', sha256(organisation_number || '|P' || organisation_number || '|rating') FROM entities WHERE employees > 0"""),
)
def places(spark, folder):
    p = base.entities(spark, folder).select(
        ORG, F.concat(F.lit("P"), ORG).alias("place_id"), F.col("name").alias("display_name"), F.col("municipality").alias("formatted_address"), "website", F.lit(4.5).alias("rating"),
        F.col("employees").cast("long").alias("rating_count"), F.lit("store").alias("primary_type"), F.lit("OPERATIONAL").alias("business_status"),
    )
    return O.place_observations(p, RUN).where(G.publishable()).select("id", "signal_type", "evidence_span", "content_sha256")


@query(
    "obs_06_map_listing",
    base.oracle("listing", """WITH l AS (SELECT organisation_number AS o, web <> '' AS w, k % 400 > 0 AND k % 7 BETWEEN 1 AND 5 AS rated, k % 6 AS stars FROM listing)
    SELECT 'gmaps-place-' || o || '-p' AS id, 'place_summary' AS signal_type, CAST(NULL AS VARCHAR) AS sentiment_label FROM l UNION ALL SELECT 'gmaps-company-profile-' || o || '-p', 'company_profile', NULL FROM l WHERE w
    UNION ALL SELECT 'gmaps-' || n || '-' || o || '-p', s, NULL FROM l, (VALUES ('review-summary', 'review_summary'), ('profile-metrics', 'profile_metrics'), ('buzz', 'buzz_metrics')) v(n, s) WHERE rated
    UNION ALL SELECT 'gmaps-review-' || o || '-r1', 'review', CASE WHEN stars <= 2 THEN 'negative' WHEN stars >= 4 THEN 'positive' ELSE 'neutral' END FROM l WHERE stars > 0"""),
)
def map_listing(spark, folder):
    k = F.col("k")
    m = _listing(spark, folder).select(
        ORG, F.lit("p").alias("place_id"), "title", "address", "phone", "web_site", F.lit("https://maps.example/p").alias("link"), (k % 7).cast("double").alias("rating"),
        F.when(k % 7 <= 5, k % 400).otherwise(0).cast("long").alias("review_count"), F.sha2("title", 256).alias("content_sha256"), F.lit(1.0).alias("name_score"),
        F.array(F.struct(F.lit("r1").alias("review_id"), (k % 6).cast("double").alias("stars"), F.lit("").alias("body"), F.lit("").alias("author"))).alias("reviews"),
    )
    return O.listing_observations(m, RUN).select("id", "signal_type", "sentiment_label")


@query(
    "obs_07_site_activity",
    base.oracle("graded_sites", "SELECT 'company-site-activity-' || organisation_number || '-' || left(sha256(html_key), 16) AS id, 'Exact company site snapshot with 2 bounded pages and ' || CAST(page_id % 3 AS VARCHAR) || ' verified social links.' AS evidence_span FROM (SELECT *, CAST(page_id AS VARCHAR) AS html_key FROM graded_sites) WHERE site_score >= 0.9"),
)
def site_activity(spark, folder):
    g = I.assess_site(sites(spark, folder)).select(
        "*", F.lit("available").alias("status"), F.lit(RUN).alias("retrieved_at"), F.sha2(F.col("page_id").cast("string"), 256).alias("content_sha256"), F.lit("static_complete").alias("extraction_state"),
        F.lit(2).alias("pages"), (F.col("page_id") % 3).cast("int").alias("socials"), F.lit(0).alias("structured"),
    )
    return O.site_activity(g).where(G.publishable()).select("id", "evidence_span")


@query(
    "obs_08_site_news",
    """WITH p AS (SELECT CAST(100000000 + page_id % 30 AS VARCHAR) AS o, regexp_extract(url, '^[^?#]*') AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(url, '/en/', '/News/en/'), '/fr/', '/press/') ELSE url END AS url FROM pages)),
    n AS (SELECT o, url, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1), '/'), lambda x: x <> '')) AS d FROM p WHERE regexp_matches(url, '(?i)/(news|press|aktuelt|nyheter|artikler|blog)(/|$)'))
    SELECT o AS organisation_number, 'company-site-news-' || left(sha256(o || '|' || url), 24) AS id, url AS source_url, CAST(c AS VARCHAR) AS captured FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY d DESC, url) AS rn, count(*) OVER (PARTITION BY o) AS c FROM n) WHERE rn = 1""",
)
def site_news(spark, folder):
    url = F.when(F.col("page_id") % 2 == 0, F.replace(F.replace("url", F.lit("/en/"), F.lit("/News/en/")), F.lit("/fr/"), F.lit("/press/"))).otherwise(F.col("url"))
    pages = load(spark, folder, "pages").select((F.col("page_id") % 30 + 100000000).cast("string").alias(ORG), F.regexp_extract(url, "^[^?#]*", 0).alias("url"), F.lit("T").alias("title"), F.sha2("html", 256).alias("content_sha256"))
    proven = pages.select(ORG).distinct().select(ORG, F.lit("available").alias("status"), F.lit(True).alias("site_publishable"), F.lit(RUN).alias("retrieved_at"), F.lit(0.95).alias("site_score"))
    return O.site_news(proven, pages).select(ORG, "id", "source_url", F.element_at("metrics", "captured_news_pages").alias("captured"))


@query(
    "obs_09_mentions",
    f"""WITH m AS ({MENTION_SQL}), t AS (SELECT m.organisation_number, m.title_id, d.text, d.lang, row_number() OVER (PARTITION BY m.organisation_number, lower(d.text), d.lang ORDER BY title_id) AS once FROM m JOIN documents d ON d.doc_id = m.title_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY organisation_number ORDER BY title_id) AS rn FROM t WHERE once = 1) SELECT organisation_number, 'google-news-title-' || left(sha256(organisation_number || '|' || text || '|' || lang), 24) AS id FROM k""",
)
def mentions(spark, folder):
    titles = load(spark, folder, "documents").select(F.col("doc_id").alias("title_id"), F.col("text").alias("title"), F.lit("https://n.no/1").alias("link"), F.col("lang").alias("publisher"), F.lit(None).cast("string").alias("published_at"))
    return O.mention_observations(mention_names(spark, folder), titles, RUN).select(ORG, "id")


@query(
    "obs_10_directory_ratings",
    base.oracle("entities", """SELECT 'fagfolk-' || n || '-' || organisation_number || '-' || left(sha256(name), 16) AS id, s AS signal_type FROM entities, (VALUES ('review', 'review_summary'), ('metrics', 'profile_metrics'), ('buzz', 'buzz_metrics')) v(n, s) WHERE employees BETWEEN 1 AND 100"""),
)
def directory_ratings(spark, folder):
    e = base.entities(spark, folder)
    shown = F.when(F.col("employees") <= 100, F.concat(F.upper("name"), F.lit(" Org "), F.regexp_replace(ORG, "(...)", "$1 "))).otherwise(F.col("name"))
    p = e.select(ORG, "name", shown.alias("page_text"), F.sha2("name", 256).alias("content_sha256"), F.lit(4.0).alias("rating"), F.col("employees").alias("review_count"))
    return O.rating_observations(p, RUN).select("id", "signal_type")


@query(
    "obs_11_workforce",
    f"""SELECT CAST(100000000 + doc_id AS VARCHAR) AS organisation_number, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS workforce_value, '2025' AS year FROM (SELECT doc_id, CAST({_arms(2)} AS DOUBLE) AS v, {_arms(1)} AS s FROM documents) WHERE s = 'accepted' AND doc_id % 5 <> 0 AND doc_id % 3 <> 0""",
)
def workforce(spark, folder):
    org = (F.col("doc_id") + 100000000).cast("string")
    phrase = F.expr(_arms(0).replace("\n", "\\n"))
    number = F.when(F.col("doc_id") % 3 == 0, F.lit("nr")).otherwise(F.concat(F.lit("Org.nr "), F.regexp_replace(org, "(...)", "$1 ")))
    f = load(spark, folder, "documents").select(
        org.alias(ORG), F.when(F.col("doc_id") % 5 == 0, "12").otherwise("").alias("employees_registered"), F.explode(F.array(F.lit(2024), F.lit(2025))).alias("year"),
        F.lit("https://r.no/").alias("url"), F.concat(number, F.lit("\n"), phrase, F.lit("\n")).alias("body0"), "text",
    )
    body = F.when(F.col("year") == 2025, F.concat("body0", "text")).otherwise("Antall ansatte 99")
    out = O.workforce_observations(f.select(ORG, "employees_registered", "year", "url", body.alias("body"), F.sha2("text", 256).alias("content_sha256")), RUN)
    return out.select(ORG, F.element_at("metrics", "workforce_value").alias("workforce_value"), F.col("effective_at").alias("year"))


@query(
    "obs_12_channels",
    f"""WITH h AS (SELECT user_id, k % 7 AS c, event_id, CASE WHEN k % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS v, event_type IN ('click', 'purchase') AND k % 3 <> 0 AS exact, event_type = 'purchase' AND k % 10 = 1 AS dom FROM (SELECT *, {base._K} AS k FROM events) WHERE k % 11 <> 0),
    g AS (SELECT user_id, c, count(*) AS n, bool_or(dom) AS d FROM h WHERE exact GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, c) AS rn FROM g) WHERE rn = 1 AND (n >= 2 OR d)),
    m AS (SELECT h.* FROM h JOIN b USING (user_id, c))
    SELECT 'profile_handle' AS signal_type, CAST(100000000 + user_id AS VARCHAR) AS organisation_number, count(*) AS n FROM (SELECT DISTINCT user_id FROM m) GROUP BY 2 UNION ALL SELECT 'profile_metrics', CAST(100000000 + user_id AS VARCHAR), 1 FROM m GROUP BY user_id HAVING count(v) > 0
    UNION ALL SELECT 'public_post', CAST(100000000 + user_id AS VARCHAR), count(*) FROM m GROUP BY user_id""",
)
def channels(spark, folder):
    hits = channel_hits(spark, folder)
    out = O.channel_observations(I.match_channels(hits), hits, RUN)
    return out.groupBy("signal_type", ORG).agg(F.count("*").alias("n"))


@query(
    "obs_13_task_plan",
    base.oracle("entities", """SELECT organisation_number, connector, purpose, substr(sha256(organisation_number || '|' || name || '|' || municipality || '|' || connector || '|' || purpose || '|' || COALESCE(url, chr(0))), 1, 24) AS task_id FROM
    (SELECT organisation_number, name, municipality, c AS connector, p AS purpose, CAST(NULL AS VARCHAR) AS url FROM entities, (VALUES ('google_places_api', 'resolve_places_and_public_rating'), ('licensed_news_search', 'discover_independent_mentions'), ('jobs_provider', 'discover_active_jobs')) v(c, p)
    UNION ALL SELECT organisation_number, name, municipality, 'x_connector', 'refresh_verified_profile_metrics', 'https://x.com/' || legal_form FROM entities WHERE website <> ''
    UNION ALL SELECT organisation_number, name, municipality, 'permitted_search_api', 'discover_social_handles', NULL FROM entities WHERE website = '')"""),
)
def task_plan(spark, folder):
    link = F.struct(F.lit("x").alias("platform"), F.concat(F.lit("https://x.com/"), "legal_form").alias("url"))
    links = F.when(F.col("website") != "", F.array(link)).otherwise(F.array().cast("array<struct<platform:string,url:string>>"))
    return O.plan_tasks(base.entities(spark, folder).withColumn("social_links", links)).select(ORG, "connector", "purpose", "task_id")


